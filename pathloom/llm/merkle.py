"""A Merkle manifest of a table: a root digest, and for each row the path that proves it.

Rows are leaves of ternary hash trees, one tree for each group (a source), and the groups'
roots are the leaves of one more tree.  A row's authentication path lists, level by level,
the digests next to it; whoever holds the root can check a row with its path alone.

Paths come by Merkle traversal.  Trees are cut into aligned blocks of ``FAN ** HEIGHT`` leaves.
Within a block the path moves on leaf by leaf: the nodes next to the current leaf are at
hand, and for each level a treehash stack prepares the run of nodes that is needed next.
All stacks share a fixed number of steps for each leaf; a step goes to the stack whose
lowest node is lowest, so that few unfinished nodes exist at any time.  Blocks' roots are
the leaves of the next tier, cut into blocks in turn, until one node is left; every leaf of a
block then appends the one path of its block's root.

A block is a bounded group whatever the size of a source, and a path above a block is
computed and shipped once for the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import blocks as B
from pathloom.plans.prefix import dense_index
from pathloom.plans.scratch import materialize

#: Nodes under one node.
FAN = 3
#: Levels of a block.
HEIGHT = 7


# --- columns -------------------------------------------------------------------------------


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and a path (``left,right;`` for each level) lead to."""
    step = lambda acc, x: F.sha2(F.concat(F.split_part(x, F.lit(","), F.lit(1)), acc, F.split_part(x, F.lit(","), F.lit(2))), 256)
    return F.aggregate(F.filter(F.split(path, ";"), lambda x: x != ""), leaf, step)


# --- one block -----------------------------------------------------------------------------


def digest(text: str) -> str:
    """Lowercase hexadecimal SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int, height: int) -> int:
    """Levels of a block in a tier of ``n`` nodes: those above the leaves until one is left, at most ``height``."""
    k = 0
    while n > 1 and k < height:
        n, k = -(-n // FAN), k + 1
    return k


class Treehash:
    """The nodes of one height over some leaves, by a stack that a step at a time makes grow or merge."""

    def __init__(self, leaves: list[str], start: int, end: int, height: int, on_node: Callable[[int, str], None] | None = None):
        self.leaves, self.at, self.end, self.height = leaves, start, end, height
        self.stack: list[tuple[int, str]] = []
        self.done: list[str] = []
        self.on_node = on_node

    def finished(self) -> bool:
        return self.at == self.end and not self.stack

    def tail(self) -> int:
        """The height of the lowest node on the stack; an empty stack counts as the height aimed at."""
        return self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        """Take a leaf, or merge a run: a whole one, or what is left after the last leaf."""
        s = self.stack
        if len(s) >= FAN and s[-1][0] == s[-FAN][0]:
            n = FAN
        elif self.at < self.end:
            self._put(0, self.leaves[self.at])
            self.at += 1
            return
        else:
            n = next((k for k in range(1, len(s)) if s[-1 - k][0] != s[-1][0]), len(s))
        height, children = s[-1][0] + 1, "".join(d for _, d in s[-n:])
        del s[-n:]
        self._put(height, digest(children))

    def _put(self, height: int, node: str) -> None:
        if self.on_node:
            self.on_node(height, node)
        if height == self.height:
            self.done.append(node)
        else:
            self.stack.append((height, node))

    def run(self) -> list[str]:
        """Work until the nodes are complete."""
        while not self.finished():
            self.step()
        return self.done


def block_root(leaves: list[str], levels: int) -> str:
    """The node ``levels`` above some leaves."""
    return Treehash(leaves, 0, len(leaves), levels).run()[0]


class Traversal:
    """Authentication paths of a block's leaves, first to last."""

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        #: For each level the run of nodes that the current leaf's node is in.
        self.runs: list[list[str]] = [[] for _ in range(levels)]
        Treehash(leaves, 0, len(leaves), levels, self._first).run()
        self.next = [self._prepare(h, 1) for h in range(levels)]
        #: A run of level h takes FAN ** (h + 1) leaves and half as many merges in as many leaves' time.
        self.budget = -(-FAN * levels // 2)
        self.forced = 0  # steps beyond the budget
        self.most = 0  # nodes on all stacks at any time

    def _first(self, height: int, node: str) -> None:
        if height < self.levels and len(self.runs[height]) < FAN:
            self.runs[height].append(node)

    def _prepare(self, h: int, run: int) -> Treehash | None:
        width = FAN ** (h + 1)
        return Treehash(self.leaves, run * width, min((run + 1) * width, len(self.leaves)), h) if run * width < len(self.leaves) else None

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf its ``(left, right)`` siblings by level."""
        for s in range(len(self.leaves)):
            path, node = [], s
            for run in self.runs:
                at = node % FAN
                path.append(("".join(run[:at]), "".join(run[at + 1 :])))
                node //= FAN
            yield path
            if s + 1 < len(self.leaves):
                self._advance(s + 1)

    def _advance(self, s: int) -> None:
        h, width = 0, FAN
        while h < self.levels and s % width == 0:
            ready = self.next[h]
            while not ready.finished():
                ready.step()
                self.forced += 1
            self.runs[h] = ready.done
            self.next[h] = self._prepare(h, s // width + 1)
            h, width = h + 1, width * FAN
        open_ = [t for t in self.next if t and not t.finished()]
        for _ in range(self.budget):
            if not open_:
                break
            lowest = min(open_, key=Treehash.tail)
            lowest.step()
            if lowest.finished():
                open_.remove(lowest)
        self.most = max(self.most, sum(len(t.stack) + len(t.done) for t in self.next if t))


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The node that a path leads to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _join(path: list[tuple[str, str]]) -> str:
    return "".join(f"{left},{right};" for left, right in path)


def _split(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")[:-1]]


# --- tiers ---------------------------------------------------------------------------------


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, block) of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch.column("tree").to_numpy(), batch.column("block").to_numpy()
        cut = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(tree)]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            part = batch.slice(a, z - a)
            if held and any(held[-1].column(c)[-1] != part.column(c)[0] for c in ("tree", "block")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / F.lit(FAN**height)).cast("long"))


def _together(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


_NODE = "tree long, idx long, n long, digest string"


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """The next tier of ``nodes(tree, idx, n, digest)``: a node for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_block(batches):
            n = t.column("n")[0].as_py()
            up = [[t.column("tree")[0].as_py()], [t.column("block")[0].as_py()], [-(-n // FAN**height)], [block_root(t.column("digest").to_pylist(), levels_of(n, height))]]
            yield pa.RecordBatch.from_arrays([pa.array(up[0], pa.int64()), pa.array(up[1], pa.int64()), pa.array(up[2], pa.int64()), pa.array(up[3], pa.string())], ["tree", "idx", "n", "digest"])

    cols = ["tree", "block", "idx", "n", "digest"]
    return _together(_blocked(nodes, height).select(*cols)).mapInArrow(B.lean(run), _NODE)


def _tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and the tiers above, up to the one with a single node for each tree."""
    out = [nodes]
    while out[-1].where("n > 1").head(1):
        out.append(materialize(_roots(out[-1].select("tree", "idx", "n", "digest"), height), "merkle-tier"))
    return out


def _traverse(nodes: DataFrame, above: DataFrame, height: int, schema: T.StructType, finish: Callable[[pa.Table, str, list[str], list[str]], dict]) -> DataFrame:
    """Rows of ``nodes`` with the paths through their blocks and on, from ``above(tree, idx, path, subroot)``.

    The path above a block travels as one more row, first in its block.  ``finish`` makes the
    columns of ``schema`` that the rows do not have, from the rows, the subroot, and their paths
    within the block and above it.
    """
    head = above.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), F.col("path").alias("_up"), F.col("subroot").alias("_sub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_block(batches):
            up, sub = t.column("_up")[0].as_py(), t.column("_sub")[0].as_py()
            rows = t.slice(1).combine_chunks()
            paths = list(Traversal(rows.column("digest").to_pylist(), levels_of(rows.column("n")[0].as_py(), height)))
            new = finish(rows, sub, paths, up)
            for batch in rows.to_batches():
                yield B.put_columns(batch, schema, new)

    both = _blocked(nodes, height).unionByName(head, allowMissingColumns=True)
    return _together(both).mapInArrow(B.lean(run), schema)


_PATH = "tree long, idx long, path string, subroot string"


def _paths(nodes: DataFrame, above: DataFrame, height: int, own_subroot: bool) -> DataFrame:
    """``(tree, idx, path, subroot)`` of the nodes of a tier; with ``own_subroot`` a node is its own subroot."""

    def finish(rows: pa.Table, sub: str | None, paths: list, up: str) -> dict:
        return {"path": pa.array([_join(p) + up for p in paths], pa.string()), "subroot": rows.column("digest").combine_chunks() if own_subroot else pa.array([sub] * rows.num_rows, pa.string())}

    return materialize(_traverse(nodes, above, height, T.StructType.fromDDL(_PATH), finish), "merkle-paths")


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``tree`` (the number of its group in order), ``idx`` and ``n`` in its group."""
    dealt = materialize(leaves.repartitionByRange("_group", "_order", "digest").withColumn("_pid", F.spark_partition_id()), "merkle-leaves")
    # A row for each partition and group: groups plus partitions in all.
    parts = dealt.groupBy("_pid", "_group").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_group").orderBy("_pid")
    parts = parts.select("_pid", "_group", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("_group")).alias("n"))
    trees = dense_index(dealt.select("_group").distinct(), ["_group"], "tree").withColumnRenamed("_group", "_g")
    parts = parts.join(trees, parts["_group"].eqNullSafe(trees["_g"])).select(F.col("_pid").alias("_p"), "_g", "_before", "n", "tree")
    nth = F.row_number().over(Window.partitionBy("_pid", "_group").orderBy("_order", "digest")) - 1
    found = dealt.withColumn("_nth", nth).join(parts, (F.col("_pid") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return found.withColumn("idx", (F.col("_before") + F.col("_nth")).cast("long")).drop("_pid", "_p", "_g", "_nth", "_before", "_order", "_group")


#: The contract's result for the columns and the tampering of the registered query.
ORACLE_SQL = """
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crcs AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS c
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc),
docs AS (SELECT d.doc_id, source, coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN c % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents d LEFT JOIN crcs USING (doc_id)),
leaves AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS claim FROM docs),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
low AS (SELECT tree, 0 AS lvl, idx, leaf AS h FROM placed
    UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, lvl, idx // 3),
tops AS (SELECT tree, lvl, h FROM low QUALIFY lvl = max(lvl) OVER (PARTITION BY tree)),
high AS (SELECT 0 AS lvl, tree AS idx, h FROM tops
    UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY lvl, idx // 3),
nodes AS (SELECT tree, lvl, idx, h FROM low UNION ALL SELECT -1, lvl, idx, h FROM high),
last AS (SELECT tree, max(lvl) AS lvl FROM nodes GROUP BY tree),
sides AS MATERIALIZED (SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM nodes a JOIN last USING (tree) JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.lvl < last.lvl GROUP BY a.tree, a.lvl, a.idx),
walk AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS lvl, idx, claim AS h, '' AS proof, true AS more FROM placed
    UNION ALL SELECT doc_id, leaf, own, CASE WHEN s.tree IS NULL THEN -1 ELSE w.tree END, CASE WHEN s.tree IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN s.tree IS NULL THEN own ELSE w.idx // 3 END,
        CASE WHEN s.tree IS NULL THEN h ELSE sha256(l || h || r) END, proof || coalesce(l || r, ''), s.tree IS NOT NULL OR w.tree >= 0
    FROM walk w LEFT JOIN sides s ON s.tree = w.tree AND s.lvl = w.lvl AND s.idx = w.idx WHERE more),
root AS (SELECT h AS root FROM high ORDER BY lvl DESC LIMIT 1)
SELECT w.doc_id, w.leaf, tops.h AS subroot, root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified FROM walk w JOIN tops ON tops.tree = w.own, root WHERE NOT more
"""


def merkle_manifest(docs: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id", keep: list[str] | None = None, claim: Column | None = None, with_paths: bool = False, height: int = HEIGHT) -> DataFrame:
    """The columns ``keep`` of each row with its proof under one root.

    Adds ``leaf`` (the digest of ``columns``), ``subroot`` (its group's), ``root``,
    ``proof_sha256`` (the digest of all sibling digests, in order), ``folded_root`` (where the
    claimed leaf digest, by default the leaf itself, leads along the path) and ``verified``
    (whether that is the root); ``path`` too with ``with_paths``, for :func:`folded`.  Columns of
    these names in ``keep`` (default: group and order) are replaced.  Blocks have ``height`` levels,
    which changes no result.

    Leaves of a group ascend by ``order``, null first; equal ones by leaf digest, so equal
    rows are interchangeable.  Groups ascend by UTF-8 bytes, null first.  A null value is
    ``-`` in a leaf, a null group is a group.  One row alone is its own root, with the digest
    of the empty text as its proof.  An empty table gives no rows.
    """
    out = ["leaf", "subroot", "proof_sha256", "folded_root"]
    kept = [c for c in (keep if keep is not None else [group, order]) if c.lower() not in {*out, "root", "verified", "path"}]
    col = lambda c: F.col(f"`{c}`")
    # Plain names on the way: Python workers can't take a name that holds a dot.
    own = [f"_k{i}" for i in range(len(kept))]
    leaf = leaf_digest(*[col(c) for c in columns])
    leaves = docs.select(*[col(c).alias(k) for c, k in zip(kept, own, strict=True)], col(group).alias("_group"), col(order).alias("_order"), leaf.alias("digest"), (leaf if claim is None else claim).alias("_claim"))
    tiers = _tiers(materialize(_placed(leaves), "merkle-leaves"), height)
    count = tiers[-1].count()
    subroots = tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "digest")
    tops = _tiers(subroots, height)
    first = tops[-1].head()
    root = first["digest"] if first else None
    path = tops[-1].select("tree", F.lit(0).cast("long").alias("idx"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
    for tier in tops[-2::-1]:
        path = _paths(tier, path, height, own_subroot=tier is tops[0])
    if len(tops) == 1:  # one group: its root is the root
        path = subroots.select("tree", "idx", F.lit("").alias("path"), F.col("digest").alias("subroot"))
    path = path.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", "subroot")
    for tier in tiers[-2:0:-1]:
        path = _paths(tier, path, height, own_subroot=False)
    schema = T.StructType([leaves.schema[k] for k in own] + list(T.StructType.fromDDL(", ".join(f"{c} string" for c in out) + (", path string" if with_paths else ""))))

    def finish(rows: pa.Table, sub: str, paths: list, up: str) -> dict:
        above = _split(up)
        rest = "".join(a + z for a, z in above)
        made: dict[str, list] = {c: [] for c in (*out, "path")}
        for leaf_, claimed, p in zip(rows.column("digest").to_pylist(), rows.column("_claim").to_pylist(), paths, strict=True):
            made["leaf"].append(leaf_)
            made["subroot"].append(sub)
            made["proof_sha256"].append(digest("".join(a + z for a, z in p) + rest))
            made["folded_root"].append(fold(fold(claimed, p), above))
            made["path"].append(_join(p) + up if with_paths else None)
        return {c: pa.array(v, pa.string()) for c, v in made.items()}

    made = _traverse(tiers[0], path, height, schema, finish)
    extra = [F.col("path")] if with_paths else []
    return made.select(*[F.col(k).alias(c) for c, k in zip(kept, own, strict=True)], "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", F.coalesce(F.col("folded_root") == F.lit(root), F.lit(False)).alias("verified"), *extra)
