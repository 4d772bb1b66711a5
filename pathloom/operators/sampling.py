"""Path covers, private path sampling, sibling merging, nearest reference hits and squeezed reports.

Greedy walks are sequential within a connected component and run there, one component a task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.dna import oriented
from pathloom.operators.edits import unchop
from pathloom.operators.summary import components
from pathloom.operators.traverse import oriented_nodes
from pathloom.plans.graph import Graph, by_step, canonical_edges, handle, with_pan_pos, with_positions
from pathloom.plans.prefix import dense_index
from pathloom.plans.scratch import materialize


def _walks(g: Graph, kernel, label: str) -> Graph:
    """``g`` with paths from ``kernel(component, nodes, edges)``, lists of handles."""
    c = components(g)
    n = g.nodes.join(c, "node_id").select("component", F.lit(0).alias("kind"), F.col("node_id").alias("a"), F.col("len").alias("b"))
    e = g.edges.join(c.withColumnRenamed("node_id", "from_id"), "from_id").select("component", F.lit(1).alias("kind"), handle(F.col("from_id"), F.col("from_rev")).alias("a"), handle(F.col("to_id"), F.col("to_rev")).alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = pdf[pdf.kind == 0].sort_values("a"), pdf[pdf.kind == 1]
        walks = kernel(int(pdf.component.iloc[0]), dict(zip(nodes.a.tolist(), nodes.b.tolist(), strict=True)), list(zip(edges.a.tolist(), edges.b.tolist(), strict=True)))
        rows = [(pdf.component.iloc[0], k, i, h // 2 + 1, bool(h & 1)) for k, walk in enumerate(walks) for i, h in enumerate(walk)]
        return pd.DataFrame(rows, columns=["component", "k", "step_rank", "node_id", "is_rev"])

    made = materialize(n.union(e).groupBy("component").applyInPandas(run, "component long, k long, step_rank long, node_id long, is_rev boolean"), "walks")
    ids = dense_index(made.select("component", "k").distinct(), ["component", "k"], "nth").crossJoin(g.paths.agg(F.coalesce(F.max("path_id"), F.lit(0)).alias("m")))
    ids = materialize(ids.select("component", "k", (F.col("m") + 1 + F.col("nth")).alias("path_id")), "walk-ids")
    steps = with_positions(made.join(ids, ["component", "k"]).select("path_id", "step_rank", "node_id", "is_rev"), g.nodes)
    paths = ids.select("path_id", F.concat(F.lit(label), F.col("component").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("path_name"))
    return g.with_(paths=g.paths.union(paths), steps=g.steps.unionByName(steps))


def _ways(edges: list[tuple[int, int]]) -> tuple[dict[int, list[int]], dict[int, int]]:
    """What may follow each handle, ascending, and how many ways lead to it, over edges walked either way."""
    out: dict[int, set[int]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b ^ 1, set()).add(a ^ 1)
    into = Counter(t for ends in out.values() for t in ends)
    return {h: sorted(t) for h, t in out.items()}, into


def path_cover(g: Graph, paths: int = 16, window: int = 2) -> Graph:
    """Add ``paths`` walks to each component that prefer the least covered runs of ``window`` nodes."""

    def kernel(component: int, nodes: dict[int, int], edges: list[tuple[int, int]]) -> list[list[int]]:
        out, into = _ways(edges)
        seen: Counter = Counter()
        on: Counter = Counter()
        walks = []
        heads = [(n - 1) * 2 for n in nodes if not into.get((n - 1) * 2)] or [(min(nodes) - 1) * 2]
        for _ in range(paths):
            h = min(heads, key=lambda x: (on[x // 2], x))
            walk, here = [h], {h}
            while len(walk) <= len(nodes):
                ahead = [t for t in out.get(walk[-1], ()) if t not in here]
                if not ahead:
                    break
                t = min(ahead, key=lambda x: (seen[(*walk[-(window - 1) :], x)] if window > 1 else on[x // 2], on[x // 2], x))
                walk.append(t)
                here.add(t)
            for i, x in enumerate(walk):
                on[x // 2] += 1
                if i >= window - 1:
                    seen[tuple(walk[i - window + 1 : i + 1])] += 1
            walks.append(walk)
        return walks

    return _walks(g, kernel, "cover_")


def random_cover(g: Graph, mean_depth: float, seed: int = 0) -> Graph:
    """Add seeded random walks to each component until its nodes have the mean depth."""

    def kernel(component: int, nodes: dict[int, int], edges: list[tuple[int, int]]) -> list[list[int]]:
        rng = np.random.default_rng([seed, component])
        out, _ = _ways(edges)
        ids, walks, total = list(nodes), [], 0
        while total < mean_depth * len(nodes):
            walk = [(ids[rng.integers(len(ids))] - 1) * 2]
            while len(walk) < len(nodes) and (ahead := out.get(walk[-1])):
                walk.append(ahead[rng.integers(len(ahead))])
            walks.append(walk)
            total += len(walk)
        return walks

    return _walks(g, kernel, "random_")


def private_paths(g: Graph, epsilon: float = 0.01, target_depth: float = 1.0, least: int = 2, bp: int = 10_000, seed: int = 0) -> Graph:
    """Replace the paths by walks drawn with the exponential mechanism from those that paths share.

    A walk grows by a step chosen with weight ``exp(epsilon * u / 2)`` and ``u`` the logarithm of
    how many paths that follow the whole walk go on so; it ends at ``bp`` bases or when fewer
    than ``least`` of them go on.  Walks that end short of ``bp`` are kept.
    """
    c = components(g)
    n = g.nodes.join(c, "node_id").select("component", F.lit(0).cast("long").alias("path_id"), F.lit(-1).cast("long").alias("step_rank"), F.col("node_id").alias("a"), F.col("len").cast("long").alias("b"))
    e = g.steps.join(c, "node_id").select("component", "path_id", F.col("step_rank").cast("long").alias("step_rank"), handle(F.col("node_id"), F.col("is_rev")).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, taken = pdf[pdf.step_rank < 0], pdf[pdf.step_rank >= 0].sort_values(["path_id", "step_rank"])
        size = dict(zip(nodes.a.tolist(), nodes.b.tolist(), strict=True))
        # Both readings of each path; a walk is matched by places in them.
        reads, owner = [], []
        for p, t in taken.groupby("path_id", sort=True):
            for _, r in t.groupby(t.step_rank - np.arange(len(t))):
                h = r.a.tolist()
                reads += [h, [x ^ 1 for x in reversed(h)]]
                owner += [p, p]
        at: dict[int, list[tuple[int, int]]] = {}
        for k, read in enumerate(reads):
            for i, h in enumerate(read):
                at.setdefault(h, []).append((k, i))

        def ways(places: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]], int]]:
            on: dict[int, list[tuple[int, int]]] = {}
            for k, i in places:
                if i + 1 < len(reads[k]):
                    on.setdefault(reads[k][i + 1], []).append((k, i + 1))
            counted = [(h, x, len({owner[k] for k, _ in x})) for h, x in sorted(on.items())]
            return [w for w in counted if w[2] >= least]

        component = int(pdf.component.iloc[0])
        rng = np.random.default_rng([seed, component])
        goal, total, rows, k = target_depth * sum(size.values()), 0, [], 0
        starts = [h for h in sorted(at) if ways(at[h])]
        sensitivity = math.log(2)
        while starts and total < goal:
            h = starts[rng.integers(len(starts))]
            places, length, i = at[h], 0, 0
            while True:
                rows.append((component, k, i, h // 2 + 1, bool(h & 1)))
                length += size[h // 2 + 1]
                i += 1
                ahead = ways(places) if length < bp else []
                if not ahead:
                    break
                weight = np.array([math.exp(epsilon * math.log1p(m) / (2 * sensitivity)) for _, _, m in ahead])
                h, places, _ = ahead[rng.choice(len(weight), p=weight / weight.sum())]
            total += length
            k += 1
        return pd.DataFrame(rows, columns=["component", "k", "step_rank", "node_id", "is_rev"])

    made = materialize(n.union(e).groupBy("component").applyInPandas(run, "component long, k long, step_rank long, node_id long, is_rev boolean"), "private-walks")
    ids = materialize(dense_index(made.select("component", "k").distinct(), ["component", "k"], "nth").select("component", "k", (F.col("nth") + 1).alias("path_id")), "private-ids")
    steps = with_positions(made.join(ids, ["component", "k"]).select("path_id", "step_rank", "node_id", "is_rev"), g.nodes)
    return g.with_(paths=ids.select("path_id", F.concat(F.lit("hap"), F.col("path_id").cast("string")).alias("path_name")), steps=steps)


def merge_siblings(g: Graph) -> Graph:
    """Siblings with equal parents and one sequence become one node.

    Siblings are oriented nodes that exactly the same handles lead to; only whole equal
    nodes merge here, common beginnings of unequal ones after a :func:`split_prefixes`.
    """
    from pathloom.operators.traverse import follow

    parents = follow(g).groupBy("t").agg(F.array_sort(F.collect_set("h")).alias("parents"))
    o = oriented_nodes(g).join(parents, F.col("t") == F.col("h"))
    family = o.groupBy("parents", "seq").agg(F.min("h").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    member = o.join(family, ["parents", "seq"]).select("node_id", "is_rev", "first", "h")
    # A node merges once, and never into one that itself goes.
    one = member.groupBy("node_id").agg(F.min_by(F.struct("first", "is_rev", "h"), "first").alias("m")).where("m.h <> m.first").select("node_id", (F.floor(F.col("m.first") / 2) + 1).alias("into"), (F.col("m.is_rev") != (F.col("m.first") % 2 == 1)).alias("flip"))
    gone = materialize(one.where("node_id <> into").join(one.select(F.col("node_id").alias("into")), "into", "left_anti"), "siblings")
    move = lambda df, c, r: df.join(gone.select(F.col("node_id").alias(c), F.col("into").alias("_i"), F.col("flip").alias("_f")), c, "left").withColumn(r, F.col(r) != F.coalesce("_f", F.lit(False))).withColumn(c, F.coalesce("_i", c)).drop("_i", "_f")
    nodes = with_pan_pos(g.nodes.join(gone, "node_id", "left_anti").select("node_id", "seq", "rank"))
    edges = canonical_edges(move(move(g.edges, "from_id", "from_rev"), "to_id", "to_rev"))
    steps = move(g.steps.select("path_id", "step_rank", "node_id", "is_rev"), "node_id", "is_rev")
    return Graph(nodes, edges, g.paths, with_positions(steps, nodes))


def split_prefixes(g: Graph) -> Graph:
    """Siblings with equal parents that begin alike are cut behind what they share."""
    from pathloom.operators.edits import divide
    from pathloom.operators.traverse import follow

    parents = follow(g).groupBy("t").agg(F.array_sort(F.collect_set("h")).alias("parents"))
    o = oriented_nodes(g).join(parents, F.col("t") == F.col("h")).withColumn("base", F.substring("seq", 1, 1))
    # Between the smallest and largest sequence of a family lies what all of them share.
    family = o.groupBy("parents", "base").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("k"), F.min("len").alias("least")).where("k > 1")
    same = F.expr("size(filter(sequence(1, cast(least AS int)), i -> substring(lo, 1, i) = substring(hi, 1, i)))")
    cut = o.join(family.withColumn("n", same), ["parents", "base"]).where("n < len")
    return divide(g, cut.select("node_id", F.when(F.col("is_rev"), F.col("len") - F.col("n")).otherwise(F.col("n")).cast("long").alias("offset")))


def normalize(g: Graph, rounds: int = 10) -> Graph:
    """Unchop and merge siblings until the total length no longer shrinks."""
    keep = lambda x: Graph(*[materialize(t, "normal") for t in (x.nodes, x.edges, x.paths, x.steps)])
    size = lambda x: x.nodes.agg(F.sum("len")).first()[0]
    g = keep(unchop(g))
    length = size(g)
    for _ in range(rounds):
        new = keep(unchop(keep(merge_siblings(keep(split_prefixes(g))))))
        now = size(new)
        if now >= length:
            break
        g, length = new, now
    return g


def nearest_reference(g: Graph, positions: DataFrame, reference: DataFrame, radius: int = 10_000) -> DataFrame:
    """``(node_id, ref_id, ref_offset, steps)``: the nearest reference step of each node of ``positions``.

    Walks leave the node both ways, a frontier join a step, up to ``radius`` bases, which
    alone ends them; of equally near steps the one with the smallest path and offset counts.
    """
    way = g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    way = materialize(way.union(way.select("b", "a")).distinct().join(g.nodes.select(F.col("node_id").alias("b"), "len"), "b").select("a", "b", "len"), "both-ways")
    on = g.steps.join(reference.select("path_id"), "path_id", "left_semi").groupBy("node_id").agg(F.min(F.struct("path_id", "pos")).alias("m"))
    on = materialize(on.select("node_id", F.col("m.path_id").alias("ref_id"), F.col("m.pos").alias("ref_offset")), "reference-nodes")
    todo = materialize(positions.select(F.col("node_id").alias("start")).distinct().select("start", F.col("start").alias("node_id"), F.lit(0).cast("long").alias("bp")), "searching")
    done, seen, k = None, todo, 0
    while True:
        hit = todo.join(on, "node_id").groupBy("start").agg(F.min(F.struct("ref_id", "ref_offset")).alias("m")).select("start", "m.ref_id", "m.ref_offset", F.lit(k).alias("steps"))
        hit = materialize(hit, "reference-hits")
        if done is None or not hit.isEmpty():
            done = hit if done is None else done.union(hit)
        rest = todo.join(hit, "start", "left_anti")
        new = rest.join(way, rest.node_id == way.a).select("start", F.col("b").alias("node_id"), (F.col("bp") + F.col("len")).alias("bp")).where(F.col("bp") <= radius)
        # A later way to a node goes on only if it is shorter in bases.
        new = new.groupBy("start", "node_id").agg(F.min("bp").alias("bp")).join(seen.withColumnRenamed("bp", "old"), ["start", "node_id"], "left").where("old IS NULL OR bp < old")
        todo = materialize(new.join(done.select("start"), "start", "left_anti").select("start", "node_id", "bp"), "searching")
        if todo.isEmpty():
            break
        seen = materialize(seen.union(todo).groupBy("start", "node_id").agg(F.min("bp").alias("bp")), "searched")
        k += 1
    return done.withColumnRenamed("start", "node_id")


def spelled_paths(g: Graph) -> DataFrame:
    """``(path_id, seq)`` of non-empty paths."""
    s = g.steps.join(g.nodes.select("node_id", "seq"), "node_id").select("path_id", F.struct("step_rank", oriented(F.col("seq"), F.col("is_rev")).alias("s")).alias("x"))
    return s.groupBy("path_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "").alias("seq"))


def neighbours_in_path(g: Graph) -> DataFrame:
    """Each step with the nodes before and after it."""
    w: Window = by_step()
    return g.steps.select("path_id", "step_rank", F.lag("node_id").over(w).alias("before"), "node_id", F.lead("node_id").over(w).alias("after"))
