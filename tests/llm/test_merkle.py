import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pathloom.llm import merkle as M

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
DDL = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(level)))
        out.append(("".join(level[i] for i in run if i < at), "".join(level[i] for i in run if i > at)))
        at //= 3
    return out


def tampered(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 or row[4] is None:
        return row
    return (*row[:4], row[4].replace("\n", ""))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in groups[s]])
    top = climb([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, (_, _, mine, r) in enumerate(groups[s]):
            way = path(trees[s], i) + path(top, k)
            node = M.fold(leaf(tampered(r)), way)
            out.append((r[0], mine, trees[s][-1][0], root, h("".join(a + z for a, z in way)), node, node == root))
    return sorted(map(str, out))


def query(docs, **more):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = M.leaf_digest(*[changed if c == "text" else F.col(c) for c in COLUMNS])
    return M.merkle_manifest(docs, COLUMNS, keep=["doc_id"], claim=claim, **more)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 81, 82, 200, 243, 700])
def test_traversal_equals_whole_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = climb(leaves)
    assert M.block_root(leaves, len(levels) - 1) == levels[-1][0]
    t = M.Traversal(leaves, len(levels) - 1)
    assert list(t) == [path(levels, i) for i in range(n)]
    # The schedule is never late, and unfinished nodes grow with the levels, not with the leaves.
    assert t.forced == 0 and t.most <= 5 * len(levels)


def test_levels_above_a_short_block_hash_single_nodes():
    assert M.block_root([h("a")], 2) == h(h(h("a")))
    assert list(M.Traversal([h("a")], 2)) == [[("", ""), ("", "")]]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_against_brute_force(spark, height):
    rng = random.Random(height)
    rows = [(i, rng.choice(["hot", "hot", "é", "b", None]), rng.choice(["en", None]), rng.choice([5, None]), "x\n" * rng.randint(0, 3) + str(i)) for i in range(120)]
    rows += [(None, "b", "en", 1, None), (7, "b", "en", 1, ""), (7, "b", "en", 1, ""), (9, "one", None, None, "a\nb"), (10, "z" * 5000, "en", 2, "y\n" * 5000), (11, "", "en", 3, "\n")]
    rows += [(1000 + i, f"s{i}", "en", 1, f"{i}\n") for i in range(20)]
    rng.shuffle(rows)
    got = query(spark.createDataFrame(rows, DDL).repartition(5), height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_one_group_and_one_row(spark):
    for rows in ([(1, "a", None, None, "x\ny")], [(i, None, "en", 1, str(i)) for i in range(5)], [(i, f"s{i}", "en", 1, str(i)) for i in range(4)]):
        assert sorted(str(tuple(r)) for r in query(spark.createDataFrame(rows, DDL)).collect()) == brute(rows)
    assert query(spark.createDataFrame([], DDL)).count() == 0


def test_stored_paths_prove_rows(spark):
    """With the paths of a manifest, changed rows fail and others pass, in column functions alone."""
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, DDL)
    out = M.merkle_manifest(docs, COLUMNS, keep=["doc_id", "source"], with_paths=True)
    assert out.where("NOT verified").count() == 0
    later = docs.withColumn("text", F.when(F.col("doc_id") == 17, F.lit("forged")).otherwise(F.col("text")))
    proved = out.join(later.select("doc_id", M.leaf_digest(*[F.col(c) for c in COLUMNS]).alias("now")), "doc_id").withColumn("ok", M.folded(F.col("now"), F.col("path")) == F.col("root"))
    assert [r.doc_id for r in proved.where("NOT ok").collect()] == [17]


def test_clashing_and_dotted_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y"), (2, None, "p", "q")], "doc_id long, source string, `a.b` string, root string")
    out = M.merkle_manifest(docs, ["doc_id", "a.b"], keep=["doc_id", "a.b", "root"])
    assert out.columns == ["doc_id", "a.b", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert {(r.doc_id, r["a.b"], r.leaf, r.verified) for r in out.collect()} == {(1, "x", leaf((1, "x")), True), (2, "p", leaf((2, "p")), True)}
