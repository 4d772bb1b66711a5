import hashlib
import json
import logging
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import haplotype_report as H
from jobs import text_novelty as N
from jobs.options import options
from pathloom.plans.graph import Graph, step_edges, with_pan_pos, with_positions
from pathloom.sources.gfa import save_graph

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("PATHLOOM_DATA", "/root/testdata/sf0.001")

#: Node lengths, and the walks of five haplotypes of three samples and an empty one.
LENGTHS = {1: 4, 2: 10, 3: 3, 4: 7, 5: 20, 6: 1}
WALKS = {1: ("ref#1#a", [1, 2, 4]), 2: ("x#1#a", [1, 3, 4]), 3: ("x#2#a", [1, 3, 5, 4, 5]), 4: ("y#1#a", [6, 2, 2, 5, 3, 1]), 5: ("y#1#b", []), 6: ("plain", [6])}


def graph(spark):
    nodes = with_pan_pos(spark.createDataFrame([(i, "A" * n, i - 1) for i, n in LENGTHS.items()], "node_id long, seq string, rank long"))
    steps = with_positions(spark.createDataFrame([(p, k, n, (p + k) % 2 == 1) for p, (_, walk) in WALKS.items() for k, n in enumerate(walk)], "path_id long, step_rank int, node_id long, is_rev boolean"), nodes)
    return Graph(nodes, step_edges(steps), spark.createDataFrame([(p, n) for p, (n, _) in WALKS.items()], "path_id long, path_name string"), steps)


def brute_report(reference, core, cloud, least):
    sample = {p: n.split("#")[0] for p, (n, _) in WALKS.items()}
    on = {n: {sample[p] for p, (_, w) in WALKS.items() if n in w} for n in LENGTHS}
    depth = {n: sum(w.count(n) for _, w in WALKS.values()) for n in LENGTHS}
    share = {n: len(s) / len(set(sample.values())) for n, s in on.items()}
    kind = {n: "core" if x >= core else "cloud" if x < cloud else "shell" for n, x in share.items()}
    known = {n for n in LENGTHS if reference in on[n]}
    out = []
    for p, (name, w) in WALKS.items():
        bp = sum(LENGTHS[n] for n in w)
        of = lambda test: sum(LENGTHS[n] for n in w if test(n))
        runs, now = [], 0
        for n in [*w, None]:
            if n is None or n in known:
                runs += [now] if now >= least and now else []
                now = 0
            else:
                now += LENGTHS[n]
        mean = lambda v: round(sum(LENGTHS[n] * v(n) for n in w) / bp, 9) if bp else None
        out.append((p, name, len(w), bp, mean(depth.get), mean(lambda n: len(on[n])), *[of(lambda n, k=k: kind[n] == k) for k in ("core", "shell", "cloud")], of(known.__contains__), len(runs), sum(runs), max(runs, default=0), sample[p]))
    return out


def rows_of(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_haplotype_report_against_brute_force_and_again(spark, tmp_path):
    save_graph(graph(spark), str(tmp_path / "graph"))
    o = {"input": str(tmp_path / "graph"), "output": str(tmp_path / "out"), "reference": "ref", "core": 0.7, "cloud": 0.5, "least_run": 2}
    want = sorted(brute_report("ref", 0.7, 0.5, 2))
    for _ in range(2):
        n = H.run(spark, o)
        assert n == {"nodes": 6, "paths": 6, "steps": 18, "written": 6}
        assert rows_of(H.read_report(spark, o["output"])) == want
    assert sorted(x for x in os.listdir(tmp_path / "out/paths") if "=" in x) == ["sample=plain", "sample=ref", "sample=x", "sample=y"]
    # Another reference, with no path at all: everything is outside.
    H.run(spark, o | {"reference": "nobody", "least_run": 1})
    assert rows_of(H.read_report(spark, o["output"])) == sorted(brute_report("nobody", 0.7, 0.5, 1))


def test_options():
    assert options({"a": ..., "b": 2}, {"a": 1}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="unknown options: c"):
        options({"a": ...}, {"a": 1, "c": 2})
    with pytest.raises(ValueError, match="without a value: a"):
        options({"a": ...}, {})


def write(spark, folder, rows, name):
    """Add one file of documents to a folder."""
    made = f"{folder}-{name}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(made)
    os.makedirs(folder, exist_ok=True)
    part = next(x for x in os.listdir(made) if x.startswith("part-"))
    shutil.copy(f"{made}/{part}", f"{folder}/{name}.parquet")


def brute_ledger(batches, delim="\n"):
    seen, out = set(), []
    for k, rows in enumerate(batches):
        docs = {}
        for doc_id, text, lang, source, _ in rows:
            if doc_id is not None:
                docs.setdefault(doc_id, []).append(([x for x in (text or "").split(delim) if x], source, lang))
        new = set()
        for doc_id in sorted(docs):
            mine = docs[doc_id]
            own = {x for p, _, _ in mine for x in p} - seen - new
            new |= own
            least = lambda i: min((m[i] for m in mine if m[i] is not None), default=None)
            out.append((doc_id, least(1), sum(len(m[0]) for m in mine), sum(len(set(m[0])) for m in mine), sum(len(x) for m in mine for x in m[0]), len(own), sum(map(len, own)), k, least(2)))
        seen |= new
    return sorted(map(str, out))


FIRST = [(1, "a\nbb\n\na", "en", "s1", 7), (2, "bb\nccc", "de", "s2", 6), (3, None, "en", None, None), (4, "", None, "s1", 0), (None, "zz", "en", "s1", 2), (5, "é\nbb\x0bq", None, None, 6)]
SECOND = [(6, "ccc\ndddd", "en", "s1", 8), (7, "dddd\na\nzz", "en", "s2", 9), (7, "zz\neee", None, "s0", 6), (2, "bb\nnew", "fr", "s2", 6)]


def ledger(spark, out):
    return sorted(str(tuple(r)) for r in N.read_ledger(spark, out).collect())


def test_text_novelty_takes_only_what_is_new(spark, tmp_path, caplog):
    o = {"input": f"{tmp_path}/in", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/mark"}
    write(spark, o["input"], FIRST, "one")
    with caplog.at_level(logging.INFO):
        assert [(n["read"], n["documents"], n["written"]) for n in N.run(spark, o)] == [(6, 5, 5)]
    assert "batch 0: read 6 rows (1 without doc_id), wrote 5" in caplog.text
    assert ledger(spark, o["output"]) == brute_ledger([FIRST])
    assert N.run(spark, o) == []  # nothing new, nothing read
    before = {f: os.path.getmtime(f"{tmp_path}/out/ledger/batch=0/lang=en/{f}") for f in os.listdir(tmp_path / "out/ledger/batch=0/lang=en")}
    write(spark, o["input"], SECOND, "two")
    os.utime(f"{o['input']}/two.parquet", (1_500_000_000, 1_500_000_000))  # an old file that came late
    assert [(n["read"], n["written"]) for n in N.run(spark, o)] == [(4, 3)]
    assert ledger(spark, o["output"]) == brute_ledger([FIRST, SECOND])
    assert before == {f: os.path.getmtime(f"{tmp_path}/out/ledger/batch=0/lang=en/{f}") for f in os.listdir(tmp_path / "out/ledger/batch=0/lang=en")}

    # A run that broke off after it had written the index, and one after all but the commit.
    for lost in ("ledger/batch=1", "index/batch=1", None):
        if lost:
            shutil.rmtree(tmp_path / "out" / lost)
        for f in ("1", ".1.crc"):
            os.remove(tmp_path / "mark/commits" / f)
        assert len(N.run(spark, o)) == 1
        assert ledger(spark, o["output"]) == brute_ledger([FIRST, SECOND])

    # Another checkpoint would number the same batches anew (also where the last one held nothing new).
    write(spark, o["input"], [(8, "a\nbb", "en", "s1", 4)], "three")
    assert [n["new_segments"] for n in N.run(spark, o)] == [0]
    shutil.rmtree(tmp_path / "out/ledger/batch=1")
    with pytest.raises(Exception, match="checkpoint is missing"):
        N.run(spark, o | {"checkpoint": f"{tmp_path}/other"})


def test_text_novelty_in_small_batches_and_other_segments(spark, tmp_path):
    o = {"input": f"{tmp_path}/in", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/mark", "files_per_batch": 1, "delim": "."}
    parts = [[(10 * k + i, f"x{i % 3}.y{i}.z{k}..", "en", "s", 1) for i in range(5)] for k in range(3)]
    for k, rows in enumerate(parts):
        write(spark, o["input"], rows, f"f{k}")
        os.utime(f"{o['input']}/f{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    assert len(N.run(spark, o)) == 3
    assert ledger(spark, o["output"]) == brute_ledger(parts, ".")
    index = spark.read.parquet(f"{o['output']}/index")
    assert index.count() == index.select("segment").distinct().count() == 3 + 5 + 3
    assert {r.segment for r in index.where("owner = 0").collect()} == {hashlib.md5(x).hexdigest() for x in (b"x0", b"y0", b"z0")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_jobs_as_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from jobs import queries as Q

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    for name, sql in Q.oracle_sql().items():
        got = Q.queries()[name](spark, DATA)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(str(tuple(map(plain, r))) for r in got.collect()) == sorted(str(tuple(map(plain, r))) for r in want) and want, name


def test_command_lines(spark, tmp_path):
    save_graph(graph(spark), str(tmp_path / "graph"))
    write(spark, f"{tmp_path}/in", FIRST, "one")
    (tmp_path / "h.json").write_text(json.dumps({"input": f"{tmp_path}/graph", "output": f"{tmp_path}/h", "reference": "ref", "least_run": 2}))
    (tmp_path / "n.json").write_text(json.dumps({"input": "nowhere", "output": f"{tmp_path}/n"}))
    for args in (["jobs.haplotype_report", "--config", f"{tmp_path}/h.json", "--core", "0.7", "--cloud", "0.5"], ["jobs.text_novelty", "--config", f"{tmp_path}/n.json", "--input", f"{tmp_path}/in", "--checkpoint", f"{tmp_path}/c"]):
        done = subprocess.run([sys.executable, "-m", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "wrote" in done.stderr, done.stderr[-2000:]
    assert rows_of(H.read_report(spark, f"{tmp_path}/h")) == sorted(brute_report("ref", 0.7, 0.5, 2))
    assert ledger(spark, f"{tmp_path}/n") == brute_ledger([FIRST])
    assert spark.read.parquet(f"{tmp_path}/h/paths").where(F.col("sample") == "x").count() == 2


def test_haplotype_report_moves_a_step_to_its_path_its_node_and_back(spark):
    """No step is counted and looked up in turn: three shuffles carry steps, the others paths, nodes and samples."""
    g = graph(spark)
    steps = spark.range(4000).select((F.col("id") % 50).alias("path_id"), F.floor(F.col("id") / 50).cast("int").alias("step_rank"), (F.col("id") * 7 % 6 + 1).alias("node_id"))
    g = g.with_(paths=spark.range(50).select(F.col("id").alias("path_id"), F.concat(F.lit("s"), F.col("id") % 5, F.lit("#"), "id").alias("path_name")), steps=steps)
    out = H.report(g, "s1", "#", 1, 0.9, 0.2, 1)
    assert sum(r.step_count for r in out.collect()) == 4000

    def exchanges(plan):
        name, kids = plan.nodeName(), plan.children()
        if name == "AdaptiveSparkPlan":
            return exchanges(plan.executedPlan())
        if name.endswith("QueryStage"):
            return exchanges(plan.plan())
        own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
        return own + [x for i in range(kids.size()) for x in exchanges(kids.apply(i))]

    assert sum(n >= 4000 for n in exchanges(out._jdf.queryExecution().executedPlan())) <= 3


def test_steps_without_strands_are_those_with(spark):
    from pathloom.sources.tables import walks_of_tables

    both = [walks_of_tables(spark, DATA, strands=x).select("path_id", "step_rank", "node_id") for x in (True, False)]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
