import json
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("PATHLOOM_DATA", "/root/testdata/sf0.001")


def test_imports_without_a_session_and_without_corpus_operators(tmp_path):
    """The registry loads before any session, and with the optional subpackage absent."""
    code = "import sys; sys.modules['pathloom.llm'] = None if sys.argv[1] == 'no' else sys.modules.get('pathloom.llm')\nif sys.argv[1] != 'no': del sys.modules['pathloom.llm']\nimport json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    found = {}
    for mode in ("yes", "no"):
        out = subprocess.run([sys.executable, "-c", code, mode], cwd=ROOT, capture_output=True, text=True, check=True).stdout
        found[mode] = json.loads(out.splitlines()[-1])
    assert not [q for q in found["no"][0] if q.startswith("op")] and len(found["no"][0]) > 90
    assert set(found["no"][0]) <= set(found["yes"][0])
    assert set(found["yes"][1]) <= set(found["yes"][0])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["node_id", "depth", "depth_uniq"] and rows.count() == 200


def _key(rows):
    plain = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_graph_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pathloom.plans import queries as Q

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")


    def rows(name):
        got = Q.queries()[name](spark, DATA)
        cols = sorted(got.columns)
        return cols, _key(map(tuple, got.select(*[f"`{c}`" for c in cols]).collect()))

    # Small queries leave most cores idle: several at a time.
    wrong = []
    with ThreadPoolExecutor(6) as pool:
        for (name, sql), (cols, got) in zip(Q.oracle_sql().items(), pool.map(rows, Q.oracle_sql()), strict=True):
            want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
            if got != _key(want):
                wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_untangle_and_break_points_take_all_paths(spark):
    """Every path that meets a reference path has its rows."""
    from pathloom.plans import queries as Q
    from pathloom.sources.tables import graph_of_tables

    g = graph_of_tables(spark, DATA)
    names = {r.path_id: r.path_name for r in g.paths.collect()}
    visits = {}
    for r in g.steps.select("path_id", "node_id").distinct().collect():
        visits.setdefault(r.path_id, set()).add(r.node_id)
    targets = [p for p, n in names.items() if n.startswith("NATION_3#")]
    meet = {(t, q) for t in targets for q, nodes in visits.items() if nodes & visits.get(t, set())}
    assert len({q for _, q in meet}) > 2 * len(targets)
    assert {r.query_id for r in Q.queries()["c14_untangle"](spark, DATA).select("query_id").distinct().collect()} == {q for _, q in meet}
    got = {(r.target_id, r.query_id) for r in Q.queries()["c12_break_points"](spark, DATA).collect()}
    assert got == {(t, q) for t, q in meet if t != q}
