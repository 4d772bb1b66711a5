"""What queries move between tasks, and that the results stay those of plain loops."""

from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from pathloom.operators import context as C
from pathloom.operators import edits as M
from pathloom.operators import ranges as R
from pathloom.operators import structure as X
from pathloom.operators import summary as S
from pathloom.operators import traverse as T
from pathloom.plans import graph as graph_module
from pathloom.plans import queries as Q
from pathloom.plans import scratch
from pathloom.plans.graph import Graph, step_edges, with_pan_pos, with_positions
from pathloom.sources import gfa


def graph_of_walks(spark, lengths, walks):
    """Nodes 1, 2, ... of the given lengths, and paths of signed node ids."""
    nodes = with_pan_pos(spark.createDataFrame([(i + 1, "ACGTN"[i % 5] * n, i) for i, n in enumerate(lengths)], "node_id long, seq string, rank long"))
    rows = [(p, k, abs(x), x < 0) for p, w in walks.items() for k, x in enumerate(w)]
    steps = with_positions(spark.createDataFrame(rows, "path_id long, step_rank long, node_id long, is_rev boolean"), nodes)
    paths = spark.createDataFrame([(p, f"p{p}") for p in walks], "path_id long, path_name string")
    return Graph(nodes, step_edges(steps), paths, steps)


def moved(spark, df):
    """Rows of ``df`` and how many records its shuffles wrote."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()

    def written():
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = df().collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, written() - before


@pytest.fixture(scope="module")
def hub(spark):
    """150 paths over one node, each with a node of its own length beside it."""
    return graph_of_walks(spark, [7, *range(10, 160)], {p: [1, -(p + 1) if p % 2 else p + 1] for p in range(1, 151)})


def context(walk, lengths, at, before, after):
    pos = [sum(lengths[abs(x) - 1] for x in walk[:k]) for k in range(len(walk) + 1)]
    near = [k for k in range(len(walk)) if k == at or (pos[at] - pos[k + 1] < before if k < at else pos[k] - pos[at + 1] < after)]
    seen = Counter(abs(walk[k]) for k in near)
    return seen if sum(n * lengths[x - 1] for x, n in seen.items()) >= before + after else Counter()


def test_break_points_equal_a_plain_loop_and_move_no_contexts(spark):
    lengths = [5, 3, 8, 2, 13, 1, 9]
    walks = {p: [(p * k * k + 3 * k + p) % 7 + 1 for k in range(2 + p % 6)] for p in range(1, 60)}
    g = graph_of_walks(spark, lengths, walks)
    targets = g.paths.where("path_id % 3 = 0")
    rows, n = moved(spark, lambda: C.break_points(g, targets, g.paths, 12))
    bases = lambda c: sum(k * lengths[x - 1] for x, k in c.items())
    want = set()
    for t, q in product(walks, walks):
        hits = [k for k, x in enumerate(walks[q]) if x in walks[t]]
        if t % 3 or t == q or not hits:
            continue
        for direction, at in (("front", hits[0]), ("back", hits[-1])):
            ranks = [k for k, x in enumerate(walks[t]) if x == walks[q][at]]
            room = lambda w, k: sorted((sum(lengths[x - 1] for x in w[:k]), sum(lengths[x - 1] for x in w[k + 1 :])))
            lo, hi = (min(12, *(room(w, k)[i] for w, k in [(walks[q], at), *((walks[t], k) for k in ranks)])) for i in (0, 1))
            score = {}
            for k in ranks:
                for (a, b), (c, d) in product([(lo, hi), (hi, lo)], repeat=2):
                    x, y = context(walks[t], lengths, k, a, b), context(walks[q], lengths, at, c, d)
                    i = bases(x & y)
                    both = bases(x) + bases(y) - i
                    score[k] = max(score.get(k, 0.0), i / both if both else 0.0)
            top = [k for k in ranks if score[k] == max(score.values())]
            want.add((t, q, direction, at, top[len(top) // 2], max(score.values())))
    assert {(r.target_id, r.query_id, r.direction, r.query_rank, r.target_rank, r.jaccard) for r in rows} == want
    assert n < 12000


def test_segments_that_cannot_win_do_not_move(spark, hub):
    rows, n = moved(spark, lambda: Q._pair_segments(hub))
    assert {(r.query_id, r.target_id, r.jaccard, r.inverted) for r in rows} == {(p, p, 1.0, False) for p in range(1, 151)}
    assert n < 6000  # 150 * 150 pairs meet on the node


def test_context_pairs_do_not_move(spark, hub):
    rows, n = moved(spark, lambda: Q._context_pairs(hub))
    size = {p: 7 + 9 + p for p in range(1, 151)}
    full = {p: s if s >= 60 else 0 for p, s in size.items()}
    want = {(a * 1000, b * 1000): 7 / (full[a] + full[b] - 7) if full[a] and full[b] else 0.0 for a, b in product(size, size) if a < b and (full[a] or full[b])}
    assert {(r.left, r.right): r.jaccard for r in rows} == want
    assert n < 6000


def test_paths_are_cut_many_at_a_time(spark, hub):
    """One row a path goes to Python, not one group: the plan groups nothing there."""
    cut = C.segment_paths(hub, hub.paths)
    assert "FlatMapGroups" not in cut._jdf.queryExecution().executedPlan().toString()
    assert {(r.path_id, r.start_rank, r.start, r.end) for r in cut.collect()} == {x for p in range(1, 151) for x in ((p, 0, 0, 7), (p, 1, 7, 16 + p))}


def test_injected_ranges_do_not_cut_the_other_paths(spark):
    """80 paths go 20 times over one node that 80 ranges cut: their steps' pieces are many, those in ranges few."""
    g = graph_of_walks(spark, [100], {p: [1 if k % 3 else -1 for k in range(20)] for p in range(1, 81)})
    ranges = g.paths.select("path_id", (F.col("path_id") + 3).alias("start"), (F.col("path_id") + 110).alias("end"), F.concat(F.lit("r"), "path_id").alias("name"))

    rows, n = moved(spark, lambda: gfa.path_fasta(M.injected_paths(g, ranges)).select("value"))
    node = "ACGTN"[0] * 100
    back = node.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    whole = "".join(node if k % 3 else back for k in range(20))
    assert {r.value for r in rows} == {f">r{p}\n{whole[p + 3 : p + 110]}" for p in range(1, 81)}
    assert n < 80 * 20 * 81 / 2


class Written(Exception):
    """Raised in place of writing a table."""


def write_nothing(df, name, partition_by=None):
    raise Written(name)


@pytest.mark.parametrize("part", [lambda g: X.distances_to_ends(g, 20), X.nice_components], ids=["distances_to_ends", "nice_components"])
def test_edges_are_written_before_they_are_read_again(hub, monkeypatch, part):
    monkeypatch.setattr(graph_module, "materialize", write_nothing)
    with pytest.raises(Written, match="edges"):
        part(hub)


def test_many_reached_handles_are_not_sent_through_the_driver(hub, monkeypatch):
    way = X._ways(hub)
    seeds = hub.nodes.where("node_id = 1").select(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("d"))
    want = set(X._fewest(way, seeds, 60, "near").collect())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ends = ((1, False, 0), (3, False, 0), 90)
    assert "BroadcastHashJoin" in plan(X.connecting(hub, *ends))
    monkeypatch.setattr(scratch, "FEW", 0)
    assert "BroadcastHashJoin" not in plan(X.connecting(hub, *ends))
    assert set(X._fewest(way, seeds, 60, "near").collect()) == want and len(want) > 5


def test_extract_writes_what_it_reads_many_times(hub, monkeypatch):
    monkeypatch.setattr(graph_module, "materialize", write_nothing)
    with pytest.raises(Written, match="nodes"):
        M.extract(hub, hub.nodes.select("node_id"))


def test_heaviest_ways_are_written_before_they_are_read_again(hub, monkeypatch):
    monkeypatch.setattr(Q, "materialize", write_nothing, raising=False)
    with pytest.raises(Written, match="heaviest"):
        Q._ways_back(hub)


@pytest.mark.parametrize("part", [lambda g: T.kmers(g, 12), lambda g: T.kmers(g, 12, max_furcations=3), S.nondeterministic_edges], ids=["kmers", "kmers_of_few_forks", "nondeterministic_edges"])
def test_many_nodes_are_not_sent_to_every_task(hub, monkeypatch, part):
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch.materialize(df, name)

    def run():
        plans.clear()
        rows = Counter(noted(part(g), "result").collect())
        return rows, [p for p in plans if "Join" in p]

    # Nodes read from files, which the optimizer takes to be few.
    g = hub.written("nodes", "edges")
    monkeypatch.setattr(T, "materialize", noted)
    want, small = run()
    assert any("BroadcastHashJoin" in p for p in small)
    monkeypatch.setattr(scratch, "FEW", 0)
    got, large = run()
    assert got == want and sum(want.values()) > 100
    assert len(large) > 0 and not any("BroadcastHashJoin" in p for p in large)


@pytest.fixture
def by_path(spark):
    """As in the session beside a small one: joins on the path and more take steps where they lie; no table is sent to all."""
    own = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in own.items():
        spark.conf.set(key, value)
    yield
    for key in own:
        spark.conf.unset(key)


def test_overlapping_paths_go_to_ranges_as_lists(spark, by_path, monkeypatch):
    """Numbers on both sides of a limit of 31 bits, and lists of few."""
    first = 3 * (1 << 31) - 75
    many = graph_of_walks(spark, [7, *range(10, 160)], {first + p: [1, -(p + 1) if p % 2 else p + 1] for p in range(150)})
    ranges = many.paths.selectExpr("path_id", "path_id % 5 AS start", "20L AS end")
    got, n = moved(spark, lambda: R.overlapping_paths(many, ranges))
    want = {(first + p, (first + p) % 5, 20, first + o) for p, o in product(range(150), range(150)) if p != o}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert n < 4000  # 150 * 149 pairs
    monkeypatch.setattr(R, "LISTED", 16)
    assert {tuple(r) for r in R.overlapping_paths(many, ranges).collect()} == want


def test_contexts_are_put_together_where_the_path_lies(spark, hub, by_path):
    rows, n = moved(spark, lambda: Q._context_pairs(hub))
    assert len(rows) == 10272 and n < 2500


def test_contexts_of_equal_numbers_are_one(spark):
    """Step 1001 of path 1 has the number of step 1 of path 2."""
    g = graph_of_walks(spark, [40, 9, 70], {1: [2] * 1001 + [1, 3], 2: [3, 1]})
    got = {(r.left, r.right): r.jaccard for r in Q._context_pairs(g).collect()}
    assert set(got) == {(2001, 2001), (2002, 2000)}
    assert got[2001, 2001] == 1.0


def test_surroundings_of_steps_are_put_together_where_the_path_lies(spark, by_path):
    lengths = [5, 3, 8, 2, 13, 1, 9]
    g = graph_of_walks(spark, lengths, {p: [(p * k * k + 3 * k + p) % 7 + 1 for k in range(2 + p % 6)] for p in range(1, 60)})
    rows, n = moved(spark, lambda: C.break_points(g, g.paths.where("path_id % 7 = 3"), g.paths, 12))
    assert len(rows) == 858 and n < 3000


def test_large_tables_are_joined_where_they_lie(spark):
    from pathloom.plans.session import session_for

    assert session_for(spark, 1 << 30).conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
    assert session_for(spark, 1) is spark
