import pytest
from test_structure import make

from pathloom.operators import edits, order
from pathloom.plans.graph import Graph, step_edges, with_positions

LENGTHS = {1: 1, 2: 1, 3: 1, 4: 1, 5: 10, 6: 1, 7: 3, 8: 1, 9: 1}
WALKS = {1: ("a", [1, 2, 3, 4]), 2: ("b", [1, -5, 4]), 3: ("c", [2, 6, 7, 6, 3]), 4: ("d", [8, 1, 9]), 5: ("e", [6, 9, 7]), 6: ("f", [])}


@pytest.fixture(scope="module")
def g(spark):
    g = make(spark, LENGTHS, [(8, False, 9, False)])
    rows = [(p, k, abs(n), n < 0) for p, (_, w) in WALKS.items() for k, n in enumerate(w)]
    steps = with_positions(spark.createDataFrame(rows, "path_id long, step_rank int, node_id long, is_rev boolean"), g.nodes)
    return Graph(g.nodes, g.edges.union(step_edges(steps)).distinct(), spark.createDataFrame([(p, n) for p, (n, _) in WALKS.items()], "path_id long, path_name string"), steps)


def ids(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node_id long")


def names(x):
    return sorted(r.path_name for r in x.paths.collect())


def nodes(x):
    return sorted(r.node_id for r in x.nodes.collect())


def test_gaps_between_kept_nodes_are_filled(spark, g):
    core = ids(spark, 1, 2, 3, 4, 99)
    plain = edits.extract(g, core, max_gap=0)
    assert nodes(plain) == [1, 2, 3, 4] and names(plain) == ["a", "b:0-1", "b:11-12", "c:0-1", "c:6-7", "d:1-2"]
    # c leaves for five base pairs, b for ten; d is outside at its ends only.  Then e leaves 6 for 9.
    one = edits.extract(g, core, max_gap=5, gap_rounds=1)
    assert nodes(one) == [1, 2, 3, 4, 6, 7] and names(one) == ["a", "b:0-1", "b:11-12", "c", "d:1-2", "e:0-1", "e:2-5"]
    two = edits.extract(g, core, max_gap=5)
    assert nodes(two) == [1, 2, 3, 4, 6, 7, 9] and names(two) == ["a", "b:0-1", "b:11-12", "c", "d:1-3", "e"]
    assert nodes(edits.extract(g, core)) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert {(r.from_id, r.from_rev, r.to_id, r.to_rev) for r in plain.edges.collect()} == {(1, False, 2, False), (2, False, 3, False), (3, False, 4, False)}


def test_ranges_come_out_alone_and_widened(spark, g):
    r = spark.createDataFrame([(1, 1, 3), (2, 3, 5), (2, 4, 6), (4, 9, 12)], "path_id long, start long, end long")
    x = edits.extract(g, ranges=r, max_gap=5)
    # Both ranges of b widen to node 5; d's lies past its end, so d is left out, as are a and b elsewhere.
    assert nodes(x) == [2, 3, 5, 6, 7, 9] and names(x) == ["a:1-3", "b:1-11", "c", "e"]
    assert {r.path_name: (r.step_count, r.length_bp) for r in x.path_lengths().collect()} == {"a:1-3": (2, 2), "b:1-11": (1, 10), "c": (5, 7), "e": (3, 5)}
    turned = edits.extract(g, ranges=spark.createDataFrame([(1, 1, 3)], "path_id long, start long, end long"), inverse=True, max_gap=0)
    assert nodes(turned) == [1, 4] and names(turned) == ["a:0-1", "a:3-4", "b:0-1", "b:11-12", "d:1-2"]


def test_growth_by_base_pairs_id_range_and_graph_range(spark, g):
    # The neighbours of 8 are 1 and 9, two base pairs in all; then those of 1 and 9.
    assert nodes(edits.extract(g, ids(spark, 8), context_bp=2, max_gap=0)) == [1, 8, 9]
    assert nodes(edits.extract(g, ids(spark, 8), context_bp=3, max_gap=0)) == [1, 2, 5, 6, 7, 8, 9]
    assert nodes(edits.extract(g, ids(spark, 2, 5), full_range=True, max_gap=0)) == [2, 3, 4, 5]
    assert nodes(edits.extract(g, pangenome=(5, 13), max_gap=0)) == [5]
    assert nodes(edits.extract(g, pangenome=(4, 14), max_gap=0)) == [4, 5, 6]
    assert nodes(edits.extract(g, pangenome=(4, 14), inverse=True, max_gap=0)) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert nodes(edits.extract(g, ids(spark), ranges=None, inverse=True, max_gap=0)) == []
    with pytest.raises(ValueError, match="not by both"):
        edits.extract(g, ids(spark, 1), context_steps=1, context_bp=1)


def test_laced_paths_stay_whole(spark, g):
    lace = g.paths.where("path_name IN ('b', 'c')").select("path_id")
    x = edits.extract(g, ids(spark, 1, 2, 3, 4), max_gap=0, lace=lace)
    assert names(x) == ["a", "b", "c", "d:1-2"] and nodes(x) == [1, 2, 3, 4, 10, 11]
    seq = {r.node_id: r.seq for r in x.nodes.collect()}
    assert seq[10] == "G" * 10 and seq[11] == "G" + "TTT" + "G"  # node 5 is C and walked in reverse
    pid = {r.path_id: r.path_name for r in x.paths.collect()}
    walk = {}
    for r in sorted(x.steps.collect(), key=lambda r: r.step_rank):
        walk.setdefault(pid[r.path_id], []).append((r.node_id, r.is_rev, r.pos))
    assert walk["b"] == [(1, False, 0), (10, False, 1), (4, False, 11)] and walk["c"] == [(2, False, 0), (11, False, 1), (3, False, 6)]
    assert {(1, 10), (10, 4), (2, 11), (11, 3)} <= {(r.from_id, r.to_id) for r in x.edges.collect()}


def test_order_of_the_unrolled_graph(spark):
    """Bubbles in any numbering come out so that no edge goes back; a circle keeps all its nodes."""
    chain = [(5, 2), (5, 7), (2, 1), (7, 1), (1, 6), (1, 4), (6, 3), (4, 3)]
    nth = {r.node_id: r.nth for r in order.dagified(make(spark, dict.fromkeys(range(1, 8), 2), [(a, False, b, False) for a, b in chain])).collect()}
    assert sorted(nth.values()) == list(range(7)) and all(nth[a] < nth[b] for a, b in chain)
    nth = {r.node_id: r.nth for r in order.dagified(make(spark, {1: 1, 2: 1, 3: 1}, [(1, False, 2, False), (2, False, 3, True), (3, True, 1, False)])).collect()}
    assert sorted(nth) == [1, 2, 3] and sorted(nth.values()) == [0, 1, 2]
