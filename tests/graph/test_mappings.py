from test_extract import LENGTHS, WALKS
from test_structure import make

from pathloom.operators import context, edits
from pathloom.plans.graph import Graph, step_edges, with_positions


def small(spark):
    g = make(spark, LENGTHS, [])
    steps = with_positions(spark.createDataFrame([(p, k, abs(n), n < 0) for p, (_, w) in WALKS.items() for k, n in enumerate(w)], "path_id long, step_rank int, node_id long, is_rev boolean"), g.nodes)
    return Graph(g.nodes, step_edges(steps), spark.createDataFrame([(p, n) for p, (n, _) in WALKS.items()], "path_id long, path_name string"), steps)


def test_mappings_as_files(spark):
    g = small(spark)
    rows = [  # path c on a: two that go on, one that leaves a gap, one on the other strand, a second best
        (3, 0, 1, 1, 0, 1, 1.0, False, 1.0, 1), (3, 1, 2, 1, 1, 2, 0.5, False, 1.5, 1), (3, 2, 5, 1, 3, 4, 0.5, False, 1.0, 1), (3, 5, 7, 1, 4, 5, 0.5, True, 1.0, 1), (3, 5, 7, 2, 0, 1, 0.25, False, 1.0, 2),
    ]
    m = spark.createDataFrame(rows, "query_id long, query_start long, query_end long, target_id long, target_start long, target_end long, jaccard double, inverted boolean, self_coverage double, nth int")
    lines = sorted(r.value for r in context.paf_lines(context.paf(g, m)).collect())
    assert lines[0] == "c\t7\t0\t1\t+\ta\t4\t0\t1\t0\t1\t255\tid:f:100.0\tjc:f:1.0\tsc:f:1.0\tnb:i:1"
    assert lines[1].startswith("c\t7\t1\t2\t+\ta\t4\t1\t2\t0\t1\t255\tid:f:59.4534") and lines[2].split("\t")[10] == "3" and len(lines) == 5
    b = context.bedpe(g, m).orderBy("query_start", "nth").collect()
    assert tuple(b[3]) == ("c", 5, 7, "a", 4, 5, 0.5, "-", 1.0, 1) and b[4].target_name == "b"
    order = context.gene_order(g, m)
    assert [tuple(r) for r in order.orderBy("place").collect()] == [("c", 0, "a", 0, 2, 0, 2, False), ("c", 1, "a", 2, 5, 3, 4, False), ("c", 2, "a", 5, 7, 4, 5, True), ("c", 3, "b", 5, 7, 0, 1, False)]
    assert [r.value for r in context.gene_order_lines(order).collect()] == ["c\ta:0-2,a:3-4,a:4-5,b:0-1"]
    assert [tuple(r) for r in context.gene_arrows(order, schematic=True).orderBy("start").collect()] == [("c", "a", 0, 100, 1), ("c", "a", 150, 250, 1), ("c", "a", 300, 400, 0), ("c", "b", 450, 550, 1)]
    assert [tuple(r)[2:4] for r in context.gene_arrows(order).orderBy("start", "end").collect()] == [(0, 2), (2, 5), (5, 7), (5, 7)]


def test_prune_edges(spark):
    g = small(spark)
    walked = {(r.from_id, r.to_id): r for r in g.edges.collect()}
    assert (1, 2) in walked and (7, 6) in walked
    left = edits.prune(g, min_depth=2, edge_depth=True)
    assert left.edges.count() == 0 and left.nodes.count() == 9 and [r.path_name for r in left.paths.collect()] == ["f"]
    both = Graph(g.nodes, g.edges, g.paths.union(spark.createDataFrame([(7, "a2")], "path_id long, path_name string")), g.steps.unionByName(g.steps.where("path_id = 1").selectExpr("7L AS path_id", "step_rank", "node_id", "is_rev", "len", "pos")))
    kept = edits.prune(both, min_depth=2, edge_depth=True)
    assert {(r.from_id, r.to_id) for r in kept.edges.collect()} == {(1, 2), (2, 3), (3, 4)} and sorted(r.path_name for r in kept.paths.collect()) == ["a", "a2", "f"]
    # Nodes 1 and 6 have three ways on; of those walked once the one to the largest handle goes.
    best = edits.prune(both, best_edges=2)
    assert {(r.from_id, r.to_id) for r in both.edges.collect()} - {(r.from_id, r.to_id) for r in best.edges.collect()} == {(1, 9), (6, 9)}
    assert sorted(r.path_name for r in best.paths.collect()) == ["a", "a2", "b", "c", "f"]
