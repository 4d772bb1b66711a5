import random

import pytest

from pathloom.plans.strong import strong_components, topological_keys


def tarjan(edges):
    """Components of two or more nodes, by the textbook search without recursion."""
    ways = {}
    for a, b in edges:
        ways.setdefault(a, []).append(b)
        ways.setdefault(b, [])
    order, low, stack, on, out = {}, {}, [], set(), []
    for start in ways:
        if start in order:
            continue
        work = [(start, iter(ways[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(ways[w])))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    found = set()
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        found.add(w)
                        if w == v:
                            break
                    if len(found) > 1:
                        out.append(frozenset(found))
    return set(out)


def sets_of(rows):
    found = {}
    for r in rows:
        assert r.node not in found.setdefault(r.component, set())
        found[r.component].add(r.node)
    return {frozenset(s) for s in found.values()}


def check(spark, edges):
    rows = strong_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    assert sets_of(rows) == tarjan([(a, b) for a, b in edges if a is not None and b is not None])


def test_random_graphs(spark):
    """Many graphs of every density, side by side."""
    rng, edges = random.Random(1), []
    for k in range(40):
        n = rng.randint(2, 40)
        edges += [(100 * k + rng.randrange(n), 100 * k + rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.2, 2, 4])))]
    check(spark, edges)


def test_ten_thousand_nodes_in_blocks(spark):
    """Circles of many sizes on a long way, with short cuts between them."""
    rng, edges, at = random.Random(5), [], 0
    while at < 10_000:
        n = rng.choice([1, 2, 3, 40, 700])
        edges += [(at + i, at + i + 1) for i in range(n)]
        if rng.random() < 0.6:
            edges.append((at + n - 1, at))
        at += n
    edges += [(a, a + rng.randint(1, 30)) for a in rng.sample(range(9000), 600)]
    check(spark, edges)


def test_special_cases(spark):
    two_ways = [(i, (i + d) % 8) for i in range(8) for d in (1, 3)] + [(10 + i, 10 + (i + d) % 8) for i in range(8) for d in (1, 2)] + [(3, 11), (4, 12)]
    circle, chain = [(30 + i, 30 + (i + 1) % 9) for i in range(9)], [(40 + i, 41 + i) for i in range(50)]
    # Every node of the first part has two ways in and on: only colours help.
    check(spark, two_ways + circle + chain + [(101, 102), (102, 101), (103, 103), (None, 4), (4, None), (102, 103), (101, 102)])
    assert strong_components(spark.createDataFrame([], "a long, b long")).count() == 0


def in_order(spark, edges):
    rows = topological_keys(spark.createDataFrame(edges, "a long, b long")).collect()
    place = {r.node: k for k, r in enumerate(sorted(rows, key=lambda r: r.key))}
    assert set(place) == {x for e in edges for x in e} and len(place) == len(rows) == len({tuple(r.key) for r in rows})
    return all(place[a] < place[b] for a, b in edges)


def test_topological_keys_of_random_graphs(spark):
    rng, edges = random.Random(7), []
    for k in range(25):
        n = rng.randint(2, 30)
        name = rng.sample(range(100), n)
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(int(n * rng.choice([0.7, 1, 1.5, 4])))}
        edges += [(1000 * k + name[a], 1000 * k + name[b]) for a, b in pairs]
    # Long chains, bubbles on a chain, and a node with many ways.
    ids = rng.sample(range(50_000, 60_000), 3000)
    edges += list(zip(ids[:1500], ids[1:1501], strict=True))
    for i in range(1600, 2400, 4):
        edges += [(ids[i], ids[i + 1]), (ids[i], ids[i + 2]), (ids[i + 1], ids[i + 4]), (ids[i + 2], ids[i + 4])]
    edges += [(ids[2500], x) for x in ids[2600:2700]] + [(x, ids[2501]) for x in ids[2600:2700]]
    assert in_order(spark, edges)


def test_topological_keys_refuse_circles(spark):
    for edges in ([(1, 2), (2, 3), (3, 1)], [(1, 1)], [(0, 1), (1, 2), (2, 1), (2, 3)]):
        with pytest.raises(ValueError, match="circle"):
            topological_keys(spark.createDataFrame(edges, "a long, b long"))
    assert topological_keys(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_are_not_written_anew_where_nobody_joins(spark, monkeypatch):
    """Every node has two ways in and two on: no round of joins, colours find the circle at once."""
    from pathloom.plans import strong

    def nothing(*_):
        raise AssertionError("all edges moved for no join")

    monkeypatch.setattr(strong, "_merged", nothing)
    e = spark.createDataFrame([(x, (x + k) % 40) for x in range(40) for k in (1, 7)], "a long, b long")
    assert {(r.node, r.component) for r in strong.strong_components(e).collect()} == {(x, 0) for x in range(40)}


def test_colours_spread_only_from_where_they_are_new(spark):
    """A long circle with a tail: the largest node's colour goes round, smaller ones stop where it has been."""
    from pathloom.plans import strong

    e = spark.createDataFrame([(x, (x + 1) % 12) for x in range(12)] + [(3, 50), (50, 51)], "a long, b long")
    start = spark.createDataFrame([(x, x) for x in [*range(12), 50, 51]], "node long, colour long")
    assert {(r.node, r.colour) for r in strong._spread(start, e).collect()} == {(x, 11) for x in range(12)} | {(50, 50), (51, 51)}


def test_no_table_of_many_rows_goes_through_the_driver(spark, monkeypatch):
    """Tables of a few bytes a row, which the optimizer takes to be small, move on both sides instead."""
    from pathloom.plans import scratch, strong

    plans = []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return scratch.materialize(df, name)

    monkeypatch.setattr(strong, "materialize", noted)
    for module in (strong, scratch):
        monkeypatch.setattr(module, "FEW", -1)
    two_ways = [(i, (i + d) % 6) for i in range(6) for d in (1, 2)]
    found = strong_components(spark.createDataFrame(two_ways + [(i, i + 1) for i in range(20, 27)] + [(27, 25), (3, 20)], "a long, b long"))
    assert {(r.node, r.component) for r in noted(found, "result").collect()} == {(x, 0) for x in range(6)} | {(x, 25) for x in (25, 26, 27)}
    keys = noted(topological_keys(spark.createDataFrame([(i, i + d) for i in range(9) for d in (1, 3)], "a long, b long")), "keys")
    place = {r.node: i for i, r in enumerate(keys.orderBy("key").collect())}
    assert len(place) == 12 and all(place[i] < place[i + d] for i in range(9) for d in (1, 3))
    joins = [(name, p) for name, p in plans if "Join" in p]
    assert len(joins) > 10 and not [name for name, p in joins if "BroadcastHashJoin" in p]


def test_both_directions_of_an_edge_come_from_one_pass(spark):
    from pathloom.operators.traverse import follow
    from pathloom.sources.tables import graph_of_tables

    g = graph_of_tables(spark, "/root/testdata/sf0.001")
    way = follow(g)
    e = g.edges.collect()
    h = lambda i, r: (i - 1) * 2 + r
    want = {(h(x.from_id, x.from_rev), h(x.to_id, x.to_rev)) for x in e} | {(h(x.to_id, not x.to_rev), h(x.from_id, not x.from_rev)) for x in e}
    rows = way.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert "Union" not in way._jdf.queryExecution().executedPlan().toString()
