import heapq
import random

import pytest
from test_strong import tarjan

from pathloom.operators import structure as S
from pathloom.operators import traverse as T
from pathloom.plans.graph import Graph, canonical_edges, with_pan_pos


def make(spark, lengths, edges):
    """A graph without paths from node lengths and (from, from_rev, to, to_rev)."""
    nodes = with_pan_pos(spark.createDataFrame([(i, "ACGT"[i % 4] * n, i - 1) for i, n in lengths.items()], "node_id long, seq string, rank long"))
    e = canonical_edges(spark.createDataFrame(list(edges), "from_id long, from_rev boolean, to_id long, to_rev boolean"))
    return Graph(nodes, e, spark.createDataFrame([], "path_id long, path_name string"), spark.createDataFrame([], "path_id long, step_rank int, node_id long, is_rev boolean, len long, pos long"))


def handles(edges):
    out = set()
    for a, ar, b, br in edges:
        out |= {(2 * (a - 1) + ar, 2 * (b - 1) + br), (2 * (b - 1) + (not br), 2 * (a - 1) + (not ar))}
    return out


def random_graph(seed, n, m, strands=True):
    rng = random.Random(seed)
    lengths = {i: rng.randint(1, 4) for i in range(1, n + 1)}
    flip = lambda: strands and rng.random() < 0.3
    return lengths, {(rng.randint(1, n), flip(), rng.randint(1, n), flip()) for _ in range(m)}


def side_by_side(*graphs):
    """Graphs as one, their nodes numbered on."""
    lengths, edges = {}, set()
    for more, e in graphs:
        at = len(lengths)
        lengths |= {at + i: n for i, n in more.items()}
        edges |= {(at + a, ar, at + b, br) for a, ar, b, br in e}
    return lengths, edges


def test_strong_nodes_and_cycles(spark):
    lengths, edges = side_by_side(*[random_graph(seed, n, m) for seed, n, m in ((1, 12, 12), (2, 20, 22), (3, 15, 30), (4, 6, 5), (5, 6, 7))])
    g = make(spark, lengths, edges)
    want = {i: i for i in lengths}
    for c in tarjan(sorted(handles(edges))):
        ids = {h // 2 + 1 for h in c}
        want |= {i: min(ids) for i in ids}
    assert {r.node_id: r.component for r in S.strong_nodes(g).collect()} == want
    on = {h for c in tarjan(sorted(handles(edges))) for h in c} | {a for a, b in handles(edges) if a == b}
    assert {r.h for r in T.handles_on_cycles(g).collect()} == on


def brute_nice(lengths, edges):
    """Kahn's peeling from the nodes without edges on their left, orientations checked on the way."""
    ways = handles(edges)
    out_of, into = {}, {}
    for a, b in ways:
        out_of.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    parts, seen = [], set()
    for i in lengths:
        if i not in seen:
            part, todo = set(), [i]
            while todo:
                v = todo.pop()
                if v not in part:
                    part.add(v)
                    todo += [w // 2 + 1 for h in (2 * v - 2, 2 * v - 1) for w in out_of.get(h, ())]
            seen |= part
            parts.append(part)
    result = {}
    for part in parts:
        heads = {v for v in part if not into.get(2 * v - 2)}
        left, active, found, ok = {2 * v - 2: 0 for v in heads}, [2 * v - 2 for v in heads], len(heads), True
        while active and ok:
            for w in out_of.get(active.pop(), ()):
                if w ^ 1 in left:
                    ok = False
                    break
                left[w] = left.get(w, len(into[w])) - 1
                if left[w] == 0:
                    active.append(w)
                    found += 1
        result[min(part)] = len(heads) if ok and found == len(part) else 0
    return result


def test_nice_components(spark):
    rng = random.Random(0)
    lengths, edges, at = {}, set(), 1
    for _ in range(40):  # small components: chains and bubbles, some turned, some closed to a circle
        k = rng.randint(1, 5)
        turned = {at + i: rng.random() < 0.25 for i in range(k)}
        lengths |= dict.fromkeys(range(at, at + k), 2)
        for i in range(k - 1):
            edges.add((at + i, turned[at + i], at + i + 1, turned[at + i + 1]))
            if i + 2 < k and rng.random() < 0.4:
                edges.add((at + i, turned[at + i], at + i + 2, turned[at + i + 2]))
        if rng.random() < 0.3:
            edges.add((at + k - 1, turned[at + k - 1], at, rng.random() < 0.5))
        at += k
    g = make(spark, lengths, edges)
    got = {r.component: r for r in S.nice_components(g).collect()}
    want = brute_nice(lengths, edges)
    assert sum(map(bool, want.values())) > 5 and not all(want.values())
    assert {c: r.heads if r.nice else 0 for c, r in got.items()} == want
    o = {r.node_id: r for r in S.orientations(g).collect()}
    assert all(r.oriented == got[r.component].oriented for r in o.values())
    for a, ar, b, br in edges:
        if o[a].oriented:
            assert (ar != o[a].flip) == (br != o[b].flip)


def test_a_moebius_strip_has_no_orientation(spark):
    g = make(spark, {1: 1, 2: 1, 3: 1, 4: 1}, [(1, False, 2, False), (2, False, 3, False), (3, False, 1, True)])
    assert {r.node_id: (r.component, r.flip, r.oriented) for r in S.orientations(g).collect()} == {1: (1, False, False), 2: (1, False, False), 3: (1, False, False), 4: (4, False, True)}


def walks(lengths, ways, most):
    """All walks of up to ``most`` base pairs, as tuples of nodes."""
    out, todo = set(), [((a,), lengths[a]) for a in lengths]
    while todo:
        w, bp = todo.pop()
        if bp <= most:
            out.add(w)
            todo += [((*w, b), bp + lengths[b]) for b in ways.get(w[-1], ())]
    return out


@pytest.mark.parametrize("k", [1, 6])
def test_dagify_keeps_short_walks(spark, k):
    lengths, edges = side_by_side(*[random_graph(seed, n, m, strands=False) for seed, n, m in ((1, 6, 8), (2, 6, 9), (3, 8, 10), (4, 5, 3), (5, 5, 11))])
    edges = {(a, False, b, False) for a, _, b, _ in edges}
    dag, names = S.dagify(make(spark, lengths, edges), k)
    old = {r.node_id: r.old_id for r in names.collect()}
    e = [(r.from_id, r.to_id) for r in dag.edges.collect()]
    assert not tarjan(e) and all(a != b for a, b in e)
    assert {r.node_id: r.seq for r in dag.nodes.collect()} == {i: "ACGT"[o % 4] * lengths[o] for i, o in old.items()}
    ways, new = {}, {}
    for a, _, b, _ in edges:
        ways.setdefault(a, set()).add(b)
    for a, b in e:
        new.setdefault(a, set()).add(b)
        assert old[b] in ways[old[a]]
    have = {tuple(old[x] for x in w) for w in walks({i: lengths[o] for i, o in old.items()}, new, k)}
    assert have == walks(lengths, ways, k)


def test_dagify_wants_one_strand_and_split_strands_gives_it(spark):
    g = make(spark, {1: 2, 2: 1}, [(1, False, 2, True), (2, True, 1, False)])
    with pytest.raises(ValueError, match="split the strands"):
        S.dagify(g, 1)
    dag, names = S.dagify(T.split_strands(g), 1)
    assert sorted((r.old_id, r.copy) for r in names.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]
    assert dag.edges.count() == 6


def brute_connecting(lengths, edges, start, end, most):
    """Handles on walks of up to ``most`` between two positions, by enumeration."""
    ways = {}
    for a, b in handles(edges):
        ways.setdefault(a, set()).add(b)
    size = lambda h: lengths[h // 2 + 1]
    h1, h2 = (2 * (p[0] - 1) + p[1] for p in (start, end))
    on, used = set(), set()
    todo = [((h1,), -start[2])]
    while todo:
        w, d = todo.pop()  # d: from the start to the last node's first base
        if w[-1] == h2 and d + end[2] <= most and (len(w) > 1 or end[2] >= start[2]):
            on |= set(w)
            used |= set(zip(w, w[1:], strict=False))
        todo += [((*w, t), d + size(w[-1])) for t in ways.get(w[-1], ()) if d + size(w[-1]) <= most]
    return on, used


def test_connecting_graph_equals_enumerated_walks(spark):
    lengths, edges = random_graph(10, 7, 9)
    rng = random.Random(3)
    g = make(spark, lengths, edges)
    for _ in range(4):
        a, b = rng.randint(1, 7), rng.randint(1, 7)
        start, end = (a, rng.random() < 0.5, rng.randrange(lengths[a])), (b, rng.random() < 0.5, rng.randrange(lengths[b]))
        on, used = brute_connecting(lengths, edges, start, end, 9)
        got = S.connecting(g, start, end, 9).collect()
        assert {2 * (r.node_id - 1) + r.is_rev for r in got} == on
        sub = S.connecting_graph(g, start, end, 9)
        assert handles([tuple(r) for r in sub.edges.collect()]) == used | {(y ^ 1, x ^ 1) for x, y in used}
        assert {r.node_id for r in sub.nodes.collect()} == {h // 2 + 1 for h in on}


def test_walk_counts_and_distances_to_ends(spark):
    # 1 forks to 2 and 3, both to 4; 5 joins 4; 4 forks to 6 and 7; 8 stands alone.
    edges = [(a, False, b, False) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4), (5, 4), (4, 6), (4, 7))]
    lengths = {1: 1, 2: 2, 3: 5, 4: 1, 5: 9, 6: 3, 7: 1, 8: 4}
    g = make(spark, lengths, edges)
    assert {r.node_id: r.walks for r in S.count_walks(g).collect()} == {1: 1, 2: 1, 3: 1, 4: 3, 5: 1, 6: 3, 7: 3, 8: 1}
    got = {r.node_id: (r.to_head, r.to_tail) for r in S.distances_to_ends(g, 100).collect()}
    assert got == {1: (0, 4), 2: (1, 2), 3: (1, 2), 4: (3, 1), 5: (0, 2), 6: (4, 0), 7: (4, 0), 8: (0, 0)}
    assert {r.node_id: r.to_head for r in S.distances_to_ends(g, 2).collect()}[6] is None
    with pytest.raises(ValueError, match="cycle"):
        S.count_walks(make(spark, {1: 1, 2: 1}, [(1, False, 2, False), (2, False, 1, False)]))
    # Sixteen ways between hubs, seventeen times.
    many = make(spark, dict.fromkeys(range(1, 290), 1), [e for k in range(17) for m in range(16) for e in ((17 * k + 1, False, 17 * k + 2 + m, False), (17 * k + 2 + m, False, 17 * k + 18, False))])
    assert S.count_walks(many).agg({"walks": "max"}).first()[0] == S.MOST


def test_cycle_search_walks_components_only(spark):
    """One short circle at the end of a long acyclic way."""
    edges = [(i, False, i + 1, False) for i in range(1, 60)] + [(60, False, 58, False)]
    g = make(spark, dict.fromkeys(range(1, 61), 3), edges)
    assert {(r.from_id, r.to_id) for r in T.cycle_edges(g, 9).collect()} == {(60, 58), (58, 59), (59, 60)}
    assert {r.component: r.acyclic for r in T.acyclic_components(g).collect()} == {1: False}


def test_heaviest_ways(spark):
    from pathloom.plans.graph import step_edges, with_positions

    g = make(spark, {1: 1, 2: 1, 3: 1}, [(1, False, 2, False)])
    steps = with_positions(spark.createDataFrame([(1, 0, 1, False), (1, 1, 2, False), (2, 0, 1, False), (2, 1, 2, False), (3, 0, 1, False), (3, 1, 3, True), (4, 0, 2, True), (4, 1, 3, False)], "path_id long, step_rank int, node_id long, is_rev boolean"), g.nodes)
    g = g.with_(edges=step_edges(steps), steps=steps)
    assert {(r.h, r.t) for r in S.heaviest_ways(g).collect()} == {(0, 2), (3, 1), (4, 1), (5, 2)}


def shortest(lengths, ways, seeds):
    best, heap = {}, [(d, h) for h, d in seeds.items()]
    heapq.heapify(heap)
    while heap:
        d, h = heapq.heappop(heap)
        if h not in best:
            best[h] = d
            for t in ways.get(h, ()):
                heapq.heappush(heap, (d + lengths[h // 2 + 1], t))
    return best


def test_distances_to_ends_against_a_plain_search(spark):
    lengths, edges = random_graph(21, 25, 22)
    ways, against, right, left = {}, {}, set(), set()
    for a, b in handles(edges):
        ways.setdefault(a, set()).add(b)
        against.setdefault(b, set()).add(a)
        (right if a % 2 == 0 else left).add(a // 2)
    heads = {h: 0 for i in lengths if i - 1 not in left for h in (2 * i - 2, 2 * i - 1)}
    tails = {h: 0 for i in lengths if i - 1 not in right for h in (2 * i - 2, 2 * i - 1)}
    head, tail = shortest(lengths, ways, heads), shortest(lengths, against, tails)
    assert {r.node_id: (r.to_head, r.to_tail) for r in S.distances_to_ends(make(spark, lengths, edges), 1000).collect()} == {i: (head.get(2 * i - 2), tail.get(2 * i - 2)) for i in lengths}


def test_condensed_order_of_a_cyclic_graph(spark):
    lengths, edges = side_by_side(*[random_graph(seed, n, m, strands=False) for seed, n, m in ((1, 6, 8), (2, 9, 9), (3, 8, 12), (4, 5, 3))])
    edges = {(a, False, b, False) for a, _, b, _ in edges}
    nth = {r.node_id: r.nth for r in S.condensed_order(make(spark, lengths, edges)).collect()}
    assert sorted(nth.values()) == list(range(len(lengths)))
    part = {v: min(c) for c in tarjan([(a, b) for a, _, b, _ in edges]) for v in c}
    assert all(nth[a] < nth[b] or part.get(a, -a) == part.get(b, -b) for a, _, b, _ in edges)
    for c in set(part.values()):
        mine = sorted(nth[v] for v, p in part.items() if p == c)
        assert mine == list(range(mine[0], mine[0] + len(mine)))
