import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_gfa import BUBBLE, load, spelled

from pathloom.operators import alignment, context, edits, order, traverse
from pathloom.operators.edges import mean_links_length, missing_edges


@pytest.fixture
def bubble(spark, tmp_path):
    return load(spark, tmp_path, BUBBLE)


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_untangle_known_answer(bubble):
    name = {r.path_id: r.path_name for r in bubble.paths.collect()}
    got = sorted((name[r.query_id], r.query_start, r.query_end, name[r.target_id], r.target_start, r.target_end, r.jaccard, r.inverted, r.self_coverage, r.nth) for r in context.untangle(bubble, bubble.paths, bubble.paths).collect())
    segments = {"target": [0, 2, 5, 11, 14], "query1": [0, 2, 5, 6], "query2": [0, 4], "query3": [0, 3, 5, 11, 14]}
    cover = {("target", 2): 2.0, ("target", 5): 1.5}
    assert got == sorted((p, a, z, p, a, z, 1.0, False, cover.get((p, a), 1.0), 1) for p, cuts in segments.items() for a, z in zip(cuts, cuts[1:]))
    merged = context.merge_mappings(context.untangle(bubble, bubble.paths, bubble.paths)).collect()
    assert sorted((name[r.query_id], r.query_start, r.query_end) for r in merged) == sorted((p, 0, c[-1]) for p, c in segments.items())


def test_kmers_against_walks(bubble):
    ways = {}
    for r in traverse.follow(bubble).collect():
        ways.setdefault(r.h, []).append(r.t)
    seq = {r.h: r.seq for r in traverse.oriented_nodes(bubble).collect()}

    def grow(h, text, k):
        text += seq[h]
        if len(text) >= k:
            yield text[:k]
        else:
            for t in ways.get(h, ()):
                yield from grow(t, text, k)

    for k in (2, 5):
        want = sorted((x, h // 2 + 1, bool(h & 1), o) for h, s in seq.items() for o in range(len(s)) for x in ([s[o : o + k]] if len(s) - o >= k else itertools.chain.from_iterable(grow(t, s[o:], k) for t in ways.get(h, ()))))
        assert sorted(map(tuple, traverse.kmers(bubble, k).collect())) == want
        assert traverse.unique_kmers(bubble, k).first()[0] == len({w[0] for w in want})


def test_cycles_distances_unitigs(spark, tmp_path, bubble):
    assert {r.component: r.acyclic for r in traverse.acyclic_components(bubble).collect()} == {1: False, 10: True}
    loop = traverse.cycle_edges(bubble, 10, 5).collect()
    assert [(r.from_id, r.to_id) for r in loop] == [(6, 6)]
    broken = traverse.break_cycles(bubble, 10, 5)
    assert broken.edges.count() == 10 and sorted(r.path_name for r in broken.paths.collect()) == ["query1", "query2", "query3"]
    assert {r.component: r.acyclic for r in traverse.acyclic_components(broken).collect()} == {1: True, 10: True}
    d = {r.h: r.steps for r in traverse.distances(bubble, spark.createDataFrame([(0,)], "h long"), 3).collect()}
    assert d == {0: 0, 2: 1, 4: 1, 6: 2, 8: 2, 10: 3}
    assert traverse.unitigs(bubble).count() == 9
    assert {(r.from_id, r.to_id) for r in traverse.furcation_edges(bubble, 2, 0).collect()} >= {(1, 2), (1, 3), (2, 4), (2, 5)}


def test_orders_and_grooming(bubble):
    want = spelled(bubble)
    place = {r.node_id: r.nth for r in order.topological(bubble).collect()}
    assert sorted(place.values()) == list(range(10))
    assert all(place[r.from_id] < place[r.to_id] for r in bubble.edges.collect() if r.from_id != r.to_id)
    for f in (order.two_way, order.breadth_first, order.depth_first, order.reverse, order.shuffled, order.by_id):
        assert sorted(r.nth for r in f(bubble).collect()) == list(range(10))
    assert [r.node_id for r in order.by_paths(bubble, bubble.paths.where("path_name = 'target'")).orderBy("nth").limit(5).collect()] == [3, 5, 6, 8, 9]
    odd = edits.renumber(bubble, bubble.nodes.select("node_id", (F.col("node_id") - 1).alias("nth"), (F.col("node_id") % 3 == 0).alias("flip")))
    tidy = order.groom(odd, odd.paths)
    assert spelled(tidy) == want and missing_edges(tidy).count() == 0 and tidy.steps.where("is_rev").count() == 0


def test_path_guided_sort_improves_links(spark, tmp_path):
    n = 120
    ids = list(range(1, n + 1))
    shuffled = ids[:]
    np.random.default_rng(1).shuffle(shuffled)
    text = "".join(f"S\t{i}\tACGTAC\n" for i in shuffled) + "".join(f"L\t{i}\t+\t{i + 1}\t+\t0M\n" for i in ids[:-1]) + "P\tp\t" + ",".join(f"{i}+" for i in ids) + "\t*\nP\tq\t" + ",".join(f"{i}+" for i in ids[10:90]) + "\t*\n"
    g = load(spark, tmp_path, text)
    g = edits.renumber(g, order.shuffled(g, 3))
    quality = lambda x: mean_links_length(x).where("path = 'all_paths'").first().in_node_space
    done = order.sort(g, "Y")
    assert quality(g) > 20 and quality(done) < 2.2
    assert sorted(map(len, spelled(done).values())) == [480, 720]
    flat = order.layout_2d(done, iterations=15, per_step=5)
    assert flat.count() == 2 * n
    assert order.tension(done, flat).count() == n and order.path_tension(done, flat, 100).where("nuc_dist >= 100").count() > 0


@pytest.mark.parametrize("a,b", [("ACACACTA", "AGCACACA"), ("", "ACG"), ("TGTTACGG", "GGTTGACTACGAACG"), ("AAAA", "TTTT")])
def test_alignment_against_plain_table(a, b):
    for scores in ((2, -1, -1), (3, -3, -2)):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (scores[0] if a[i - 1] == b[j - 1] else scores[1]), h[i - 1][j] + scores[2], h[i][j - 1] + scores[2])
        assert alignment.score_matrix(a, b, *scores).tolist() == h
        s, i, j, x, y = alignment.align(a, b, *scores)
        assert alignment.best_score(a, b, *scores) == (s, i, j)
        assert s == max(map(max, h)) == h[i][j] and x.replace("-", "") in a and y.replace("-", "") in b


def test_alignment_rows(spark):
    df = spark.createDataFrame([(1, "TGTTACGG", "GGTTGACTACGAACG"), (2, None, "A")], "k long, a string, b string")
    rows = {r.k: r for r in alignment.local_alignments(df, match=3, mismatch=-3, gap=-2).collect()}
    short = {r.k: (r.score, r.end_a, r.end_b) for r in alignment.local_alignments(df, match=3, mismatch=-3, gap=-2, traced=False).collect()}
    assert short == {k: (r.score, r.end_a, r.end_b) for k, r in rows.items()}
    assert (rows[1].aligned_a, rows[1].aligned_b, rows[1].score) == ("GTT-AC", "GTTGAC", 13) and rows[2].score == 0


def test_break_points(bubble):
    name = {r.path_id: r.path_name for r in bubble.paths.collect()}
    rows = {(name[r.target_id], name[r.query_id], r.direction): r for r in context.break_points(bubble, bubble.paths.where("path_name = 'target'"), bubble.paths).collect()}
    front = rows["target", "query1", "front"]
    assert (front.query_rank, front.target_rank) in {(2, 2), (2, 3)} and ("target", "query2", "front") not in rows
    assert rows["target", "query3", "back"].query_rank == 5 and rows["target", "query3", "back"].target_rank == 5
    assert all(0 <= r.jaccard <= 1 for r in rows.values())


def test_long_cycles_of_short_nodes(spark, tmp_path):
    """Base pairs alone bound the search: 66 nodes of one base lie within a size of 100."""
    n = 66
    text = "".join(f"S\t{i}\tA\n" for i in range(1, n + 1)) + "".join(f"L\t{i}\t+\t{i % n + 1}\t+\t0M\n" for i in range(1, n + 1))
    g = load(spark, tmp_path, text)
    assert traverse.cycle_edges(g, 100).count() == n
