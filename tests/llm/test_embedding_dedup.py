import numpy as np
import pytest

from pathloom.llm.embedding_dedup import embedding_links, misses_allowed


def brute(ids, vectors, cosine):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    links = [0] * n
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    x, y = label[i], label[j]
                    label = [min(x, y) if z in (x, y) else z for z in label]
    return links, [min(ids[k] for k in range(n) if label[k] == label[i]) for i in range(n)]


def test_calibration():
    assert misses_allowed(0.5) <= misses_allowed(0.99) <= misses_allowed(0.999) < 16


@pytest.mark.parametrize("slab_rows", [40, 4096])
def test_recall_against_brute_force(spark, slab_rows):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    rows = [b + rng.standard_normal(64) * s for b in base for s in (0, 0.1, 0.2, 0.25, 0.3)]
    vectors = [[float(np.float32(x)) for x in r] for r in rows] + [[float(x) for x in np.float32(rows[0])]] * 3
    ids = [int(x) for x in rng.permutation(len(vectors))]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r for r in embedding_links(df, slab_rows=slab_rows).collect()}
    links, component = brute(ids, vectors, 0.95)
    assert len(got) == len(ids)
    assert all(got[i].n_links <= n for i, n in zip(ids, links, strict=True))
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links)
    same = sum(got[i].component_id == c for i, c in zip(ids, component, strict=True))
    assert same >= 0.99 * len(ids) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [1.0, 2.0, 3.0], [1e-38, 2e-38], [-1.0, -2.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)] + [(None, [1.0, 2.0], "x")], "vec_id long, embedding array<float>, kept string")
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_links(df).collect()}
    for i in (0, 1, 2, 3, 4, 5, 9, 11):
        assert rows[i] == (0, i, True)
    for i in (6, 7, 8, 10):
        assert rows[i] == (4, 6, i == 6)
    assert rows[None] == (4, 6, False)
    assert embedding_links(df.limit(0)).count() == 0


def test_clashing_names(spark):
    rows = [(i, [1.0, float(i // 2)], f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}") for i in range(4)]
    names = ["_ok", "_v", "_k1", "_links", "_component"]
    out = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, ["vec_id", "embedding", *names])).collect()}
    assert [out[i].component_id for i in range(4)] == [0, 0, 2, 2] and {r.n_links for r in out.values()} == {1}
    assert all([out[i][c] for c in names] == list(rows[i][2:]) for i in range(4))
