import math

import pytest
from pyspark.sql import functions as F
from test_structure import make

from pathloom.functions import numbers as N
from pathloom.operators import order


def test_djb2_and_distances(spark):
    texts = ["", "A", "ACGT", "GATTACA" * 9, "é", None]

    def plain(t, bits):
        h = 5381
        for c in t.encode():
            h = (h * 33 + c) % (1 << bits)
        return h

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.djb2(F.col("t"), 32).alias("a"), N.djb2(F.col("t")).alias("b")).collect()
    assert [(r.a, None if r.b is None else int(r.b)) for r in rows] == [(None, None) if t is None else (plain(t, 32), plain(t, 64)) for t in texts]
    d = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.01,)], "j double").select(N.mash_distance(F.col("j")).alias("d"), N.percent_identity(F.col("j")).alias("i"), N.modulo_power(F.lit(29), 8).alias("m")).collect()
    assert [round(r.d, 9) for r in d] == [1, 0, round(-math.log(1 / 1.5), 9), 1] and d[1].i == 100 and d[0].m == 5
    with pytest.raises(ValueError):
        N.modulo_power(F.lit(1), 12)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_hilbert_curve(spark, levels):
    """Each step of the curve goes to a neighbour, each cell is met once, and places come back."""
    p = spark.range(4**levels).select("id", N.hilbert_point(F.col("id"), levels).alias("p")).select("id", "p.x", "p.y")
    rows = p.withColumn("back", N.hilbert_index(F.col("x"), F.col("y"), levels)).orderBy("id").collect()
    assert {(r.x, r.y) for r in rows} == {(x, y) for x in range(2**levels) for y in range(2**levels)}
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:], strict=False)) and all(r.back == r.id for r in rows)
    if levels == 2:  # the well-known table
        assert [(r.x, r.y) for r in rows] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (2, 2), (2, 3), (3, 3), (3, 2), (3, 1), (2, 1), (2, 0), (3, 0)]


def test_layout_starts(spark):
    g = make(spark, {i: 3 for i in range(1, 41)}, [(i, False, i + 1, False) for i in range(1, 40)])
    for kind in "durgh":
        rows = order.layout_start(g, kind, 7).collect()
        assert len({(r.node_id, r.end) for r in rows}) == 80 and rows == order.layout_start(g, kind, 7).collect()
        if kind in "du":
            assert all(r.x == 3 * (r.node_id - 1 + r.end) for r in rows)
        if kind == "u":
            assert all(0 <= r.y <= 80**0.5 for r in rows)
        if kind == "r":
            assert all(0 <= r.x <= 120 and 0 <= r.y <= 120 for r in rows)
    assert order.curve_levels(80) == 7 and order.curve_levels(64) == 6 and order.curve_levels(1) == 1
