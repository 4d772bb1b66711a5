"""Orders: the memory of dense components, and work on all cores."""

import tracemalloc
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathloom.operators import order
from pathloom.plans.graph import Graph, with_pan_pos


def test_ways_of_a_dense_component_take_a_few_words_an_edge():
    rng = np.random.default_rng(3)
    nodes = np.unique(rng.integers(1, 10**9, 4000))
    a, b = (2 * (rng.choice(nodes, 100_000) - 1) + rng.integers(0, 2, 100_000) for _ in "ab")
    tracemalloc.start()
    out, into = order._ways(nodes, a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(a)
    want = {(int(x), int(y)) for x, y in zip(a, b)} | {(int(y) ^ 1, int(x) ^ 1) for x, y in zip(a, b)}
    handle = lambda p: int(2 * (nodes[p // 2] - 1) + p % 2)
    assert {(handle(h), handle(t)) for h in range(2 * len(nodes)) for t in out(h)} == want
    assert into.sum() == len(want) and all(out(h) == sorted(out(h)) for h in range(0, 8000, 97))


def test_a_component_is_never_in_memory_as_a_whole():
    rng = np.random.default_rng(4)
    nodes = np.unique(rng.integers(1, 10**9, 1000))
    a, b = (2 * (rng.choice(nodes, 200_000) - 1) + rng.integers(0, 2, 200_000) for _ in "ab")
    out, into = order._ways(nodes, a, b)
    handle = lambda p: 2 * (nodes[p // 2] - 1) + p % 2
    rows = [(7, 0, int(n), []) for n in nodes] + [(7, 1, int(handle(h)), handle(np.array(out(h), dtype=np.int64)).tolist()) for h in range(2 * len(nodes))]
    rows += [(9, 0, 5, []), (9, 1, 8, [8]), (9, 1, 9, [9])]  # another component begins within a batch
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["component", "kind", "h", "t"])
    parts = groupby(order._by_component(table.to_batches(50)), lambda part: part[0])
    tracemalloc.start()
    component, mine = next(parts)
    with order._Stored(part[1:] for part in mine) as stored:
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert component == 7 and (stored.nodes == nodes).all() and stored.into.tolist() == into.tolist()
        assert all(stored.ways(h) == out(h) for h in range(2 * len(nodes)))
    assert peak < 2 * len(a), peak  # both readings of its ways take 16 bytes an edge as numbers of eight bytes
    component, mine = next(parts)
    with order._Stored(part[1:] for part in mine) as stored:
        assert component == 9 and stored.nodes.tolist() == [5] and stored.ways(0) == [0] and stored.ways(1) == [1] and stored.into.tolist() == [1, 1]


def test_curve_points_are_worked_out_on_all_cores(spark):
    nodes = with_pan_pos(spark.range(0, 3000, 1, 1).select((F.col("id") + 1).alias("node_id"), F.lit("AC").alias("seq"), F.col("id").alias("rank")))
    g = Graph(nodes, spark.createDataFrame([], "from_id long"), spark.createDataFrame([], "path_id long"), spark.createDataFrame([], "path_id long"))
    found = order.layout_start(g, "h").select(F.spark_partition_id().alias("p"), "node_id", "end").collect()
    assert len({(r.node_id, r.end) for r in found}) == 6000 and len({r.p for r in found}) >= spark.sparkContext.defaultParallelism
