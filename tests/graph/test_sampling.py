import pytest
from pyspark.sql import functions as F
from test_gfa import BUBBLE, load, spelled

from pathloom.operators import sampling
from pathloom.operators.edges import missing_edges
from pathloom.streaming import events


@pytest.fixture
def bubble(spark, tmp_path):
    return load(spark, tmp_path, BUBBLE)


def test_covers(bubble):
    bare = bubble.with_(paths=bubble.paths.limit(0), steps=bubble.steps.limit(0))
    cover, walks = sampling.path_cover(bare, 4), sampling.random_cover(bare, 3.0, seed=5)
    assert missing_edges(cover).count() == missing_edges(walks).count() == 0
    assert cover.depths().where("depth = 0").count() == 0
    assert walks.steps.count() >= 30
    again = sampling.random_cover(bare, 3.0, seed=5)
    assert sorted(map(str, again.steps.collect())) == sorted(map(str, sampling.random_cover(bare, 3.0, seed=5).steps.collect()))
    assert sampling.path_cover(bare, 4).paths.count() == 8


def test_private_paths(bubble):
    made = sampling.private_paths(bubble, epsilon=1.0, target_depth=2.0, seed=3)
    shared = {(5, 6), (6, 8), (8, 9)}
    pairs = made.step_pairs().select("node_id", "node_id2", "is_rev").collect()
    assert pairs and all((r.node_id, r.node_id2) in shared or (r.node_id2, r.node_id) in shared and r.is_rev for r in pairs)
    assert sorted(map(str, made.steps.collect())) == sorted(map(str, sampling.private_paths(bubble, epsilon=1.0, target_depth=2.0, seed=3).steps.collect()))


def test_private_walks_follow_whole_walks(spark, tmp_path):
    """A-B on two paths and B-C on two others give no walk A-B-C."""
    text = "".join(f"S\t{i}\tA\n" for i in (1, 2, 3)) + "L\t1\t+\t2\t+\t0M\nL\t2\t+\t3\t+\t0M\n" + "P\ta\t1+,2+\t*\nP\tb\t1+,2+\t*\nP\tc\t2+,3+\t*\nP\td\t2+,3+\t*\n"
    made = sampling.private_paths(load(spark, tmp_path, text), epsilon=1.0, target_depth=20.0, seed=1)
    assert {r.step_count for r in made.path_lengths().collect()} == {2}


def test_normalize(spark, tmp_path):
    text = "S\t1\tAC\nS\t2\tGGT\nS\t3\tGGA\nS\t4\tTT\nL\t1\t+\t2\t+\t0M\nL\t1\t+\t3\t+\t0M\nL\t2\t+\t4\t+\t0M\nL\t3\t+\t4\t+\t0M\nP\ta\t1+,2+,4+\t*\nP\tb\t1+,3+,4+\t*\n"
    g = load(spark, tmp_path, text)
    want = spelled(g)
    n = sampling.normalize(g)
    assert spelled(n) == want and missing_edges(n).count() == 0
    assert n.nodes.agg(F.sum("len")).first()[0] == 8 and n.nodes.count() == 4
    assert {r.path_id: r.seq for r in sampling.spelled_paths(n).collect()} == want


def test_nearest_reference(bubble):
    ref = bubble.paths.where("path_name = 'target'")
    rows = {r.node_id: (r.ref_offset, r.steps) for r in sampling.nearest_reference(bubble, bubble.nodes, ref).collect()}
    assert rows[3] == (0, 0) and rows[6] == (2, 0) and rows[7] == (2, 1) and rows[1] == (0, 1) and 10 not in rows


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 7).alias("user_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.windowed_depth(events.read_events(spark, f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("depth_windows").start()
    q.processAllAvailable()
    q.stop()
    batch = events.windowed_depth(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(str, spark.table("depth_windows").collect())) == sorted(map(str, batch.collect()))


def test_nearest_reference_beyond_many_short_nodes(spark, tmp_path):
    """The radius in bases alone ends the search."""
    n = 105
    text = "".join(f"S\t{i}\tA\n" for i in range(1, n + 1)) + "".join(f"L\t{i}\t+\t{i + 1}\t+\t0M\n" for i in range(1, n)) + "P\tr\t1+\t*\n"
    g = load(spark, tmp_path, text)
    last = g.nodes.where(f"node_id = {n}")
    assert [(r.ref_offset, r.steps) for r in sampling.nearest_reference(g, last, g.paths).collect()] == [(0, n - 1)]
    assert sampling.nearest_reference(g, last, g.paths, radius=n - 2).isEmpty()
