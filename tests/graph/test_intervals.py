import random

from pyspark.sql import functions as F

from pathloom.operators.ranges import near_steps, range_steps


def test_against_all_pairs(spark):
    """Ranges and steps of any length, many stretches long, empty or at the edges; each overlap once."""
    rng = random.Random(4)
    steps, ranges = [], []
    for path in range(3):
        pos = 0
        for rank in range(60):
            n = rng.choice([1, 50, 8191, 8192, 8193, 30_000])
            steps.append((path, rank, rank, False, n, pos))
            pos += n
        for _ in range(40):
            a = rng.choice([0, rng.randrange(pos), rng.choice(steps)[5]])
            ranges.append((path, a, a + rng.choice([0, 1, 100, 8192, 100_000])))
    ranges = sorted(set(ranges))
    s = spark.createDataFrame(steps, "path_id long, step_rank long, node_id long, is_rev boolean, len long, pos long")
    r = spark.createDataFrame(ranges, "path_id long, start long, end long")
    for touching in (False, True):
        got = sorted((x.path_id, x.start, x.end, x.step_rank, x.overlap) for x in range_steps(s, r, touching).collect())
        meets = lambda st, a: st[5] + st[4] >= a if touching else st[5] + st[4] > a
        want = sorted((p, a, z, st[1], max(0, min(st[5] + st[4], z) - max(st[5], a))) for p, a, z in ranges for st in steps if st[0] == p and meets(st, a) and st[5] < z)
        assert got == want and want


def test_one_long_path(spark):
    """A path of 300,000 steps and 30,000 ranges make few pairs that are no overlaps."""
    s = spark.range(300_000).select(F.lit(0).cast("long").alias("path_id"), F.col("id").alias("step_rank"), (F.col("id") * 10).alias("pos"), F.lit(10).cast("long").alias("len"))
    r = spark.range(30_000).select(F.lit(0).cast("long").alias("path_id"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 25).alias("end"))
    assert near_steps(s, r, F.col("start"), F.col("end") - 1).count() < 30_000 * 900
    assert range_steps(s, r).agg(F.count("*"), F.sum("overlap")).first()[:] == (90_000, 30_000 * 25)
