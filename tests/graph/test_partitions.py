"""Large tables are worked on in more partitions than the session's; the session stays as it was."""

from pathloom.operators import paths as P
from pathloom.plans import session as S
from pathloom.sources.tables import graph_of_tables

TABLES = "/root/testdata/sf0.001"


def test_rows_of_a_partition_do_not_grow_with_the_table(spark, monkeypatch):
    want = set(P.bins(graph_of_tables(spark, TABLES), 500).collect())
    monkeypatch.setattr(S, "ROWS_A_PARTITION", 500)
    partitions = "spark.sql.shuffle.partitions"
    before = spark.conf.get(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        g = graph_of_tables(spark, TABLES)
        rows = g.steps.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        assert max(rows) < 1000 < sum(rows)
        assert set(P.bins(g, 500).collect()) == want
        # A setting of the running session holds beside it, the number of partitions stays there.
        assert g.steps.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "false"
        assert spark.conf.get(partitions) == before
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_tables_keep_the_session(spark):
    assert S.session_for(spark, S.ROWS_A_PARTITION) is spark
