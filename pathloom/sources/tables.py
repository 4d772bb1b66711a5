"""A sequence graph over order tables: parts are nodes, orders are paths, lines are steps.

The step order of an order's lines is the order of the whole row, since the line number
alone is not a key.  ``SQL`` states the same tables for a SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.plans.graph import Graph, step_edges, with_pan_pos, with_positions
from pathloom.plans.session import session_for

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: Lines that tie up to here are steps on one node and strand, in whatever order.
LINE_STRAND = LINE[: LINE.index("l_returnflag") + 1]
LETTERS = ("0123456789abcdef", "ACGTACGTACGTACGN")

SQL = f"""
nodes0 AS (SELECT p_partkey + 1 AS node_id, p_size::BIGINT AS len, p_partkey AS rank,
    substr(translate(md5(p_partkey::VARCHAR) || md5('x' || p_partkey::VARCHAR), '{LETTERS[0]}', '{LETTERS[1]}'), 1, p_size) AS seq FROM part),
nodes AS MATERIALIZED (SELECT *, (sum(len) OVER (ORDER BY rank) - len)::BIGINT AS pan_pos FROM nodes0),
paths AS MATERIALIZED (SELECT o_orderkey + 1 AS path_id, n_name || '#' || c_mktsegment || '#' || o_orderkey AS path_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
steps0 AS (SELECT l_orderkey + 1 AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) - 1 AS step_rank,
    l_partkey + 1 AS node_id, l_returnflag = 'R' AS is_rev FROM lineitem),
steps AS MATERIALIZED (SELECT path_id, step_rank, node_id, is_rev, len,
    (sum(len) OVER (PARTITION BY path_id ORDER BY step_rank) - len)::BIGINT AS pos FROM steps0 JOIN nodes USING (node_id)),
pairs AS MATERIALIZED (SELECT * FROM (SELECT s.*, rank, pan_pos, lead(node_id) OVER w AS node_id2, lead(is_rev) OVER w AS is_rev2, lead(s.len) OVER w AS len2,
    lead(rank) OVER w AS rank2, lead(pan_pos) OVER w AS pan_pos2 FROM steps s JOIN nodes USING (node_id, len)
    WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)) WHERE node_id2 IS NOT NULL),
turns AS (SELECT *, (is_rev AND is_rev2) OR ((is_rev OR is_rev2) AND (node_id - 1) * 2 + is_rev::INT > (node_id2 - 1) * 2 + is_rev2::INT) AS turn FROM pairs),
walked AS MATERIALIZED (SELECT path_id, CASE WHEN turn THEN node_id2 ELSE node_id END AS from_id, CASE WHEN turn THEN NOT is_rev2 ELSE is_rev END AS from_rev,
    CASE WHEN turn THEN node_id ELSE node_id2 END AS to_id, CASE WHEN turn THEN NOT is_rev ELSE is_rev2 END AS to_rev FROM turns),
edges AS MATERIALIZED (SELECT DISTINCT from_id, from_rev, to_id, to_rev FROM walked),
half_edges AS MATERIALIZED (SELECT from_id AS node_id, CASE WHEN from_rev THEN 'L' ELSE 'R' END AS side, to_id AS nbr_id, from_rev <> to_rev AS inv FROM edges
    UNION SELECT to_id, CASE WHEN to_rev THEN 'R' ELSE 'L' END, from_id, from_rev <> to_rev FROM edges),
degrees AS MATERIALIZED (SELECT n.node_id, count(side) FILTER (side = 'L') AS deg_l, count(side) FILTER (side = 'R') AS deg_r, count(side) AS degree
    FROM nodes n LEFT JOIN half_edges USING (node_id) GROUP BY n.node_id),
depths AS MATERIALIZED (SELECT n.node_id, count(path_id) AS depth, count(DISTINCT path_id) AS depth_uniq FROM nodes n LEFT JOIN steps USING (node_id) GROUP BY n.node_id),
lengths AS MATERIALIZED (SELECT p.path_id, path_name, count(node_id) AS step_count, coalesce(sum(len), 0)::BIGINT AS length_bp
    FROM paths p LEFT JOIN steps USING (path_id) GROUP BY p.path_id, path_name)
"""


def sequence(key: str):
    """The node sequence that stands for a part: its hashed key in DNA letters."""
    k = F.col(key).cast("string")
    return F.translate(F.concat(F.md5(k.cast("binary")), F.md5(F.concat(F.lit("x"), k).cast("binary"))), *LETTERS)


def walks_of_tables(spark: SparkSession, sf_dir: str, strands: bool = True) -> DataFrame:
    """``(path_id, step_rank, node_id, is_rev)`` of the orders' lines, dealt by path; no node is looked up.

    Without ``strands`` there is no ``is_rev``, and little of a line has to move: lines that
    tie on number and part are steps on one node, in whatever order.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("path_id", F.col("l_orderkey") + 1)
    order = Window.partitionBy("path_id").orderBy(*(LINE_STRAND if strands else ["l_linenumber", "l_partkey"]))
    strand = [(F.col("l_returnflag") == "R").alias("is_rev")] if strands else []
    return line.select("path_id", (F.row_number().over(order) - 1).alias("step_rank"), (F.col("l_partkey") + 1).alias("node_id"), *strand)


def graph_of_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over ``part``, ``orders``, ``customer``, ``nation`` and ``lineitem``.

    What is worked out from it has as many partitions as its lines ask for (:func:`session_for`).
    """
    spark = session_for(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nodes = read("part").select((F.col("p_partkey") + 1).alias("node_id"), F.col("p_partkey").alias("rank"), F.substring(sequence("p_partkey"), 1, 50).alias("whole"), "p_size")
    nodes = with_pan_pos(nodes.select("node_id", F.expr("substring(whole, 1, p_size)").alias("seq"), "rank"))
    owner = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")
    paths = read("orders").join(owner, F.col("o_custkey") == F.col("c_custkey"))
    paths = paths.select((F.col("o_orderkey") + 1).alias("path_id"), F.concat_ws("#", "n_name", "c_mktsegment", F.col("o_orderkey").cast("string")).alias("path_name"))
    steps = with_positions(walks_of_tables(spark, sf_dir), nodes)
    return Graph(nodes, step_edges(steps), paths, steps)


def example_ranges(g: Graph) -> DataFrame:
    """One range of 20 base pairs on each path, some past its end."""
    start = ((F.col("path_id") - 1) % 7).cast("long")
    return g.paths.select("path_id", start.alias("start"), (start + 20).alias("end"), "path_name")


RANGES_SQL = "ranges AS (SELECT path_id, (path_id - 1) % 7 AS start, (path_id - 1) % 7 + 20 AS \"end\", path_name FROM paths)"
