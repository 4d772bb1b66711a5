"""GFA version 1 in and out, Parquet graphs, and the choice between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.plans.graph import Graph, canonical_edges, with_pan_pos, with_positions
from pathloom.plans.prefix import dense_index
from pathloom.plans.scratch import materialize


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``(at, value)``: the lines of a file, or of a folder's files by name; ``at`` sorts them.

    Spark deals the parts of files to tasks by size, so a task's number tells no order.
    """
    at = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(at.alias("at"), "value")


def _records(spark: SparkSession, path: str) -> DataFrame:
    return lines_in_order(spark, path).where("value <> ''").select("at", F.split("value", "\t").alias("f"))


def line_types(spark: SparkSession, path: str) -> DataFrame:
    """How many lines of each record type a file has."""
    return spark.read.text(path).where("value <> ''").groupBy(F.substring("value", 1, 1).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def read_gfa(spark: SparkSession, path: str, compact: bool = False) -> Graph:
    """Segments, links and paths of a GFA file; overlaps and other records are ignored.

    Segment names must be integers, and links and paths must name segments; anything
    else is an error.  Path numbers follow the file.  ``compact`` renumbers nodes 1, 2, ...
    """
    rows = materialize(_records(spark, path), "gfa")
    kind = lambda k: rows.where(F.col("f")[0] == k)
    node_id = F.when(F.col("f")[1].rlike("^[0-9]+$"), F.col("f")[1].cast("long")).otherwise(F.raise_error(F.concat(F.lit("segment name is not an integer: "), F.col("f")[1])).cast("long"))
    segs = dense_index(kind("S").select("at", node_id.alias("node_id"), F.col("f")[2].alias("seq")), ["at"], "rank")
    nodes = materialize(with_pan_pos(segs.select("node_id", "seq", "rank")), "gfa-nodes")
    links = kind("L").select(F.col("f")[1].cast("long").alias("from_id"), (F.col("f")[2] == "-").alias("from_rev"), F.col("f")[3].cast("long").alias("to_id"), (F.col("f")[4] == "-").alias("to_rev"))
    named = dense_index(kind("P").select("at", F.col("f")[1].alias("path_name"), F.col("f")[2].alias("walk")), ["at"], "nth").select((F.col("nth") + 1).alias("path_id"), "path_name", "walk")
    named = materialize(named, "gfa-paths")
    steps = named.where("walk IS NOT NULL AND walk NOT IN ('', '*')").select("path_id", F.posexplode(F.split("walk", ",")).alias("step_rank", "s"))
    steps = steps.select("path_id", F.col("step_rank").cast("long").alias("step_rank"), F.expr("cast(substring(s, 1, length(s) - 1) AS bigint)").alias("node_id"), F.col("s").endswith("-").alias("is_rev"))
    ends = links.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).union(steps.select("node_id")).distinct()
    if lost := ends.join(nodes, "node_id", "left_anti").head():
        raise ValueError(f"a link or path names a missing segment: {lost[0]}")
    g = Graph(nodes, canonical_edges(links), named.select("path_id", "path_name"), with_positions(steps, nodes))
    if compact:
        from pathloom.operators.edits import compact_ids

        g = compact_ids(g)
    return g


def gfa_lines(g: Graph, annotate: bool = False) -> DataFrame:
    """``(section, key, value)``: the lines of a GFA file; each segment's links follow it.

    ``annotate`` adds depth (``DP``) and base count (``RC``) tags to segments.
    """
    head = g.nodes.sparkSession.createDataFrame([(0, 0, 0, "H\tVN:Z:1.0")], "section int, key long, part int, value string")
    n = g.nodes
    tags = []
    if annotate:
        n = n.join(g.depths(), "node_id")
        tags = [F.concat(F.lit("DP:i:"), F.col("depth").cast("string")), F.concat(F.lit("RC:i:"), (F.col("depth") * F.col("len")).cast("string"))]
    seg = n.select(F.lit(1).alias("section"), F.col("rank").alias("key"), F.lit(0).alias("part"), F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "seq", *tags).alias("value"))
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    link = g.edges.join(g.nodes.select(F.col("node_id").alias("from_id"), "rank"), "from_id").select(
        F.lit(1).alias("section"), F.col("rank").alias("key"), F.lit(1).alias("part"), F.concat_ws("\t", F.lit("L"), F.col("from_id").cast("string"), sign("from_rev"), F.col("to_id").cast("string"), sign("to_rev"), F.lit("0M")).alias("value")
    )
    walk = g.steps.groupBy("path_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step_rank", F.concat(F.col("node_id").cast("string"), sign("is_rev")).alias("s")))), lambda x: x["s"]), ",").alias("walk")
    )
    path = g.paths.join(walk, "path_id", "left").select(F.lit(2).alias("section"), F.col("path_id").alias("key"), F.lit(0).alias("part"), F.concat_ws("\t", F.lit("P"), "path_name", F.coalesce("walk", F.lit("")), F.lit("*")).alias("value"))
    return head.union(seg).union(link).union(path)


def write_gfa(g: Graph, path: str, annotate: bool = False) -> None:
    """Write the lines in order, as a folder of text files that concatenate to the file."""
    gfa_lines(g, annotate).orderBy("section", "key", "part", "value").select("value").write.text(path)


def save_graph(g: Graph, path: str) -> None:
    """A Parquet folder with the four tables."""
    for name in ("nodes", "edges", "paths", "steps"):
        getattr(g, name).write.parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> Graph:
    """A graph from a GFA file (by its ending) or from a Parquet folder."""
    if path.endswith((".gfa", ".gfa.gz")):
        return read_gfa(spark, path)
    return Graph(*[spark.read.parquet(f"{path}/{t}") for t in ("nodes", "edges", "paths", "steps")])


def load_graphs(spark: SparkSession, list_path: str) -> list[Graph]:
    """The graphs that a text file names, one path a line."""
    return [load_graph(spark, r.value.strip()) for r in spark.read.text(list_path).where("trim(value) <> ''").toLocalIterator()]


def path_fasta(g: Graph) -> DataFrame:
    """``(path_id, value)``: header and sequence of each path, one line each."""
    from pathloom.functions.dna import oriented

    s = g.steps.join(g.nodes.select("node_id", "seq"), "node_id").select("path_id", "step_rank", oriented(F.col("seq"), F.col("is_rev")).alias("part"))
    seq = s.groupBy("path_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step_rank", "part"))), lambda x: x["part"]), "").alias("seq"))
    return g.paths.join(seq, "path_id", "left").select("path_id", F.concat(F.lit(">"), "path_name", F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))


def flat_fasta(g: Graph, name: str, width: int = 80) -> DataFrame:
    """``(line, value)``: the whole graph as one sequence, wrapped.

    Each node gives the parts of the lines it lies on, so no task holds the sequence.
    """
    first, last = F.floor(F.col("pan_pos") / width), F.floor((F.col("pan_pos") + F.col("len") - 1) / width)
    n = g.nodes.select("pan_pos", "seq", "len", F.explode(F.sequence(first, last)).alias("line"))
    part = F.expr(f"substring(seq, cast(greatest(0, line * {width} - pan_pos) + 1 AS int), cast(least(pan_pos + len, (line + 1) * {width}) - greatest(pan_pos, line * {width}) AS int))")
    lines = n.groupBy("line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pan_pos", part.alias("p")))), lambda x: x["p"]), "").alias("value"))
    head = g.nodes.sparkSession.createDataFrame([(-1, f">{name}")], "line long, value string")
    return head.union(lines.select("line", "value"))


def write_components(g: Graph, path: str) -> None:
    """One sub-folder a connected component in each of the four tables."""
    from pathloom.operators.edits import explode_components
    from pathloom.operators.summary import components

    for name, table in explode_components(g, materialize(components(g), "components")).items():
        table.write.partitionBy("component").parquet(f"{path}/{name}")


def read_component(spark: SparkSession, path: str, component: int) -> Graph:
    """One component of a folder that :func:`write_components` made."""
    t = {n: spark.read.parquet(f"{path}/{n}").where(F.col("component") == component).drop("component") for n in ("nodes", "edges", "paths", "steps")}
    return Graph(t["nodes"], t["edges"].select("from_id", "from_rev", "to_id", "to_rev"), t["paths"], t["steps"])


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder in whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def sequence_records(sequences: DataFrame, id_col: str, seq_col: str, quality: str | None = None) -> DataFrame:
    """``value``: FASTA records, or FASTQ with one made-up quality letter for all bases."""
    name, seq = F.col(id_col).cast("string"), F.col(seq_col)
    if quality is None:
        return sequences.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"))
    return sequences.select(F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.repeat(F.lit(quality), F.length(seq))).alias("value"))
