"""How much of each haplotype is core, shell, cloud or missing from the reference.

Anyone who has built a graph from many assemblies asks next what each of them contributes.
The job reads a graph, counts on how many samples each node lies, and writes a row for each
path: its length, its mean depth and mean number of samples, the base pairs it has on core,
shell and cloud nodes and on nodes of the reference sample, and its runs of steps that no
reference path visits.

    python -m jobs.haplotype_report --config jobs/haplotype_report.json --input graph.gfa --kind gfa

Rows are written as Parquet under ``OUTPUT/paths``, a folder for each sample.  A run replaces
what an earlier one wrote; equal input gives equal rows.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.options import command_line, log_to_stderr, logger, options
from pathloom.functions.names import sample_of
from pathloom.operators.paths import composition, groups_by, share_class
from pathloom.plans.graph import Graph
from pathloom.plans.scratch import drop, materialize
from pathloom.sources.gfa import load_graph, read_gfa
from pathloom.sources.tables import graph_of_tables, walks_of_tables

DEFAULTS = {
    "input": ...,  # a folder of tables, a GFA file or a graph's Parquet folder, by "kind"
    "kind": "parquet",
    "output": ...,
    "reference": ...,  # the sample that counts as reference
    "delim": "#",
    "fields": 1,  # of a path name, up to which it names the sample
    "core": 0.95,  # a node is core from this share of samples on,
    "cloud": 0.15,  # and cloud below this one
    "least_run": 1,  # base pairs from which a run outside the reference counts
}
SCHEMA = (
    "path_id long, path_name string, step_count long, length_bp long, mean_depth double, mean_samples double, core_bp long, shell_bp long, cloud_bp long, "
    "reference_bp long, novel_runs long, novel_bp long, longest_novel_bp long, sample string"
)
LOG = logger("haplotype_report")


def _graph(spark: SparkSession, kind: str, path: str) -> Graph:
    if kind == "tables":
        g = graph_of_tables(spark, path)
        return g.with_(steps=walks_of_tables(g.nodes.sparkSession, path, strands=False))  # nor are positions asked for
    if kind == "gfa":
        return read_gfa(spark, path)
    if kind == "parquet":
        return load_graph(spark, path)
    raise ValueError(f"kind is tables, gfa or parquet, not {kind}")


def report(g: Graph, reference: str, delim: str, fields: int, core: float, cloud: float, least_run: int) -> DataFrame:
    """A row for each path, those without steps too (zero base pairs, null means)."""
    samples = groups_by(g, sample_of(F.col("path_name"), delim, fields))
    total = samples.select("grp").distinct().count()
    parts = composition(g, samples, reference, lambda n: share_class(n / F.lit(max(total, 1)), core, cloud), ["core", "shell", "cloud"], least_run)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = g.paths.select("path_id", "path_name", sample_of(F.col("path_name"), delim, fields).alias("sample")).join(parts, "path_id", "left")
    return out.select(
        "path_id", "path_name", zero("step_count"), zero("length_bp"), "mean_depth", "mean_samples", zero("core_bp"), zero("shell_bp"), zero("cloud_bp"), zero("reference_bp"), zero("novel_runs"), zero("novel_bp"), zero("longest_novel_bp"), "sample"
    )


def read_report(spark: SparkSession, output: str) -> DataFrame:
    """What the job wrote."""
    return spark.read.schema(SCHEMA).parquet(f"{output}/paths")


def run(spark: SparkSession, given: dict) -> dict:
    """Do the job; gives the number of rows read and written."""
    o = options(DEFAULTS, given)
    g = _graph(spark, o["kind"], o["input"])
    # Paths and nodes are read several times; where they come from joins or text, once is enough.
    kept = [] if o["kind"] == "parquet" else [materialize(t, "report") for t in (g.nodes, g.paths)]
    if kept:
        g = g.with_(nodes=kept[0], paths=kept[1])
    n = {"nodes": g.nodes.count(), "paths": g.paths.count()}
    LOG.info("read %s: %d nodes, %d paths", o["input"], n["nodes"], n["paths"])
    rows = report(g, o["reference"], o["delim"], o["fields"], o["core"], o["cloud"], o["least_run"])
    # One task for each sample (or more, by size) writes its folder, not every task every folder.
    rows.hint("rebalance", "sample").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("sample").parquet(f"{o['output']}/paths")
    for table in kept:
        drop(table)
    done = read_report(spark, o["output"]).agg(F.coalesce(F.sum("step_count"), F.lit(0)).alias("steps"), F.count(F.lit(1)).alias("written")).first()
    n |= done.asDict()
    LOG.info("wrote %s/paths: %d rows of %d steps", o["output"], n["written"], n["steps"])
    return n


def main(argv: list[str]) -> int:
    """The command line."""
    log_to_stderr()
    o = command_line(argv, DEFAULTS, __doc__.splitlines()[0])
    spark = SparkSession.builder.appName("haplotype_report").getOrCreate()
    try:
        run(spark, o)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
