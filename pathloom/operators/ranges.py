"""Path ranges against steps: interval joins, means over ranges, positions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.plans.graph import Graph, by_step


#: Base pairs of a path (as a power of two) that share a join key.
STRETCH_BITS = 13
#: Most paths of an oriented node in one list.
LISTED = 1024


def near_steps(steps: DataFrame, others: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each row of ``others`` with the steps of its path that may reach into ``low..high``, every such pair once.

    Steps and rows are joined by the path and the stretches of 8192 bp that they touch, so
    one long path is many keys, and a pair meets in the first stretch that both touch.
    The caller still tests the interval.
    """
    stretch = lambda x: F.shiftright(x.cast("long"), STRETCH_BITS)
    s = steps.withColumn("_first", stretch(F.col("pos"))).withColumn("_b", F.explode(F.sequence("_first", stretch(F.col("pos") + F.col("len")))))
    o = others.withColumn("_from", stretch(low)).withColumn("_b", F.explode(F.sequence("_from", F.greatest("_from", stretch(high)))))
    return s.join(o, ["path_id", "_b"]).where(F.col("_b") == F.greatest("_first", "_from")).drop("_b", "_first", "_from")


def range_steps(steps: DataFrame, ranges: DataFrame, touching: bool = False) -> DataFrame:
    """Each range with the steps it overlaps: its columns, the step's, and ``overlap`` in bp.

    ``touching`` also takes a step that ends where the range starts.
    """
    r = ranges.withColumnsRenamed({c: f"{c}_r" for c in ("len", "pos") if c in ranges.columns})
    after = (F.col("pos") + F.col("len") >= F.col("start")) if touching else (F.col("pos") + F.col("len") > F.col("start"))
    hit = near_steps(steps, r, F.col("start"), F.col("end") - 1).where(after & (F.col("pos") < F.col("end")))
    return hit.withColumn("overlap", F.greatest(F.lit(0), F.least(F.col("pos") + F.col("len"), F.col("end")) - F.greatest("pos", "start")))


def mean_over_ranges(g: Graph, ranges: DataFrame, values: DataFrame) -> DataFrame:
    """``(path_id, start, end, mean)``: ``values(node_id, v)`` weighted by overlap over the range's length.

    A range that starts past its path's end has no row; one that ends past it is still
    divided by its own length.
    """
    hit = range_steps(g.steps, ranges.select("path_id", "start", "end")).join(values, "node_id")
    return hit.groupBy("path_id", "start", "end").agg(F.sum(F.col("v") * F.col("overlap")).alias("s")).select("path_id", "start", "end", (F.col("s") / (F.col("end") - F.col("start"))).alias("mean"))


def whole_paths(g: Graph) -> DataFrame:
    """A range for each non-empty path."""
    return g.path_lengths().where("length_bp > 0").select("path_id", F.lit(0).cast("long").alias("start"), F.col("length_bp").alias("end"))


def considered(g: Graph, values: DataFrame, subset: DataFrame | None) -> DataFrame:
    """Node values, zero on nodes that no path of the subset visits."""
    if subset is None:
        return values
    seen = g.steps.join(subset.select("path_id"), "path_id", "left_semi").select("node_id").distinct().withColumn("on", F.lit(1))
    return values.join(seen, "node_id", "left").select("node_id", F.when(F.col("on") == 1, F.col("v")).otherwise(0).alias("v"))


def mean_depth(g: Graph, ranges: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Mean depth of each range, counting the steps of the subset's paths only."""
    d = (g if subset is None else g.select_paths(subset)).depths()
    return mean_over_ranges(g, ranges, d.select("node_id", F.col("depth").alias("v"))).withColumnRenamed("mean", "mean_depth")


def mean_degree(g: Graph, ranges: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Mean degree of each range; nodes no considered path visits count zero."""
    v = considered(g, g.degrees().select("node_id", F.col("degree").alias("v")), subset)
    return mean_over_ranges(g, ranges, v).withColumnRenamed("mean", "mean_degree")


def locate(g: Graph, positions: DataFrame) -> DataFrame:
    """Graph position of each path position ``(path_id, offset)``: ``node_id, is_rev, node_offset``.

    Offsets past the end have no row.
    """
    p = positions.withColumnRenamed("offset", "at")
    return near_steps(g.steps, p, F.col("at"), F.col("at")).where("pos <= at AND at < pos + len").withColumn("node_offset", F.col("at") - F.col("pos")).drop("len", "pos", "step_rank").withColumnRenamed("at", "offset")


def depth_at(g: Graph, positions: DataFrame) -> DataFrame:
    """Depth and distinct paths at path positions."""
    return locate(g, positions).join(g.depths(), "node_id").select("path_id", "offset", "depth", "depth_uniq")


def degree_at(g: Graph, positions: DataFrame) -> DataFrame:
    """Degree and distinct paths at path positions."""
    return locate(g, positions).join(g.degrees(), "node_id").join(g.depths(), "node_id").select("path_id", "offset", "degree", F.col("depth_uniq").alias("degree_uniq"))


def pangenome_position(g: Graph, positions: DataFrame) -> DataFrame:
    """One-based graph position of one-based path positions; inside a reversed step it is mirrored."""
    p = positions.withColumn("offset", F.col("offset") - 1)
    inside = F.when(F.col("is_rev"), F.col("len") - F.col("node_offset") - 1).otherwise(F.col("node_offset"))
    at = locate(g, p).join(g.nodes.select("node_id", "len", "pan_pos"), "node_id")
    return at.select("path_id", (F.col("offset") + 1).alias("offset"), (F.col("pan_pos") + inside + 1).alias("pan_position"))


def base_vector(g: Graph, values: DataFrame) -> DataFrame:
    """``(path_id, vector)``: the node value of each base along each path, space separated."""
    s = g.steps.join(values, "node_id")
    rows = F.sort_array(F.collect_list(F.struct("step_rank", F.array_join(F.array_repeat(F.col("v").cast("string"), F.col("len").cast("int")), " ").alias("t"))))
    return s.groupBy("path_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("vector"))


def self_counts(g: Graph) -> DataFrame:
    """``(path_id, node_id, visits)``."""
    return g.steps.groupBy("path_id", "node_id").agg(F.count(F.lit(1)).alias("visits"))


def windows(g: Graph, inside: DataFrame, merge: int = 0, tips: int = 0) -> DataFrame:
    """``(path_id, start, end)``: maximal runs of steps on nodes of ``inside(node_id)``.

    Runs less than ``merge`` base pairs apart are one window (so 0 merges none).  With
    ``tips`` only windows that touch an end of their path stay.
    """
    s = g.steps.join(inside.select("node_id").distinct(), "node_id", "left_semi")
    run = F.col("step_rank") - F.row_number().over(by_step())
    islands = s.withColumn("run", run).groupBy("path_id", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("end"))
    w = Window.partitionBy("path_id").orderBy("start")
    apart = F.coalesce((F.col("start") - F.lag("end").over(w)) >= merge, F.lit(True))
    out = islands.withColumn("new", apart.cast("int")).withColumn("group", F.sum("new").over(w)).groupBy("path_id", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    if tips:
        out = out.join(g.path_lengths().select("path_id", "length_bp"), "path_id").where("start = 0 OR end = length_bp")
    return out.select("path_id", "start", "end")


def bounded(values: DataFrame, least: int, most: int, out: bool = False) -> DataFrame:
    """Nodes whose ``v`` lies within the bounds, or outside."""
    ok = F.col("v").between(least, most)
    return values.where(~ok if out else ok).select("node_id")


def overlapping_paths(g: Graph, ranges: DataFrame) -> DataFrame:
    """``(path_id, start, end, other_id)``: other paths that walk an oriented node of the range.

    A node that ends where the range starts belongs to it.
    """
    own = ["path_id", "start", "end"]
    hit = range_steps(g.steps, ranges.select(own), touching=True).select(*own, "node_id", "is_rev").distinct()
    # The paths of an oriented node as lists of numbers of four bytes, with what is above them beside: a range gets lists, not a row for each path.
    at = ["node_id", "is_rev", "above"]
    visits = g.steps.select("path_id", "node_id", "is_rev").distinct().withColumn("above", F.shiftright("path_id", 31))
    visits = visits.withColumn("below", F.col("path_id").bitwiseAND((1 << 31) - 1).cast("int"))
    nth = F.row_number().over(Window.partitionBy(at).orderBy("below")) - 1
    lists = visits.withColumn("part", F.floor(nth / LISTED)).groupBy(*at, "part").agg(F.collect_list("below").alias("below")).drop("part")
    met = hit.join(lists, ["node_id", "is_rev"]).select(*own, "above", "below").repartition("path_id")
    other = F.shiftleft("above", 31).bitwiseOR(F.col("one").cast("long"))
    return met.select(*own, "above", F.explode("below").alias("one")).select(*own, other.alias("other_id")).where("path_id <> other_id").distinct()


def nodes_in_ranges(g: Graph, ranges: DataFrame) -> DataFrame:
    """Nodes that any range touches."""
    return range_steps(g.steps, ranges.select("path_id", "start", "end")).select("node_id").distinct()


def nodes_in_pangenome_range(g: Graph, start: int, end: int) -> DataFrame:
    """Nodes that reach into ``[start, end]`` of the graph's own axis, both ends included."""
    return g.nodes.where((F.col("pan_pos") + F.col("len") >= start) & (F.col("pan_pos") <= end)).select("node_id")


def shifted_bed(bed: DataFrame, windows_: DataFrame) -> DataFrame:
    """BED rows that lie in a named sub-path ``(base, ref_start, ref_end)``, in its coordinates."""
    hit = bed.join(windows_, bed["name"] == windows_["base"]).where("ref_start <= start AND end <= ref_end")
    return hit.select(F.concat("base", F.lit(":"), F.col("ref_start").cast("string"), F.lit("-"), F.col("ref_end").cast("string")).alias("name"), (F.col("start") - F.col("ref_start")).alias("start"), (F.col("end") - F.col("ref_start")).alias("end"), "label")


def annotate_nodes(g: Graph, features: DataFrame) -> DataFrame:
    """``(node_id, annotation, color)`` from features ``(path_id, start, end, label)`` on paths.

    A node is annotated by every feature whose closed interval meets the node's, labels
    in order and joined by ``;``; the colour is taken from their hash.
    """
    hit = near_steps(g.steps, features, F.col("start"), F.col("end")).where("pos <= end AND pos + len >= start")
    text = F.array_join(F.array_sort(F.collect_set("label")), ";")
    return hit.groupBy("node_id").agg(text.alias("annotation")).withColumn("color", color_of(F.col("annotation")))


def color_of(text: Column) -> Column:
    """``#rrggbb`` from bytes 24, 8 and 16 of the SHA-256."""
    h = F.sha2(text, 256)
    return F.concat(F.lit("#"), F.substring(h, 49, 2), F.substring(h, 17, 2), F.substring(h, 33, 2))


def flatten(g: Graph) -> DataFrame:
    """Each step as a range of the graph's own axis."""
    s = g.steps.join(g.nodes.select("node_id", "pan_pos"), "node_id").join(g.paths, "path_id")
    return s.select(F.col("pan_pos").alias("start"), (F.col("pan_pos") + F.col("len")).alias("end"), "path_name", F.when(F.col("is_rev"), "-").otherwise("+").alias("strand"), "step_rank")


def lift_over(source: Graph, target: Graph, positions: DataFrame) -> DataFrame:
    """Positions ``(path_id, offset)`` of paths that both graphs name: where they lie in the target."""
    named = positions.join(source.paths.select("path_id", "path_name"), "path_id").select("path_name", "offset")
    common = named.join(target.paths.select(F.col("path_id"), "path_name"), "path_name")
    return locate(target, common.select("path_id", "offset", "path_name")).select("path_name", "offset", "node_id", "is_rev", "node_offset")
