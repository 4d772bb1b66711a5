"""Measures on consecutive steps: link lengths, path distances, feedback and edge depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.plans.graph import Graph, by_step, canonical_edges, handle

ALL = "all_paths"


def _rolled(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates by path name and over all paths."""
    return df.rollup("path_name").agg(F.grouping("path_name").alias("_all"), *aggs).withColumn("path", F.when(F.col("_all") == 1, ALL).otherwise(F.col("path_name"))).drop("_all", "path_name")


def _named_pairs(g: Graph, *extra: str) -> DataFrame:
    return g.step_pairs(*extra).join(g.paths.select("path_id", "path_name"), "path_id")


def gap_links(g: Graph) -> DataFrame:
    """Step pairs whose second node is the next larger of the path's own nodes: ``(path_id, step_rank)``."""
    own = g.steps.select("path_id", "node_id").distinct().join(g.nodes.select("node_id", "rank"), "node_id")
    following = own.withColumn("next_id", F.lead("node_id").over(Window.partitionBy("path_id").orderBy("rank"))).select("path_id", "node_id", "next_id")
    return g.step_pairs().join(following, ["path_id", "node_id"]).where("node_id2 = next_id").select("path_id", "step_rank")


def mean_links_length(g: Graph, skip_gap_links: bool = False) -> DataFrame:
    """Mean distance that links span, in nodes and in base pairs, by path and over all.

    A link leaves a step at the end it is read towards and enters the next at the other.
    Gap links, if skipped, add no length but count as links.
    """
    p = _named_pairs(g, "rank", "pan_pos")
    a, b = F.col("rank") + (~F.col("is_rev")).cast("long"), F.col("rank2") + F.col("is_rev2").cast("long")
    pa = F.col("pan_pos") + F.when(F.col("is_rev"), 0).otherwise(F.col("len"))
    pb = F.col("pan_pos2") + F.when(F.col("is_rev2"), F.col("len2")).otherwise(0)
    p = p.withColumn("gap", F.lit(0))
    if skip_gap_links:
        p = p.drop("gap").join(gap_links(g).withColumn("g", F.lit(1)), ["path_id", "step_rank"], "left").withColumn("gap", F.coalesce("g", F.lit(0)))
    counted = F.lit(1) - F.col("gap")
    out = _rolled(p, F.sum(F.abs(b - a) * counted).alias("s"), F.sum(F.abs(pb - pa) * counted).alias("t"), F.count(F.lit(1)).alias("num_links"), F.sum("gap").cast("long").alias("num_gap_links"))
    return out.select("path", (F.col("s") / F.col("num_links")).alias("in_node_space"), (F.col("t") / F.col("num_links")).alias("in_nucleotide_space"), "num_links", "num_gap_links")


def mean_links_length_2d(g: Graph, layout: DataFrame) -> DataFrame:
    """Mean Euclidean length of links in a layout ``(node_id, end, x, y)``."""
    at = lambda k: layout.select(F.col("node_id").alias(f"node_id{k}"), F.col("end").alias(f"end{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    p = _named_pairs(g).withColumn("end1", F.col("is_rev").cast("int")).withColumn("end2", F.col("is_rev2").cast("int")).withColumnRenamed("node_id", "node_id1")
    p = p.join(at(1), ["node_id1", "end1"]).join(at(2), ["node_id2", "end2"])
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    return _rolled(p, F.sum(F.sqrt(dx * dx + dy * dy)).alias("s"), F.count(F.lit(1)).alias("num_links")).select("path", F.round(F.col("s") / F.col("num_links"), 6).alias("in_2d_space"), "num_links")


def path_node_distance(g: Graph, penalize_orientation: bool = False) -> DataFrame:
    """Sum of node distances along paths over path size; steps back weigh three, turns two more.

    The end of a non-empty path adds one node and its last node's length, so a perfectly
    sorted path has 1.
    """
    p = g.step_pairs("rank", "pan_pos")
    w = F.when(F.col("rank2") < F.col("rank"), 3).otherwise(1)
    turned = (F.col("is_rev") != F.col("is_rev2")).cast("int") if penalize_orientation else F.lit(0)
    weight = w + turned * 2
    links = p.groupBy("path_id").agg(
        F.sum(F.abs(F.col("rank2") - F.col("rank")) * weight).alias("n"), F.sum(F.abs(F.col("pan_pos2") - F.col("pan_pos")) * weight).alias("b"), F.sum((w == 3).cast("int")).alias("back"), F.sum(turned).alias("turns")
    )
    size = g.steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("len").alias("nucleotides"), F.max_by("len", "step_rank").alias("last"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = size.join(links, "path_id", "left").join(g.paths.select("path_id", "path_name"), "path_id")
    out = _rolled(
        each, F.sum(zero("n") + 1).alias("n"), F.sum(zero("b") + F.col("last")).alias("b"), F.sum("nodes").alias("nodes"), F.sum("nucleotides").alias("nucleotides"), F.sum(zero("back")).alias("num_penalties"), F.sum(zero("turns")).alias("num_turns")
    )
    return out.select("path", (F.col("n") / F.col("nodes")).alias("in_node_space"), (F.col("b") / F.col("nucleotides")).alias("in_nucleotide_space"), "nodes", "nucleotides", "num_penalties", "num_turns")


def feedback_arcs(g: Graph) -> DataFrame:
    """Links that run against the storage order, by path and over all."""
    back = (~F.col("is_rev") & ~F.col("is_rev2") & (F.col("rank") >= F.col("rank2"))) | (F.col("is_rev") & F.col("is_rev2") & (F.col("rank") <= F.col("rank2")))
    return _rolled(_named_pairs(g, "rank"), F.sum(back.cast("int")).cast("long").alias("n"))


def reversing_joins(g: Graph) -> DataFrame:
    """Links between steps of different strands, by path and over all."""
    return _rolled(_named_pairs(g), F.sum((F.col("is_rev") != F.col("is_rev2")).cast("int")).cast("long").alias("n"))


def links_length_per_nucleotide(g: Graph) -> DataFrame:
    """One row: the base pairs that links jump over, for each base pair of all paths."""
    p = g.step_pairs("pan_pos").join(gap_links(g).withColumn("gap", F.lit(True)), ["path_id", "step_rank"], "left")
    # Where a link leaves and enters on the graph axis; nodes are entered at the end read first.
    h0, h1 = F.col("pan_pos"), F.col("pan_pos") + F.col("len")
    i0, i1 = F.col("pan_pos2"), F.col("pan_pos2") + F.col("len2")
    up, fh, fi = F.col("node_id") <= F.col("node_id2"), ~F.col("is_rev"), ~F.col("is_rev2")
    jump = (
        F.when(fh & fi, F.when(up, F.when(F.col("gap").isNull(), i0 - h1).otherwise(0)).otherwise(h1 - i0))
        .when(fh, F.when(up, i1 - h1).otherwise(h1 - i1))
        .when(fi, F.when(up, i0 - h0).otherwise(h1 - i0 + F.col("len2")))
        .otherwise(F.when(up, i1 - h0 + F.col("len")).otherwise(h0 - i1))
    )
    total = g.steps.agg(F.sum("len").alias("bp"))
    return p.agg(F.sum(jump).alias("jumps")).crossJoin(total).select((F.col("jumps") / F.col("bp")).alias("links_length_per_nuc"))


def edge_walks(g: Graph) -> DataFrame:
    """How often paths walk each canonical edge: ``(from_id, from_rev, to_id, to_rev, n)``."""
    nxt = g.steps.select(F.col("node_id").alias("from_id"), F.col("is_rev").alias("from_rev"), F.lead("node_id").over(by_step()).alias("to_id"), F.lead("is_rev").over(by_step()).alias("to_rev")).where("to_id IS NOT NULL")
    # Walks are counted as they are read, then turned: few rows are left to turn.
    counted = nxt.groupBy("from_id", "from_rev", "to_id", "to_rev").agg(F.count(F.lit(1)).alias("n"))
    a, b = handle(F.col("from_id"), F.col("from_rev")), handle(F.col("to_id"), F.col("to_rev"))
    turn = (F.col("from_rev") & F.col("to_rev")) | ((F.col("from_rev") | F.col("to_rev")) & (a > b))
    pick = lambda x, y: F.when(turn, y).otherwise(x)
    turned = counted.select(
        pick(F.col("from_id"), F.col("to_id")).alias("f"), pick(F.col("from_rev"), ~F.col("to_rev")).alias("fr"), pick(F.col("to_id"), F.col("from_id")).alias("t"), pick(F.col("to_rev"), ~F.col("from_rev")).alias("tr"), "n"
    )
    return turned.groupBy(F.col("f").alias("from_id"), F.col("fr").alias("from_rev"), F.col("t").alias("to_id"), F.col("tr").alias("to_rev")).agg(F.sum("n").alias("n"))


def missing_edges(g: Graph) -> DataFrame:
    """Consecutive steps that the graph has no edge for, as canonical edges."""
    nxt = g.steps.select(F.col("node_id").alias("from_id"), F.col("is_rev").alias("from_rev"), F.lead("node_id").over(by_step()).alias("to_id"), F.lead("is_rev").over(by_step()).alias("to_rev"))
    return canonical_edges(nxt.where("to_id IS NOT NULL")).join(g.edges, ["from_id", "from_rev", "to_id", "to_rev"], "left_anti")


def neighbour_counts(g: Graph) -> DataFrame:
    """``(node_id, dir, nbr, n)``: handles before (``P``) and after (``N``) a node's steps, and how often."""
    s = g.steps.select("node_id", F.lead(handle(F.col("node_id"), F.col("is_rev"))).over(by_step()).alias("nxt"), F.lag(handle(F.col("node_id"), F.col("is_rev"))).over(by_step()).alias("prv"))
    both = F.explode(F.array(F.struct(F.lit("N").alias("dir"), F.col("nxt").alias("nbr")), F.struct(F.lit("P").alias("dir"), F.col("prv").alias("nbr")))).alias("e")
    return s.select("node_id", both).select("node_id", "e.dir", "e.nbr").where("nbr IS NOT NULL").groupBy("node_id", "dir", "nbr").agg(F.count(F.lit(1)).alias("n"))


def _as_pairs(counts: DataFrame) -> DataFrame:
    own = handle(F.col("node_id"), F.lit(False))
    first, second = F.when(F.col("dir") == "N", own).otherwise(F.col("nbr")), F.when(F.col("dir") == "N", F.col("nbr")).otherwise(own)
    return counts.select(first.alias("from_handle"), second.alias("to_handle")).distinct()


def edges_outside_depth(g: Graph, least: int, most: int) -> DataFrame:
    """Handle pairs whose step count is under ``least`` or over ``most`` (0: no limit)."""
    n = F.col("n")
    out = (F.lit(bool(least)) & (n < least)) | (F.lit(bool(most)) & (n > most))
    return _as_pairs(neighbour_counts(g).where(out))


def edges_beyond_best(g: Graph, best: int) -> DataFrame:
    """Handle pairs to drop so that each node keeps its ``best`` most walked, per direction.

    Of equal counts one stands for all, the largest handle, as counts are the key of the
    ranking; a node's rank limit counts the ties.
    """
    c = neighbour_counts(g)
    w = Window.partitionBy("node_id", "dir")
    one = c.withColumn("size", F.count(F.lit(1)).over(w)).groupBy("node_id", "dir", "n").agg(F.max("nbr").alias("nbr"), F.first("size").alias("size"))
    ranked = one.withColumn("i", F.row_number().over(w.orderBy("n")) - 1)
    return _as_pairs(ranked.where(F.col("size") - F.col("i") > best))
