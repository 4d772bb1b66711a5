"""Whole-graph figures: totals, base content, sequence classes, self loops, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.names import sample_of
from pathloom.plans.components import connected_components
from pathloom.plans.graph import Graph, handle
from pathloom.plans.scratch import unless_many


def graph_summary(g: Graph) -> DataFrame:
    """One row: base pairs, nodes, edges, paths and steps."""
    one = g.nodes.agg(F.sum("len").alias("length"), F.count(F.lit(1)).alias("nodes"))
    for name, table in (("edges", g.edges), ("paths", g.paths), ("steps", g.steps)):
        one = one.crossJoin(table.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one


def depth_summary(g: Graph) -> DataFrame:
    """One row: nodes, graph bp, steps, path bp, mean depth by node and by base pair."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("node_count"), F.sum("len").alias("graph_length"))
    s = g.steps.agg(F.count(F.lit(1)).alias("step_count"), F.sum("len").alias("path_length"))
    return n.crossJoin(s).select(
        "node_count", "graph_length", "step_count", "path_length", (F.col("step_count") / F.col("node_count")).alias("mean_node_depth"), (F.col("path_length") / F.col("graph_length")).alias("mean_graph_depth")
    )


def degree_summary(g: Graph) -> DataFrame:
    """One row: nodes, edges (half the degrees, rounded down), mean, least and greatest degree."""
    d = g.degrees().agg(F.count(F.lit(1)).alias("node_count"), F.sum("degree").alias("s"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))
    return d.select("node_count", F.floor(F.col("s") / 2).alias("edge_count"), (F.col("s") / F.col("node_count")).alias("avg_degree"), "min_degree", "max_degree")


def self_loops(g: Graph) -> DataFrame:
    """Edges from a node to itself, in all and by distinct node."""
    return g.edges.where("from_id = to_id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("from_id").alias("unique_nodes"))


def base_content(g: Graph) -> DataFrame:
    """How often each letter occurs in the node sequences."""
    # Letters are counted within each row first, so no row is exploded into its bases.
    letters = F.explode(F.array_distinct(F.split("seq", ""))).alias("base")
    counted = g.nodes.select("seq", letters).where("base <> ''")
    return counted.select("base", (F.length("seq") - F.length(F.expr("replace(seq, base, '')"))).alias("n")).groupBy("base").agg(F.sum("n").alias("n"))


def sequence_classes(g: Graph, delim: str = "#", fields: int = 1) -> DataFrame:
    """Base pairs of each sample on core, private and shell nodes.

    A node with one sample is private, with fewer than all shell, otherwise core; all
    counts samples of every path name, even of empty paths.
    """
    named = g.paths.select("path_id", sample_of(F.col("path_name"), delim, fields).alias("sample"))
    total = named.agg(F.countDistinct("sample").alias("total"))
    on = g.steps.join(named, "path_id").select("node_id", "sample", "len").distinct()
    n = on.groupBy("node_id").agg(F.count(F.lit(1)).alias("k")).crossJoin(total)
    kind = F.when(F.col("k") == 1, "private").when(F.col("k") < F.col("total"), "shell").otherwise("core")
    classed = on.join(n.select("node_id", kind.alias("class")), "node_id")
    bp = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("len"))), F.lit(0)).alias(f"{c}_bp")
    return classed.groupBy("sample").agg(bp("core"), bp("private"), bp("shell"))


def nondeterministic_edges(g: Graph) -> DataFrame:
    """Successors of an oriented node that begin with the same base as another successor."""
    from pathloom.functions.dna import oriented
    from pathloom.operators.traverse import follow

    seqs = g.nodes.select("node_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("rev"), "seq").select(handle(F.col("node_id"), F.col("rev")).alias("t"), F.substring(oriented(F.col("seq"), F.col("rev")), 1, 1).alias("base"))
    based = follow(g).join(unless_many(seqs), "t")
    alike = F.count(F.lit(1)).over(Window.partitionBy("h", "base"))
    return based.withColumn("n", alike).where("n > 1").select("h", "t", "base")


def components(g: Graph) -> DataFrame:
    """``(node_id, component)``: the smallest node id that edges reach, strand ignored."""
    found = connected_components(g.edges, "from_id", "to_id").withColumnRenamed("node", "node_id")
    return g.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(g: Graph) -> DataFrame:
    """Each component's nodes, base pairs, longest path and total path length."""
    c = components(g)
    size = g.nodes.join(c, "node_id").groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("len").alias("bp"))
    per_path = g.steps.join(c, "node_id").groupBy("component", "path_id").agg(F.sum("len").alias("l"))
    paths = per_path.groupBy("component").agg(F.max("l").alias("longest_path"), F.sum("l").alias("path_mass"))
    return size.join(paths, "component", "left").select("component", "n_nodes", "bp", F.coalesce("longest_path", F.lit(0)).alias("longest_path"), F.coalesce("path_mass", F.lit(0)).alias("path_mass"))


def largest_components(g: Graph, n: int, by: str = "bp") -> DataFrame:
    """The ``n`` largest components by ``bp``, ``n_nodes``, ``longest_path`` or ``path_mass``."""
    return component_sizes(g).orderBy(F.desc(by), "component").limit(n)


def sparse_matrix(g: Graph, edge_depth: bool = False, delta: bool = False) -> DataFrame:
    """``(i, j, w)`` both ways for each edge: 1, times walked, or one over the id distance.

    ``delta`` overrides ``edge_depth``; a self-edge is written twice.
    """
    e = g.edges
    if delta:
        e = e.withColumn("w", 1.0 / F.greatest(F.lit(1), F.abs(F.col("from_id") - F.col("to_id"))))
    elif edge_depth:
        from pathloom.operators.edges import edge_walks

        e = e.join(edge_walks(g), ["from_id", "from_rev", "to_id", "to_rev"], "left").withColumn("w", F.coalesce("n", F.lit(0)).cast("double"))
    else:
        e = e.withColumn("w", F.lit(1.0))
    both = F.explode(F.array(F.struct(F.col("from_id").alias("i"), F.col("to_id").alias("j")), F.struct(F.col("to_id").alias("i"), F.col("from_id").alias("j")))).alias("p")
    return e.select(both, "w").select("p.i", "p.j", "w")
