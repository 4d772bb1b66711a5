"""The sequence graph as four tables, and the views that most operators start from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pathloom.plans.prefix import running_sum
from pathloom.plans.scratch import materialize


def by_step() -> WindowSpec:
    """Steps of one path in order."""
    return Window.partitionBy("path_id").orderBy("step_rank")



@dataclass(frozen=True)
class Graph:
    """A bidirected sequence graph with embedded paths.

    ``nodes(node_id, seq, len, rank, pan_pos)``, ``edges(from_id, from_rev, to_id, to_rev)``
    (canonical, distinct), ``paths(path_id, path_name)`` and
    ``steps(path_id, step_rank, node_id, is_rev, len, pos)``; ``rank`` is the storage
    order, ``pan_pos`` and ``pos`` the offsets in base pairs of a node in the graph and
    of a step in its path.
    """

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    steps: DataFrame

    def with_(self, **tables: DataFrame) -> Graph:
        """A copy with some tables replaced."""
        return replace(self, **tables)

    def written(self, *tables: str) -> Graph:
        """With some tables read back from files: worked out once, however often they are used."""
        return self.with_(**{t: materialize(getattr(self, t), t) for t in tables})

    def select_paths(self, keep: DataFrame) -> Graph:
        """Only the paths whose ``path_id`` is in ``keep``; nodes and edges stay."""
        ids = keep.select("path_id").distinct()
        return self.with_(paths=self.paths.join(ids, "path_id", "left_semi"), steps=self.steps.join(ids, "path_id", "left_semi"))

    def half_edges(self) -> DataFrame:
        """``(node_id, side, nbr_id, inv)``: each edge seen from both its ends, distinct."""
        inv = (F.col("from_rev") != F.col("to_rev")).alias("inv")
        ends = F.array(
            F.struct(F.col("from_id").alias("node_id"), F.when(F.col("from_rev"), "L").otherwise("R").alias("side"), F.col("to_id").alias("nbr_id"), inv),
            F.struct(F.col("to_id").alias("node_id"), F.when(F.col("to_rev"), "R").otherwise("L").alias("side"), F.col("from_id").alias("nbr_id"), inv),
        )
        return self.edges.select(F.explode(ends).alias("h")).select("h.*").distinct()

    def degrees(self) -> DataFrame:
        """``(node_id, deg_l, deg_r, degree)`` for every node, zeros kept."""
        side = lambda s: F.count(F.when(F.col("side") == s, 1))
        found = self.half_edges().groupBy("node_id").agg(side("L").alias("deg_l"), side("R").alias("deg_r"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        out = self.nodes.select("node_id").join(found, "node_id", "left").select("node_id", zero("deg_l"), zero("deg_r"))
        return out.withColumn("degree", F.col("deg_l") + F.col("deg_r"))

    def depths(self) -> DataFrame:
        """``(node_id, depth, depth_uniq)`` for every node: steps, and distinct paths."""
        # One count for a path and node first: the distinct count then needs no expansion.
        visits = self.steps.groupBy("node_id", "path_id").agg(F.count(F.lit(1)).alias("n"))
        found = visits.groupBy("node_id").agg(F.sum("n").alias("depth"), F.count(F.lit(1)).alias("depth_uniq"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return self.nodes.select("node_id").join(found, "node_id", "left").select("node_id", zero("depth"), zero("depth_uniq"))

    def path_lengths(self) -> DataFrame:
        """``(path_id, path_name, step_count, length_bp)`` for every path, empty ones too."""
        found = self.steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("step_count"), F.sum("len").alias("length_bp"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return self.paths.join(found, "path_id", "left").select("path_id", "path_name", zero("step_count"), zero("length_bp"))

    def step_pairs(self, *extra: str) -> DataFrame:
        """Each step with the next of its path: columns of the latter end in ``2``.

        ``extra`` names node columns (``rank``, ``pan_pos``) to have on both.
        """
        s = self.steps
        if extra:
            s = s.join(self.nodes.select("node_id", *extra), "node_id")
        for c in ("node_id", "is_rev", "len", *extra):
            s = s.withColumn(f"{c}2", F.lead(c).over(by_step()))
        return s.where("node_id2 IS NOT NULL")


def handle(node_id: Column, is_rev: Column) -> Column:
    """An oriented node as one integer."""
    return (node_id - 1) * 2 + is_rev.cast("long")


def canonical_edges(e: DataFrame) -> DataFrame:
    """Distinct edges in canonical direction from ``(from_id, from_rev, to_id, to_rev)``.

    An edge is walked either way: (a, b) is (flip b, flip a).  It is turned if both ends
    are reversed, or if one is and the first handle is the larger.
    """
    a, b = handle(F.col("from_id"), F.col("from_rev")), handle(F.col("to_id"), F.col("to_rev"))
    turn = (F.col("from_rev") & F.col("to_rev")) | ((F.col("from_rev") | F.col("to_rev")) & (a > b))
    pick = lambda x, y: F.when(turn, y).otherwise(x)
    return e.select(
        pick(F.col("from_id"), F.col("to_id")).alias("from_id"),
        pick(F.col("from_rev"), ~F.col("to_rev")).alias("from_rev"),
        pick(F.col("to_id"), F.col("from_id")).alias("to_id"),
        pick(F.col("to_rev"), ~F.col("from_rev")).alias("to_rev"),
    ).distinct()


def with_positions(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``steps`` with ``len`` from the nodes and ``pos``, the running length in its path."""
    s = steps.select("path_id", "step_rank", "node_id", "is_rev").join(nodes.select("node_id", "len"), "node_id")
    before = F.coalesce(F.sum("len").over(by_step().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("pos", before).select("path_id", "step_rank", "node_id", "is_rev", "len", "pos")


def with_pan_pos(nodes: DataFrame) -> DataFrame:
    """``nodes(node_id, seq, rank)`` with ``len`` and the running ``pan_pos``."""
    n = nodes.withColumn("len", F.length("seq").cast("long"))
    return running_sum(n, "rank", F.col("len"), "pan_pos").select("node_id", "seq", "len", "rank", "pan_pos")


def step_edges(steps: DataFrame) -> DataFrame:
    """The canonical edges that paths walk."""
    nxt = steps.select(
        F.col("node_id").alias("from_id"), F.col("is_rev").alias("from_rev"), F.lead("node_id").over(by_step()).alias("to_id"), F.lead("is_rev").over(by_step()).alias("to_rev")
    )
    return canonical_edges(nxt.where("to_id IS NOT NULL"))
