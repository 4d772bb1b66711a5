"""Walks over edges: distances, k-mers, unitigs, acyclicity, cycle breaking and forks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.dna import oriented
from pathloom.operators.edits import unchop
from pathloom.plans.graph import Graph, canonical_edges, handle
from pathloom.plans.scratch import materialize, unless_many
from pathloom.plans.strong import strong_components


def follow(g: Graph) -> DataFrame:
    """``(h, t)``: each oriented node, as an integer handle, with each that may follow it."""
    way = lambda a, ra, b, rb: F.struct(handle(F.col(a), ra).alias("h"), handle(F.col(b), rb).alias("t"))
    ahead, back = way("from_id", F.col("from_rev"), "to_id", F.col("to_rev")), way("to_id", ~F.col("to_rev"), "from_id", ~F.col("from_rev"))
    # Both at once: edges that come from a long plan are worked out once.
    return g.edges.select(F.explode(F.array(ahead, back)).alias("way")).select("way.h", "way.t").distinct()


def oriented_nodes(g: Graph) -> DataFrame:
    """``(h, node_id, is_rev, seq, len)`` for both readings of each node."""
    n = g.nodes.select("node_id", "seq", "len", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_rev"))
    return n.select(handle(F.col("node_id"), F.col("is_rev")).alias("h"), "node_id", "is_rev", oriented(F.col("seq"), F.col("is_rev")).alias("seq"), "len")


def distances(g: Graph, seeds: DataFrame, max_steps: int, max_bp: int | None = None, bidirectional: bool = False) -> DataFrame:
    """``(h, steps)`` for the handles within ``max_steps`` edges of ``seeds(h)``: a frontier join a step.

    ``max_bp`` stops a walk whose nodes between seed and handle exceed it; of walks with
    equally many steps the shortest in base pairs counts.
    """
    way = follow(g)
    if bidirectional:
        way = way.union(way.select(F.col("t").alias("h"), F.col("h").alias("t"))).distinct()
    size = g.nodes.select((handle(F.col("node_id"), F.lit(False))).alias("n2"), "len")
    way = materialize(way.join(size, F.col("n2") == F.col("t") - F.col("t") % 2).select("h", "t", "len"), "ways")
    seen = frontier = materialize(seeds.select("h", F.lit(0).alias("steps"), F.lit(0).cast("long").alias("bp")).distinct(), "reached")
    for k in range(1, max_steps + 1):
        new = frontier.join(way, "h").select(F.col("t").alias("h"), (F.col("bp") + F.col("len")).alias("bp"))
        if max_bp is not None:
            new = new.where(F.col("bp") <= max_bp)
        new = new.groupBy("h").agg(F.min("bp").alias("bp")).join(seen.select("h"), "h", "left_anti")
        frontier = materialize(new.select("h", F.lit(k).alias("steps"), "bp"), "frontier")
        if frontier.isEmpty():
            break
        seen = materialize(seen.union(frontier), "reached")
    return seen.select("h", "steps")


def kmers(g: Graph, k: int, max_furcations: int = 0, max_degree: int = 0) -> DataFrame:
    """``(kmer, node_id, is_rev, offset)``: the ``k`` bases from every offset of every oriented node on.

    Walks go over edges until they have ``k`` bases: at most ``k`` rounds of a frontier
    join.  With ``max_furcations`` walks that pass more forks are dropped, with
    ``max_degree`` nodes of more edges are left out.
    """
    if max_degree:
        small = g.degrees().where(F.col("degree") <= max_degree).select("node_id")
        keep = lambda c: small.withColumnRenamed("node_id", c)
        g = g.with_(nodes=g.nodes.join(small, "node_id", "left_semi"), edges=g.edges.join(keep("from_id"), "from_id", "left_semi").join(keep("to_id"), "to_id", "left_semi").select("from_id", "from_rev", "to_id", "to_rev"))
    n = oriented_nodes(g)
    way = follow(g)
    if max_furcations:
        way = way.withColumn("fork", (F.count(F.lit(1)).over(Window.partitionBy("h")) > 1).cast("int"))
    else:
        way = way.withColumn("fork", F.lit(0))
    after = n.select(F.col("h").alias("t"), F.expr(f"substring(seq, 1, {k})").alias("next"))
    ext = materialize(way.join(unless_many(after), "t").select("h", "t", "next", "fork"), "extensions")
    at = n.select("node_id", "is_rev", "h", F.explode(F.sequence(F.lit(0), (F.col("len") - 1).cast("int"))).alias("offset"), "seq")
    walk = at.select("node_id", "is_rev", "offset", "h", F.expr(f"substring(seq, offset + 1, {k})").alias("kmer"), F.lit(0).alias("forks"))
    done = walk.where(F.length("kmer") == k)
    frontier = materialize(walk.where(F.length("kmer") < k), "walks")
    parts = [done]
    for _ in range(k):
        grown = unless_many(frontier).join(ext, "h").select("node_id", "is_rev", "offset", F.col("t").alias("h"), F.expr(f"substring(concat(kmer, next), 1, {k})").alias("kmer"), (F.col("forks") + F.col("fork")).alias("forks"))
        if max_furcations:
            grown = grown.where(F.col("forks") <= max_furcations)
        grown = materialize(grown, "walks")
        parts.append(grown.where(F.length("kmer") == k))
        frontier = grown.where(F.length("kmer") < k)
        if frontier.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("kmer", "node_id", "is_rev", "offset")


def unique_kmers(g: Graph, k: int) -> DataFrame:
    """One row: how many different k-mers the graph spells."""
    return kmers(g, k).agg(F.countDistinct("kmer").alias("unique_kmers"))


def unitigs(g: Graph) -> DataFrame:
    """``(unitig, seq)``: sequences of maximal chains of nodes that have one way on."""
    plain = g.with_(paths=g.paths.limit(0), steps=g.steps.limit(0))
    return unchop(plain).nodes.select(F.col("node_id").alias("unitig"), "seq")


def handles_on_cycles(g: Graph) -> DataFrame:
    """``(h)``: oriented nodes from which a walk leads back to themselves."""
    way = follow(g)
    return strong_components(way, "h", "t").select(F.col("node").alias("h")).union(way.where("h = t").select("h")).distinct()


def acyclic_components(g: Graph) -> DataFrame:
    """``(component, acyclic)``: whether no directed walk of a component returns to its start."""
    from pathloom.operators.summary import components

    c = components(g)
    bad = handles_on_cycles(g).select((F.floor(F.col("h") / 2) + 1).alias("node_id")).distinct().join(c, "node_id").select("component").distinct().withColumn("bad", F.lit(True))
    return c.select("component").distinct().join(bad, "component", "left").select("component", F.col("bad").isNull().alias("acyclic"))


def cycle_edges(g: Graph, max_bp: int, max_steps: int | None = None) -> DataFrame:
    """Canonical edges that close a directed cycle of at most ``max_bp`` bases (and ``max_steps`` edges, if given).

    Walks carry their start; an edge back to it closes a cycle.  A walk goes on only where it
    is the first or the shortest yet, so the search ends by itself.  Only edges within a strongly
    connected component can close a cycle; no other is walked.
    """
    way = follow(g)
    label = materialize(strong_components(way, "h", "t"), "cycle-components")
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    way = way.join(of("h"), "h", "left").join(of("t"), "t", "left").where("h_in = t_in OR h = t").select("h", "t")
    size = g.nodes.select(handle(F.col("node_id"), F.lit(False)).alias("n2"), "len")
    way = materialize(way.join(size, F.col("n2") == F.col("t") - F.col("t") % 2).select("h", "t", "len"), "ways")
    start = F.col("h").alias("start")
    walk = materialize(way.select(start, F.col("h").alias("prev"), F.col("t").alias("h"), F.col("len").alias("bp")).where(F.col("bp") <= max_bp), "walks")
    closing = walk.where("false").select(F.col("prev").alias("a"), F.col("h").alias("b"))
    seen, k = None, 0
    while max_steps is None or k < max_steps:
        k += 1
        hit = walk.where("h = start").select(F.col("prev").alias("a"), F.col("h").alias("b")).distinct()
        if not hit.isEmpty():
            closing = closing.union(hit)
        # Of several ways to a handle the shortest stands for all.
        best = walk.where("h <> start").groupBy("start", "h").agg(F.min("bp").alias("bp"))
        if seen is not None:
            best = best.join(seen.withColumnRenamed("bp", "old"), ["start", "h"], "left").where("old IS NULL OR bp < old").drop("old")
        best = materialize(best, "walks")
        seen = materialize(best if seen is None else seen.union(best).groupBy("start", "h").agg(F.min("bp").alias("bp")), "walked")
        grown = best.join(way, "h").select("start", F.col("h").alias("prev"), F.col("t").alias("h"), (F.col("bp") + F.col("len")).alias("bp")).where(F.col("bp") <= max_bp)
        walk = materialize(grown, "walks")
        if walk.isEmpty():
            break
    id_, rev = lambda c: F.floor(F.col(c) / 2) + 1, lambda c: F.col(c) % 2 == 1
    return canonical_edges(closing.distinct().select(id_("a").alias("from_id"), rev("a").alias("from_rev"), id_("b").alias("to_id"), rev("b").alias("to_rev")))


def break_cycles(g: Graph, max_bp: int, max_steps: int | None = None, rounds: int = 1) -> Graph:
    """Without the edges that close short cycles; paths over them are removed."""
    for _ in range(rounds):
        gone = materialize(cycle_edges(g, max_bp, max_steps), "cycle-edges")
        if gone.isEmpty():
            break
        g = without_edges(g, gone)
    return g


def without_edges(g: Graph, gone: DataFrame) -> Graph:
    """Without some canonical edges and the paths that walk them."""
    key = ["from_id", "from_rev", "to_id", "to_rev"]
    edges = g.edges.join(gone, key, "left_anti")
    p = g.step_pairs().select("path_id", F.col("node_id").alias("from_id"), F.col("is_rev").alias("from_rev"), F.col("node_id2").alias("to_id"), F.col("is_rev2").alias("to_rev"))
    both = gone.union(gone.select("to_id", ~F.col("to_rev"), "from_id", ~F.col("from_rev"))).toDF(*key)
    broken = p.join(both.distinct(), key, "left_semi").select("path_id").distinct()
    return g.with_(edges=edges, paths=g.paths.join(broken, "path_id", "left_anti"), steps=g.steps.join(broken, "path_id", "left_anti"))


def furcation_edges(g: Graph, k: int, max_furcations: int) -> DataFrame:
    """Canonical edges that a walk of ``k`` bases takes as its fork number ``max_furcations`` + 1."""
    way = follow(g)
    forks = way.groupBy("h").agg((F.count(F.lit(1)) > 1).cast("int").alias("fork"))
    size = g.nodes.select(handle(F.col("node_id"), F.lit(False)).alias("n2"), "len")
    way = materialize(way.join(forks, "h").join(size, F.col("n2") == F.col("t") - F.col("t") % 2).select("h", "t", "fork", "len"), "ways")
    walk = materialize(way.select("h").distinct().select("h", F.lit(0).alias("forks"), F.lit(1).cast("long").alias("bp")), "walks")
    found = None
    for _ in range(k):
        step = walk.join(way, "h").withColumn("forks", F.col("forks") + F.col("fork"))
        over = step.where(F.col("forks") > max_furcations).select(F.col("h").alias("a"), F.col("t").alias("b")).distinct()
        found = over if found is None else found.union(over)
        # Walks that meet on a handle with equal forks are one; the shortest goes farthest.
        on = step.where(F.col("forks") <= max_furcations).groupBy(F.col("t").alias("h"), "forks").agg(F.min(F.col("bp") + F.col("len")).alias("bp")).where(F.col("bp") <= k)
        walk = materialize(on, "walks")
        if walk.isEmpty():
            break
    id_, rev = lambda c: F.floor(F.col(c) / 2) + 1, lambda c: F.col(c) % 2 == 1
    return canonical_edges(found.distinct().select(id_("a").alias("from_id"), rev("a").alias("from_rev"), id_("b").alias("to_id"), rev("b").alias("to_rev")))


def reverse_complement_graph(g: Graph) -> Graph:
    """Every node turned over; edges and steps follow, so paths spell what they did."""
    from pathloom.operators.edits import renumber
    from pathloom.plans.prefix import dense_index

    return renumber(g, dense_index(g.nodes.select("node_id", "rank"), ["rank"], "nth").select("node_id", "nth", F.lit(True).alias("flip")))


def split_strands(g: Graph) -> Graph:
    """Each node as two forward ones, ``2 * id - 1`` and, reversed, ``2 * id``; no step is reversed then."""
    from pathloom.functions.dna import reverse_complement
    from pathloom.plans.graph import with_pan_pos

    new = lambda i, r: F.col(i) * 2 - 1 + F.col(r).cast("long")
    both = g.nodes.select("node_id", "seq", "rank", F.explode(F.array(F.lit(False), F.lit(True))).alias("rev"))
    nodes = with_pan_pos(both.select(new("node_id", "rev").alias("node_id"), F.when(F.col("rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), (F.col("rank") * 2 + F.col("rev").cast("long")).alias("rank")))
    way = follow(g)
    edges = way.select((F.col("h") + 1).alias("from_id"), F.lit(False).alias("from_rev"), (F.col("t") + 1).alias("to_id"), F.lit(False).alias("to_rev"))
    steps = g.steps.withColumn("node_id", new("node_id", "is_rev")).withColumn("is_rev", F.lit(False))
    return Graph(nodes, edges, g.paths, steps)


def single_stranded(g: Graph) -> bool:
    """Whether no edge and no step turns to the other strand."""
    return g.edges.where("from_rev <> to_rev").isEmpty() and g.steps.where("is_rev").isEmpty()


def component_ends(g: Graph) -> DataFrame:
    """``(component, heads, tails)``: how many nodes of a component have no way in, or none on."""
    from pathloom.operators.summary import components

    d = g.degrees().join(components(g), "node_id")
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("component").agg(n(F.col("deg_l") == 0).alias("heads"), n(F.col("deg_r") == 0).alias("tails"))
