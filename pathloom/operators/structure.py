"""What directed walks can do: strongly connected parts, orientation, unrolling into an acyclic graph, connections.

Walks go over oriented nodes (handles); see ``traverse.follow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.traverse import acyclic_components, follow
from pathloom.plans.components import connected_components
from pathloom.plans.graph import Graph, canonical_edges, handle, with_pan_pos
from pathloom.plans.prefix import dense_index
from pathloom.plans.scratch import drop, materialize, unless_many
from pathloom.plans.strong import strong_components, topological_keys

MOST = (1 << 63) - 1


def _node(h: str):
    return (F.floor(F.col(h) / 2) + 1).cast("long")


def strong_nodes(g: Graph) -> DataFrame:
    """``(node_id, component)`` for every node: the smallest node of its strongly connected component.

    Components are those of oriented nodes; a node is in that of either reading, which are
    mirror images with the same nodes.
    """
    found = strong_components(follow(g), "h", "t").select(_node("node").alias("node_id"), "component")
    least = found.groupBy("component").agg(F.min("node_id").alias("least"))
    named = found.join(least, "component").select("node_id", "least").distinct()
    return g.nodes.select("node_id").join(named, "node_id", "left").select("node_id", F.coalesce("least", "node_id").alias("component"))


def heaviest_ways(g: Graph) -> DataFrame:
    """``(h, t)``: for each oriented node the one that paths most often go on to; of equal ones the smallest handle."""
    from pathloom.operators.edges import edge_walks

    w = edge_walks(g)
    a, b = handle(F.col("from_id"), F.col("from_rev")), handle(F.col("to_id"), F.col("to_rev"))
    # Turned over, 2k and 2k + 1 change places.
    turn = lambda h: h + 1 - 2 * (h % 2)
    both = w.select(a.alias("h"), b.alias("t"), "n").union(w.select(turn(b).alias("h"), turn(a).alias("t"), "n")).distinct()
    return both.groupBy("h").agg(F.max_by("t", F.struct("n", -F.col("t"))).alias("t"))


# --- orientation -----------------------------------------------------------------------------


def orientations(g: Graph) -> DataFrame:
    """``(node_id, component, flip, oriented)``: how to turn nodes so that no edge changes strand.

    Oriented nodes that an edge joins, either way, are of one side.  A component whose sides
    meet can't be oriented (``oriented`` is false, ``flip`` too); else the side with the smallest handle
    reads forward.
    """
    side = connected_components(follow(g), "h", "t")
    own = lambda rev: F.col("_h") + rev
    n = g.nodes.select("node_id", handle(F.col("node_id"), F.lit(False)).alias("_h"))
    for k in (0, 1):
        n = n.join(side.select(F.col("node").alias(f"_n{k}"), F.col("component").alias(f"_c{k}")), F.col(f"_n{k}") == own(k), "left")
    n = n.select("node_id", F.coalesce("_c0", own(0)).alias("c0"), F.coalesce("_c1", own(1)).alias("c1"))
    return n.select("node_id", (F.floor(F.least("c0", "c1") / 2) + 1).cast("long").alias("component"), (F.col("c1") < F.col("c0")).alias("flip"), (F.col("c0") != F.col("c1")).alias("oriented"))


def nice_components(g: Graph) -> DataFrame:
    """``(component, oriented, acyclic, nice, heads)`` of each component.

    A nice component can be read from its heads on: it is oriented and acyclic, and its tips
    (nodes with a side without edges) all read forward in the same orientation.  ``heads``
    counts the nodes without edges on their left if it is nice, else it is 0.
    """
    g = g.written("edges")  # read by each of the three parts
    o = orientations(g).join(g.degrees(), "node_id")
    tip = (F.col("deg_l") == 0) | (F.col("deg_r") == 0)
    one = o.groupBy("component").agg(
        F.min("oriented").alias("oriented"), F.count_if(tip & F.col("flip")).alias("turned"), F.count_if(tip & ~F.col("flip")).alias("straight"), F.count_if(F.col("deg_l") == 0).alias("heads")
    )
    out = one.join(acyclic_components(g), "component").withColumn("nice", F.col("oriented") & F.col("acyclic") & ((F.col("turned") == 0) | (F.col("straight") == 0)))
    return out.select("component", "oriented", "acyclic", "nice", F.when(F.col("nice"), F.col("heads")).otherwise(0).alias("heads"))


# --- unrolling -------------------------------------------------------------------------------


def _copies(inner: DataFrame, k: int) -> DataFrame:
    """``(component, copies)`` needed so that walks of ``k`` base pairs stay, of components with edges back.

    ``inner(component, a, b, len_a, back)``.  A walk may take an edge back for each copy but the last.
    With ``D(m)`` the fewest base pairs between the first and the (m+1)-th edge back of a walk, one
    copy is needed for the start and one for each m with ``D(m) < k``.
    """
    back, ahead = inner.where("back"), inner.where("NOT back")
    out = materialize(back.select("component").distinct().select("component", F.lit(2 if k > 0 else 1).alias("copies")), "copies")
    at = materialize(back.select("component", F.col("b").alias("node")).distinct().select("component", "node", F.lit(0).cast("long").alias("d")), "unroll")
    while k > 0 and not at.isEmpty():
        # Within a copy: the fewest base pairs to each node, as far as it matters.
        best = front = at
        while True:
            step = front.join(ahead.select("component", F.col("a").alias("node"), "b", "len_a"), ["component", "node"]).select("component", F.col("b").alias("node"), (F.col("d") + F.col("len_a")).alias("d")).where(F.col("d") < k)
            step = step.groupBy("component", "node").agg(F.min("d").alias("d"))
            front = materialize(step.join(best.withColumnRenamed("d", "old"), ["component", "node"], "left").where("old IS NULL OR d < old").drop("old"), "unroll")
            if front.isEmpty():
                break
            best = materialize(best.unionByName(front).groupBy("component", "node").agg(F.min("d").alias("d")), "unroll")
        over = best.join(back.select("component", F.col("a").alias("node"), "b", "len_a"), ["component", "node"]).select("component", F.col("b").alias("node"), (F.col("d") + F.col("len_a")).alias("d")).where(F.col("d") < k)
        at = materialize(over.groupBy("component", "node").agg(F.min("d").alias("d")), "unroll")
        more = at.select("component").distinct().withColumn("more", F.lit(1))
        out = materialize(out.join(more, "component", "left").select("component", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies")), "copies")
    return out


def dagify(g: Graph, k: int) -> tuple[Graph, DataFrame]:
    """An acyclic graph with every walk of ``g`` of up to ``k`` base pairs, and ``(node_id, old_id, copy)``.

    Edges must not change strand (split the strands first).  Each strongly connected component
    is laid out in storage order; edges that go back there lead from each copy of the component
    to the next, as many copies as :func:`_copies` says.  Edges between components lead from the last
    copy to every copy.  Paths are not carried over; an acyclic graph comes out renumbered only.
    """
    if not g.edges.where("from_rev OR to_rev").isEmpty():
        raise ValueError("edges that change strand: split the strands first")
    e = g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    found = strong_components(e).select(F.col("node").alias("node_id"), "component")
    n = g.nodes.join(found, "node_id", "left").select("node_id", "seq", "len", "rank", F.coalesce("component", "node_id").alias("component"))
    n = materialize(n, "dag-nodes")
    about = lambda c: n.select(F.col("node_id").alias(c), F.col("component").alias(f"comp_{c}"), F.col("rank").alias(f"rank_{c}"), F.col("len").alias(f"len_{c}"))
    e = materialize(e.join(about("a"), "a").join(about("b"), "b"), "dag-edges")
    inner = e.where("comp_a = comp_b").select(F.col("comp_a").alias("component"), "a", "b", "len_a", (F.col("rank_a") >= F.col("rank_b")).alias("back"))
    copies = _copies(inner, k)
    n = n.join(copies, "component", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    n = n.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    first = n.groupBy("component").agg(F.min("rank").alias("first"))
    made = dense_index(n.join(first, "component"), ["first", "component", "copy", "rank"], "nth")
    made = materialize(made.select((F.col("nth") + 1).alias("node_id"), F.col("node_id").alias("old_id"), "copy", "copies", "seq", F.col("nth").alias("rank")), "dag-copies")
    end = lambda c: made.select(F.col("node_id").alias(f"new_{c}"), F.col("old_id").alias(c), F.col("copy").alias(f"copy_{c}"), F.col("copies").alias(f"copies_{c}"))
    both = e.join(end("a"), "a").join(end("b"), "b")
    same = F.col("comp_a") == F.col("comp_b")
    ahead = same & (F.col("rank_a") < F.col("rank_b")) & (F.col("copy_a") == F.col("copy_b"))
    back = same & (F.col("rank_a") >= F.col("rank_b")) & (F.col("copy_a") + 1 == F.col("copy_b"))
    across = ~same & (F.col("copy_a") == F.col("copies_a") - 1)
    edges = both.where(ahead | back | across).select(F.col("new_a").alias("from_id"), F.lit(False).alias("from_rev"), F.col("new_b").alias("to_id"), F.lit(False).alias("to_rev"))
    dag = Graph(with_pan_pos(made.select("node_id", "seq", "rank")), edges.distinct(), g.paths.limit(0), g.steps.limit(0))
    return dag, made.select("node_id", "old_id", "copy")


# --- connections -----------------------------------------------------------------------------


def _fewest(way: DataFrame, seeds: DataFrame, limit: int, name: str) -> DataFrame:
    """``(h, d)``: the fewest base pairs from ``seeds(h, d)`` over ``way(h, t, len)``, up to ``limit``.

    An edge adds ``len``; only handles that got nearer go on.
    """
    best = front = materialize(seeds.where(F.col("d") <= limit).groupBy("h").agg(F.min("d").alias("d")), name)
    while True:
        step = way.join(unless_many(front), "h").select(F.col("t").alias("h"), (F.col("d") + F.col("len")).alias("d")).where(F.col("d") <= limit)
        step = step.groupBy("h").agg(F.min("d").alias("d"))
        old = best.withColumnRenamed("d", "old")
        front = materialize(step.join(unless_many(old), "h", "left").where("old IS NULL OR d < old").drop("old"), name)
        if front.isEmpty():
            return best
        best, old = materialize(best.unionByName(front).groupBy("h").agg(F.min("d").alias("d")), name), best
        drop(old)


def _ways(g: Graph) -> DataFrame:
    """``(h, t, len)``: edges of handles with the length of the node that they leave."""
    size = g.nodes.select(handle(F.col("node_id"), F.lit(False)).alias("n2"), "len")
    return materialize(follow(g).join(size, F.col("n2") == F.col("h") - F.col("h") % 2).select("h", "t", "len"), "ways")


def distances_to_ends(g: Graph, limit: int) -> DataFrame:
    """``(node_id, to_head, to_tail)``: base pairs of the nodes passed from a node to the nearest head or tail.

    Heads have no edge on their left, tails none on their right; heads are sought against the
    reading of the node, tails along it.  The head or tail counts, the node itself does not; 0 for
    the end itself, null where none is within ``limit``.
    """
    g = g.written("edges")
    d = g.degrees()
    way = follow(g)
    sizes = g.nodes.select(handle(F.col("node_id"), F.lit(False)).alias("n2"), "len")
    out = g.nodes.select("node_id")
    for name, free, a, b in (("to_head", "deg_l", "h", "t"), ("to_tail", "deg_r", "t", "h")):
        # From the ends to all others; what an edge adds is the node it leaves, the end included.
        rows = materialize(way.select(F.col(a).alias("h"), F.col(b).alias("t")).join(sizes, F.col("n2") == F.col("h") - F.col("h") % 2).select("h", "t", "len"), "ways")
        tips = d.where(F.col(free) == 0).select(F.explode(F.array(handle(F.col("node_id"), F.lit(False)), handle(F.col("node_id"), F.lit(True)))).alias("h"), F.lit(0).cast("long").alias("d"))
        near = _fewest(rows, tips, limit, "ends")
        out = out.join(near.where("h % 2 = 0").select(_node("h").alias("node_id"), F.col("d").alias(name)), "node_id", "left")
    return out


def connecting(g: Graph, start: tuple[int, bool, int], end: tuple[int, bool, int], most: int) -> DataFrame:
    """``(node_id, is_rev, from_start, to_end)``: oriented nodes on walks of up to ``most`` base pairs between two positions.

    A position is ``(node_id, is_rev, offset)``, the offset counted along the reading.  Both
    are labelled by distance, one side forward, one back, and a node stays where the sum is
    within the bound.  ``from_start`` is the fewest base pairs from the start to the node's first
    base, ``to_end`` from there to the end (negative numbers where the node begins before the
    start).  Walks that come back to the start's or end's node count too.  No walk gives no rows.
    """
    (n1, r1, o1), (n2, r2, o2) = start, end
    h1, h2 = (n1 - 1) * 2 + int(r1), (n2 - 1) * 2 + int(r2)
    spark = g.nodes.sparkSession
    seed = lambda h, d: spark.createDataFrame([(h, d)], "h long, d long")
    way = _ways(g)
    # Distances are of a node's first base; the start's node begins o1 before the start.
    first = seed(h1, -o1)
    if h1 == h2 and o2 < o1:  # the end lies behind: only a way around comes there
        first = way.where(F.col("h") == h1).select(F.col("t").alias("h"), (F.col("len") - o1).alias("d"))
    ahead = unless_many(_fewest(way, first, most - o2, "ahead")).withColumnRenamed("d", "from_start")
    # Against the edges an edge adds the length of the node it comes to.
    back = _fewest(way.select(F.col("t").alias("h"), F.col("h").alias("t"), "len"), seed(h2, o2), most + o1, "back").withColumnRenamed("d", "to_end")
    both = ahead.join(unless_many(back), "h").where(F.col("from_start") + F.col("to_end") <= most)
    return both.select(_node("h").alias("node_id"), (F.col("h") % 2 == 1).alias("is_rev"), "from_start", "to_end")


def connecting_graph(g: Graph, start: tuple[int, bool, int], end: tuple[int, bool, int], most: int) -> Graph:
    """The sub-graph of walks of up to ``most`` base pairs between two positions, without paths.

    Nodes keep their ids and sequences; an edge stays if it lies on such a walk.
    """
    on = materialize(connecting(g, start, end, most), "connecting")
    nodes = g.nodes.join(on.select("node_id").distinct(), "node_id", "left_semi")
    h = handle(F.col("node_id"), F.col("is_rev"))
    a = on.select(h.alias("h"), "from_start", F.col("node_id").alias("from_id"), F.col("is_rev").alias("from_rev"))
    b = on.select(h.alias("t"), "to_end", F.col("node_id").alias("to_id"), F.col("is_rev").alias("to_rev"))
    size = g.nodes.select(F.col("node_id").alias("from_id"), "len")
    e = follow(g).join(a, "h").join(b, "t").join(size, "from_id").where(F.col("from_start") + F.col("len") + F.col("to_end") <= most)
    return Graph(with_pan_pos(nodes.select("node_id", "seq", "rank")), canonical_edges(e.select("from_id", "from_rev", "to_id", "to_rev")), g.paths.limit(0), g.steps.limit(0))


def count_walks(g: Graph) -> DataFrame:
    """``(node_id, walks)``: how many walks lead from a head to each node, reading forward; a cycle is an error.

    Nodes are taken layer by layer, each once all before it are done.  Numbers beyond
    2**63 - 1 stay there.
    """
    if not g.edges.where("from_rev OR to_rev").isEmpty():
        raise ValueError("edges that change strand: split the strands first")
    e = materialize(g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct(), "walk-edges")
    left = e.groupBy(F.col("b").alias("node_id")).agg(F.count(F.lit(1)).alias("open"))
    now = materialize(g.nodes.select("node_id").join(left, "node_id", "left_anti").select("node_id", F.lit(1).cast("decimal(38,0)").alias("walks")), "walks")
    open_ = materialize(left.select("node_id", "open", F.lit(0).cast("decimal(38,0)").alias("walks")), "walks-open")
    parts = [now]
    while not now.isEmpty():
        come = now.join(e, F.col("node_id") == F.col("a")).groupBy(F.col("b").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("walks").alias("more"))
        next_ = materialize(
            open_.join(come, "node_id", "left").select("node_id", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.least(F.lit(MOST), F.col("walks") + F.coalesce("more", F.lit(0))).cast("decimal(38,0)").alias("walks")), "walks-open"
        )
        drop(open_)
        now = materialize(next_.where("open = 0").select("node_id", "walks"), "walks")
        open_ = materialize(next_.where("open > 0"), "walks-open")
        drop(next_)
        parts.append(now)
    if not open_.isEmpty():
        raise ValueError("the graph has a cycle")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("node_id", F.col("walks").cast("long").alias("walks"))


def condensed_order(g: Graph) -> DataFrame:
    """``(node_id, nth)``: an order in which no edge between strongly connected components goes back.

    Edges must not change strand (split the strands first).  The nodes of a component stand
    together in storage order; nodes without edges come last.  No task holds more than a share of
    the rows, however long the graph's longest way is.
    """
    if not g.edges.where("from_rev OR to_rev").isEmpty():
        raise ValueError("edges that change strand: split the strands first")
    e = g.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    label = materialize(strong_components(e), "order-components")
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    between = e.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")).where("a <> b")
    keys = topological_keys(between)
    n = g.nodes.select("node_id", "rank").join(label.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    n = n.join(keys.withColumnRenamed("node", "component"), "component", "left").withColumn("alone", F.col("key").isNull())
    return dense_index(n.select("node_id", "alone", "key", "component", "rank"), ["alone", "key", "component", "rank", "node_id"], "nth").select("node_id", "nth")
