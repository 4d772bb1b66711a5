"""Strongly connected components of a directed edge list, as joins and aggregates.

Labels that spread along edges would need as many rounds as the longest way has edges, and a
sequence graph is one long way.  So the graph is made small first:

* a node without a way in, or without a way on, is a component of its own and goes;
* a node with a single way in joins the node before it, one with a single way on the node
  after it.  Every circle through the node takes that way, so components of the smaller graph
  are those of the larger.  Who joins whom is dealt by a coin for each node and round: tails join
  the first head on their way, if it is at most three steps off, so that no long chain of joins
  has to be followed.  Up to seven sixteenths of such nodes go in a round, and a chain of n
  nodes takes some multiple of log n rounds.

What two rounds shrink by less than an eighth each is searched by colours: the largest label
spreads forward, and the nodes of a colour that reach its label again are a component.  Then
the rules go on.

At the end the joins are undone, last first: a node that joined one before it belongs to its
component if and only if one of the node's ways on leads into that component, or to a node
that joined through it and belongs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.plans.scratch import FEW, drop, materialize, unless_many


#: Edges for each node that joins another, beyond which a round of joins is left out.
FEW_JOIN = 64


def _moved(df: DataFrame, rows: int) -> DataFrame:
    """``df``, worked out from a table of so many rows, to be joined by moving both sides if they are many."""
    return df.hint("merge") if rows > FEW else df


def _unless_many(df: DataFrame, rows: int) -> DataFrame:
    """:func:`unless_many`; not counted where the graph itself has few ``rows``."""
    return unless_many(df) if rows > FEW // 2 else df


def strong_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that lies on a circle with another node.

    ``component`` is the smallest node of it.  Nodes without a row are components
    of their own, whether or not an edge leads from them to themselves.  Null ends, repeated
    edges and edges from a node to itself add nothing; an empty input gives no rows.
    """
    x, y = F.col(a), F.col(b)
    e = materialize(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(x.cast("long").alias("a"), y.cast("long").alias("b")).distinct(), "strong")
    undo: list[tuple[DataFrame, int | None]] = []  # edges before a round of joins, or what colours found
    turn, idle, size = 0, 0, e.count()
    whole = size
    while size:
        if idle < 2:
            joined, now = materialize(_joined(e, turn, size).select("v", "root"), "strong-joined"), size
            if joined.count() * FEW_JOIN < size:  # not worth to write all edges anew
                idle += 1
            else:
                smaller = materialize(_merged(e, _unless_many(joined, whole)), "strong")
                now = smaller.count()
                idle = idle + 1 if now * 8 > size * 7 else 0
                undo.append((e, turn))  # whoever joins takes an edge along
                e = smaller
            drop(joined)
        else:  # few nodes have a single way
            found = materialize(_coloured(e, size), "strong-found")
            undo.append((found, None))
            out = lambda c: _unless_many(found, whole).select(F.col("node").alias(c))  # noqa: E731, B023
            e, old = materialize(e.join(out("a"), "a", "left_anti").join(out("b"), "b", "left_anti").select("a", "b"), "strong"), e
            drop(old)
            now, idle = e.count(), 0
        if turn % 2 and now:
            e, old = materialize(_trimmed(e, now), "strong"), e
            now = e.count()
            drop(old)
        turn, size = turn + 1, now
    drop(e)
    label = None
    for table, turn in reversed(undo):
        if turn is None:
            label, old = table if label is None else materialize(label.unionByName(table), "strong-label"), label
            used = [] if old is None else [old, table]
        else:
            label, old = _undone(label, table, turn, whole), label
            used = [table] if old is None else [old, table]
        for t in used:
            drop(t)
    if label is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    # A name that stands alone is no circle.
    many = label.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    return label.join(_moved(many, whole), "component").select("node", F.col("least").alias("component"))


def _trimmed(e: DataFrame, size: int) -> DataFrame:
    """Without edges from nodes that have no way in, or to nodes that have no way on."""
    ins, outs = e.select(F.col("b").alias("a")).distinct(), e.select(F.col("a").alias("b")).distinct()
    return e.join(_moved(ins, size), "a", "left_semi").join(_moved(outs, size), "b", "left_semi").select("a", "b")


def _ends(turn: int) -> tuple[str, str]:
    """The side of the node that joins and that of the joined one: ways in on even turns, ways on on odd ones."""
    return ("b", "a") if turn % 2 == 0 else ("a", "b")


def _single(e: DataFrame, turn: int) -> DataFrame:
    """``(v, p)``: nodes with a single way in (or on), and the node that it comes from (or leads to)."""
    v, p = _ends(turn)
    return e.groupBy(F.col(v).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("p")).where("n = 1").select("v", "p")


def _joined(e: DataFrame, turn: int, size: int) -> DataFrame:
    """``(v, p, root, depth)``: tails of :func:`_single` from which at most three steps lead to the first head, ``root``."""
    heads = lambda c: F.xxhash64(c, F.lit(turn)) % 2 == 0
    one = _single(e, turn).where(~heads("v")).withColumn("root", F.col("p")).withColumn("depth", F.lit(1))
    on = _moved(one.select(F.col("v").alias("root"), F.col("p").alias("further")), size)
    two = one.where(~heads("root")).join(on, "root").select("v", "p", F.col("further").alias("root"), F.lit(2).alias("depth"))
    three = two.where(~heads("root")).join(on, "root").select("v", "p", F.col("further").alias("root"), F.lit(3).alias("depth"))
    return one.unionByName(two).unionByName(three).where(heads("root"))


def _merged(e: DataFrame, joined: DataFrame) -> DataFrame:
    """Edges with the nodes that joined others replaced by them."""
    to = lambda c: joined.select(F.col("v").alias(c), F.col("root").alias(f"{c}2"))
    m = e.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
    return m.where("a <> b").distinct()


def _undone(label: DataFrame | None, e: DataFrame, turn: int, whole: int) -> DataFrame:
    """Labels with those of the nodes that joined others of ``e``; a node without a row is labelled by itself."""
    known = label if label is not None else e.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    joined = _joined(e, turn, e.count() if whole > FEW else whole)
    v, w = _ends(turn)[::-1]  # a node's ways on if it had one way in
    of = lambda c: (_unless_many(known, whole) if label is not None else known).select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    target = materialize(joined.join(of("root"), "root", "left").select("v", "p", F.coalesce("root_label", "root").alias("target")), "strong-target")
    to = _unless_many(target, whole)
    ways = e.select(F.col(v).alias("v"), F.col(w).alias("w")).join(to, "v").join(of("w"), "w", "left")
    inside = ways.where(F.coalesce("w_label", "w") == F.col("target")).select("v", "p", "target").distinct()
    # What a node inside was joined through is inside too.
    up = lambda x: x.select(F.col("p").alias("v")).distinct().join(to, "v")
    above = up(inside)
    found = inside.unionByName(above).unionByName(up(above)).select(F.col("v").alias("node"), F.col("target").alias("component")).distinct()
    # The node that was joined may have been alone until now: then its name is not known yet.
    out = materialize(known.unionByName(found).unionByName(found.select(F.col("component").alias("node"), "component")).distinct(), "strong-label")
    drop(target)
    return out


def _spread(start: DataFrame, e: DataFrame, size: int = 0) -> DataFrame:
    """The largest colour that reaches each node over ``e(a, b)``; ``start(node, colour)`` has every node."""
    now = fresh = materialize(start, "strong-colour")
    while True:
        # Only colours that are new to a node go on from it.
        step = e.join(_unless_many(fresh, size).withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("new"))
        grown = materialize(step.join(_unless_many(now, size), "node").where("new > colour").select("node", F.col("new").alias("colour")), "strong-fresh")
        if fresh is not now:
            drop(fresh)
        if grown.isEmpty():
            drop(grown)
            return now
        new = grown.select("node", F.col("colour").alias("new"))
        new = materialize(now.join(_unless_many(new, size), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")), "strong-colour")
        drop(now)
        now, fresh = new, grown


def _coloured(e: DataFrame, size: int) -> DataFrame:
    """``(node, component)`` of the components that hold the largest node of their colour."""
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    colour = _spread(nodes.select("node", F.col("node").alias("colour")), e, size)
    c = lambda n: _unless_many(colour, size).select(F.col("node").alias(n), F.col("colour").alias(f"{n}_colour"))
    back = materialize(e.join(c("a"), "a").join(c("b"), "b").where("a_colour = b_colour").select(F.col("b").alias("a"), F.col("a").alias("b")), "strong-back")
    roots = colour.where("node = colour").select("node", "colour")
    return _reached(roots, back, size).select("node", F.col("colour").alias("component"))


def _reached(start: DataFrame, e: DataFrame, size: int) -> DataFrame:
    """All nodes that ``start(node, colour)`` leads to over ``e(a, b)``, a frontier join a round."""
    seen = frontier = materialize(start, "strong-reached")
    while True:
        step = e.join(_unless_many(frontier, size).withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "colour").distinct().join(_unless_many(seen, size).select("node"), "node", "left_anti")
        frontier = materialize(step, "strong-frontier")
        if frontier.isEmpty():
            return seen
        seen = materialize(seen.unionByName(frontier), "strong-reached")


def topological_keys(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, key)`` of every node with an edge: sorted by ``key`` (an array) no edge of an acyclic graph goes back.

    The graph shrinks as in :func:`strong_components`.  Nodes without a way in are next in the
    order, those without a way on next from its end.  A node with a single way in follows right
    behind the node before it, one with a single way on stands right before the node after it, and
    the two are one node from then on; so a long chain takes rounds by the logarithm of its
    length.  What no node can join takes a round for each of its layers.  A key is the round in
    which a node went, then its places within the nodes that it had joined.

    Null ends and repeated edges add nothing.  A circle (an edge to itself included) is an error.
    """
    x, y = F.col(a), F.col(b)
    e = materialize(edges.where(x.isNotNull() & y.isNotNull()).select(x.cast("long").alias("a"), y.cast("long").alias("b")).distinct(), "topo")
    if e.where("a = b").head(1):
        raise ValueError("the graph has a circle")
    nodes = materialize(e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct(), "topo-nodes")
    undo: list[tuple[str, DataFrame, int]] = []
    turn, whole = 0, e.count()
    while left := nodes.count():
        size = e.count() if whole > FEW else whole
        ins, outs = _moved(e.select(F.col("b").alias("node")), size), _moved(e.select(F.col("a").alias("node")), size)
        first = nodes.join(ins, "node", "left_anti").withColumn("side", F.lit(0).cast("long")).withColumn("time", F.lit(turn).cast("long"))
        last = nodes.join(ins, "node", "left_semi").join(outs, "node", "left_anti").withColumn("side", F.lit(1).cast("long")).withColumn("time", F.lit(-turn).cast("long"))
        gone = materialize(first.union(last), "topo-gone")
        undo.append(("gone", gone, turn))
        nodes, old = materialize(nodes.join(_unless_many(gone, whole), "node", "left_anti"), "topo-nodes"), nodes
        drop(old)
        left_over = _unless_many(nodes, whole)
        stay = lambda c: left_over.select(F.col("node").alias(c))  # noqa: E731, B023
        e, old = materialize(e.join(stay("a"), "a", "left_semi").join(stay("b"), "b", "left_semi").select("a", "b"), "topo"), e
        drop(old)
        if nodes.count() == left:
            raise ValueError("the graph has a circle")
        joined = materialize(_joined(e, turn, size).select("v", "root", "depth"), "topo-joined")
        if joined.head(1):
            v, p = _ends(turn)
            to = _unless_many(joined, whole)
            # A way from a node back to the one that it joins behind would be lost with the join.
            if e.join(to.select(F.col("v").alias(p), F.col("root").alias(v)), [p, v], "left_semi").head(1):
                raise ValueError("the graph has a circle")
            undo.append(("joined", joined, turn))
            e, old = materialize(_merged(e, to), "topo"), e
            drop(old)
            nodes, old = materialize(nodes.join(to.select(F.col("v").alias("node")), "node", "left_anti"), "topo-nodes"), nodes
            drop(old)
        turn += 1
    places = None
    for kind, rows, turn in reversed(undo):
        if kind == "gone":
            new = rows.select("node", F.array("side", "time", "node").alias("key"))
            now = new if places is None else places.unionByName(new)
        else:
            sign = 1 if turn % 2 == 0 else -1  # behind the node before, or before the node after
            zero = F.lit(0).cast("long")
            of = _unless_many(places, whole).select(F.col("node").alias("root"), F.col("key").alias("root_key"))
            inner = _unless_many(rows, whole).join(of, "root").select(F.col("v").alias("node"), F.concat("root_key", F.array((F.col("depth") * sign).cast("long"), F.col("v"))).alias("key"))
            now = places.select("node", F.concat("key", F.array(zero, zero)).alias("key")).unionByName(inner)
        now, old = materialize(now, "topo-keys"), places
        drop(rows)
        if old is not None:
            drop(old)
        places = now
    return places if places is not None else nodes.select("node", F.array("node").alias("key"))
