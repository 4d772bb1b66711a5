"""Walking contexts: how alike two steps' surroundings are, break points and segment mappings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.ranges import near_steps
from pathloom.functions.numbers import percent_identity
from pathloom.plans.graph import Graph
from pathloom.plans.scratch import materialize


def _near(g: Graph, at: DataFrame, before: str, after: str, *keep: str) -> DataFrame:
    """``at(key, path_id, step_rank, ...)`` with the steps around: each one's ``node_id``, ``len``, and ``gap`` in base pairs, ``later`` or not.

    The step itself has a gap of -1.  Steps are not looked up again where ``at`` has their ``cpos``
    and ``clen``, place and length; ``keep`` names more columns of ``at`` to have.
    """
    cur = at
    if "cpos" not in at.columns:
        cur = at.join(g.steps.select("path_id", "step_rank", F.col("pos").alias("cpos"), F.col("len").alias("clen")), ["path_id", "step_rank"])
    kept = [c for c in keep if c != "path_id"]
    cur = cur.select("key", "path_id", F.col("step_rank").alias("crank"), "cpos", "clen", F.col(before).alias("b"), F.col(after).alias("a"), *kept)
    near = near_steps(g.steps, cur, F.col("cpos") - F.col("b"), F.col("cpos") + F.col("clen") + F.col("a"))
    later = F.col("step_rank") > F.col("crank")
    gap = F.when(F.col("step_rank") == F.col("crank"), -1).when(later, F.col("pos") - (F.col("cpos") + F.col("clen"))).otherwise(F.col("cpos") - (F.col("pos") + F.col("len")))
    near = near.withColumn("gap", gap).withColumn("later", later)
    return near.where("gap = -1 OR gap < CASE WHEN later THEN a ELSE b END").select("key", "node_id", "len", "gap", "later", "b", "a", *keep)


def contexts(g: Graph, at: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``(key, node_id, n, len)``: nodes within given distances of steps ``at(key, path_id, step_rank, before, after)``.

    A node that begins within the distance counts whole; a context whose walk is shorter
    than both distances together is empty.
    """
    near = _near(g, at, before, after)
    enough = near.groupBy("key").agg(F.sum("len").alias("walked"), F.first(F.col("b") + F.col("a")).alias("asked")).where("walked >= asked").select("key")
    return near.join(enough, "key", "left_semi").groupBy("key", "node_id").agg(F.count(F.lit(1)).alias("n"), F.first("len").alias("len"))


def no_context() -> Column:
    """The empty list of a context."""
    return F.array().cast("array<struct<node_id:bigint,len:bigint,visit:int>>")


def _as_list(near: Column, asked: Column) -> Column:
    """A context from ``array<struct<node_id, len, ...>>``: each visit of a node by its number; empty if the walk is shorter than ``asked``."""
    nth = lambda x, i: F.struct(x["node_id"].alias("node_id"), x["len"].alias("len"), F.size(F.filter(F.slice(near, F.lit(1), i + 1), lambda y: y["node_id"] == x["node_id"])).alias("visit"))
    return F.when(bases(near) >= asked, F.transform(near, nth)).otherwise(no_context())


def context_lists(g: Graph, at: DataFrame, before: str = "before", after: str = "after", *keep: str) -> DataFrame:
    """``(key, context)``: :func:`contexts` with one row a key, as lists that :func:`list_jaccard` compares.

    ``keep`` names columns of ``at`` that a key has one value of; with ``path_id`` among them,
    steps that lie by path are put together where they lie.
    """
    near = _near(g, at, before, after, *keep).groupBy("key", *keep).agg(F.collect_list(F.struct("node_id", "len")).alias("near"), F.first(F.col("b") + F.col("a")).alias("asked"))
    return near.select("key", *keep, _as_list(F.col("near"), F.col("asked")).alias("context"))


def bases(context: Column | str) -> Column:
    """The base pairs of a context's list."""
    return F.aggregate(context, F.lit(0).cast("long"), lambda n, x: n + x["len"])


def shared_bases(a: Column, b: Column) -> Column:
    """The base pairs that two lists of contexts share, visit for visit."""
    return bases(F.array_intersect(a, b))


def list_jaccard(a: Column, b: Column) -> Column:
    """How alike two lists of contexts are; 0 for two empty ones."""
    i, both = shared_bases(a, b), bases(a) + bases(b)
    return F.when(both > 0, i / F.nullif(both - i, F.lit(0))).otherwise(0.0)


def context_jaccard(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(left, right, jaccard)`` for ``pairs(left, right)`` of context keys: weighted node multisets.

    Only shared nodes are joined; the union follows from the sizes.
    """
    size = lambda c, k: c.groupBy("key").agg(F.sum(F.col("n") * F.col("len")).alias(f"s{k}")).withColumnRenamed("key", k)
    l_, r_ = left.select(F.col("key").alias("left"), "node_id", F.col("n").alias("nl"), "len"), right.select(F.col("key").alias("right"), "node_id", F.col("n").alias("nr"))
    both = pairs.join(l_, "left").join(r_, ["right", "node_id"]).groupBy("left", "right").agg(F.sum(F.col("len") * F.least("nl", "nr")).alias("i"))
    out = pairs.join(size(left, "left"), "left", "left").join(size(right, "right"), "right", "left").join(both, ["left", "right"], "left")
    i = F.coalesce("i", F.lit(0))
    union = F.coalesce("sleft", F.lit(0)) + F.coalesce("sright", F.lit(0)) - i
    return out.select("left", "right", F.when(union > 0, i / union).otherwise(0.0).alias("jaccard"))


def break_points(g: Graph, targets: DataFrame, queries: DataFrame, context: int = 1000) -> DataFrame:
    """First hits of each query path on each other target path, from its front and from its back.

    ``target_id, query_id, direction, query_rank, target_rank, jaccard``: the target step on
    the hit node whose surroundings are most alike; of equal ones the middle one by rank.
    Distances shrink to what both walks have.
    """
    # Steps on the nodes of targets, with what lies within the context: put together where steps lie by path, it goes to the node once.
    is_target, is_query = (paths.select("path_id").distinct().withColumn(c, F.lit(True)) for paths, c in ((targets, "is_target"), (queries, "is_query")))
    total = F.sum("len").over(Window.partitionBy("path_id"))
    p, n = F.col("pos"), total - F.col("pos") - F.col("len")
    place = [F.col("node_id").alias("own"), F.col("pos").alias("cpos"), F.col("len").alias("clen"), F.least(p, n).alias("lo"), F.greatest(p, n).alias("hi")]
    at = g.steps.select("path_id", "step_rank", *place).join(is_target, "path_id", "left").join(is_query, "path_id", "left").where("is_target OR is_query")
    on = materialize(g.steps.join(targets.select("path_id"), "path_id", "left_semi").select(F.col("node_id").alias("own")).distinct(), "target-nodes")
    met = g.steps.join(queries.select("path_id"), "path_id", "left_semi").select("path_id", F.col("node_id").alias("own")).distinct().join(on, "own", "left_semi").withColumn("met", F.lit(True))
    at = at.join(met, ["path_id", "own"], "left").where("is_target OR met").withColumn("key", F.col("step_rank")).withColumn("reach", F.lit(context))
    keep = ["path_id", "own", "lo", "hi", "is_target", "is_query"]
    around = _near(g, at, "reach", "reach", *keep).groupBy("key", *keep).agg(F.collect_list(F.struct("node_id", "len", "gap", "later")).alias("near"))
    around = around.select("path_id", F.col("key").alias("step_rank"), F.col("own").alias("node_id"), "lo", "hi", "is_target", "is_query", "near")
    around = materialize(around, "step-surroundings")
    one = F.struct("step_rank", "lo", "hi", "near")
    t = around.where("is_target").groupBy("node_id", F.col("path_id").alias("target_id")).agg(F.sort_array(F.collect_list(F.struct("step_rank", one.alias("at")))).alias("t"))
    t = t.select("node_id", "target_id", F.col("t.at").alias("t"))
    q = around.where("is_query").select("node_id", F.col("path_id").alias("query_id"), F.col("step_rank").alias("query_rank"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.col("near").alias("q"))
    meet = q.join(t, "node_id").where("target_id <> query_id")
    # Walks may be short on either side: both assignments of the two limits are tried on each side.
    limit = lambda c: F.least(F.lit(context).cast("long"), F.col(f"q_{c}"), F.array_min(F.col(f"t.{c}")))
    meet = meet.withColumn("first", limit("lo")).withColumn("second", limit("hi"))
    first, second = F.col("first"), F.col("second")
    within = lambda near, before, after: _as_list(F.filter(near, lambda x: x["gap"] < F.when(x["gap"] < 0, 0).when(x["later"], after).otherwise(before)), before + after)
    ways = lambda near: F.array(within(near, first, second), within(near, second, first))
    meet = meet.withColumn("q", ways(F.col("q"))).withColumn("c", F.transform("t", lambda x: ways(x["near"])))
    alike = lambda w: F.greatest(*[list_jaccard(w[i], F.col("q")[j]) for i in (0, 1) for j in (0, 1)])
    meet = meet.select("target_id", "query_id", "query_rank", F.col("t.step_rank").alias("ranks"), F.transform("c", alike).alias("j"))
    meet = meet.withColumn("top", F.array_max("j")).withColumn("top_ranks", F.filter("ranks", lambda r, i: F.element_at("j", i + 1) == F.col("top")))
    best = F.struct("query_rank", F.element_at("top_ranks", F.floor(F.size("top_ranks") / 2).cast("int") + 1).alias("target_rank"), F.col("top").alias("jaccard"))
    ends = meet.select("target_id", "query_id", best.alias("h")).groupBy("target_id", "query_id").agg(F.min("h").alias("front"), F.max("h").alias("back"))
    way = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(d).alias("h")) for d in ("front", "back")])).alias("w")
    return ends.select("target_id", "query_id", way).select("target_id", "query_id", "w.direction", "w.h.query_rank", "w.h.target_rank", "w.h.jaccard")


def loop_cuts(nodes: list[int], marked: list[bool]) -> list[int]:
    """Ranks at which a walk is cut: its ends, its marked steps, and where its loops begin and end.

    A stretch is read forwards, then backwards.  A step whose node comes again inside the
    stretch opens a loop to that next visit; the reading goes on behind the loop, which is
    a stretch of its own later.  Steps are read once in each direction.
    """
    last = len(nodes) - 1
    again: dict[int, list[int]] = {}
    for rank, node in enumerate(nodes):
        again.setdefault(node, []).append(rank)
    place = {rank: (visits, i) for visits in again.values() for i, rank in enumerate(visits)}

    def other(rank: int, step: int) -> int | None:
        visits, i = place[rank]
        return visits[i + step] if 0 <= i + step < len(visits) else None

    cuts, stretches = set(), [(0, last)]
    seen: dict[int, set[int]] = {1: set(), -1: set()}
    for first, end in stretches:  # grows while it is read
        cuts |= {first, end}
        for step, rank, until in ((1, first, end), (-1, end, first)):
            read = seen[step]
            while rank != until:
                if rank not in read:
                    read.add(rank)
                    if marked[rank]:
                        cuts.add(rank)
                    to = other(rank, step)
                    if to is not None and first < to < end and to not in read:
                        stretches.append((min(rank, to), max(rank, to)))
                        rank = to
                rank += step
    return sorted(cuts)


def segment_paths(g: Graph, paths: DataFrame, shared: DataFrame | None = None, merge: int = 0) -> DataFrame:
    """``(path_id, start_rank, start, end)``: segments between cut points of each path.

    Paths are cut at their loops and ends and at steps on nodes of ``shared(node_id)``;
    a cut within ``merge`` base pairs of the one before is left out.  One path is one
    task's work.
    """
    s = g.steps.join(paths.select("path_id"), "path_id", "left_semi").select("path_id", "step_rank", "node_id", "pos", "len")
    marks = (shared if shared is not None else g.nodes.limit(0)).select("node_id").distinct().withColumn("cut", F.lit(True))
    s = s.join(marks, "node_id", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))

    step = F.struct("step_rank", "node_id", "cut", "pos", (F.col("pos") + F.col("len")).alias("end"))
    walks = s.groupBy("path_id").agg(F.sort_array(F.collect_list(step)).alias("w"))
    walks = walks.select("path_id", *[F.col(f"w.{c}").alias(c) for c in ("node_id", "cut", "pos")], F.element_at("w.end", -1).alias("end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for path, nodes, marked, pos, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kept, last = [], 0
                for rank in loop_cuts(nodes, marked):
                    if pos[rank] == 0 or pos[rank] > last + merge:
                        kept.append(rank)
                        last = pos[rank]
                starts = [pos[r] for r in kept]
                for column, more in zip(out, ([path] * len(kept), kept, starts, [*starts[1:], end]), strict=True):
                    column += more
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["path_id", "start_rank", "start", "end"])

    return walks.mapInArrow(cut, "path_id long, start_rank long, start long, end long")


def with_visits(g: Graph) -> Graph:
    """``g`` with its steps written once, each with ``visits``, how often its path comes to its node.

    Steps are taken apart by path where they are made, so counting moves nothing.
    """
    if "visits" in g.steps.columns:
        return g
    own = Window.partitionBy("path_id", "node_id")
    return g.with_(steps=materialize(g.steps.withColumn("visits", F.count(F.lit(1)).over(own)), "steps"))


def _segment_rows(g: Graph, segs: DataFrame, k: str) -> DataFrame:
    """``(node_id, visit, len, {k}_rev, {k}_id, {k}_start, {k}_end, visits)``: the steps that begin in each segment.

    Only nodes that a path comes to again have visits to number; the others don't move for that.
    """
    ids = segs.select("path_id", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = lambda c: near_steps(g.steps.where(c), ids, F.col("s"), F.col("e")).where("s <= pos AND pos < e")
    nth = F.row_number().over(Window.partitionBy("path_id", "s", "node_id").orderBy("step_rank"))
    rows = hit("visits = 1").withColumn("visit", F.lit(1)).unionByName(hit("visits > 1").withColumn("visit", nth))
    return rows.select("node_id", "visit", "len", F.col("is_rev").alias(f"{k}_rev"), F.col("path_id").alias(f"{k}_id"), F.col("s").alias(f"{k}_start"), F.col("e").alias(f"{k}_end"), "visits")


def _self_coverage(rows: DataFrame) -> DataFrame:
    """``(query_id, query_start, self_coverage)`` of the segments with a node that their path comes to again; it is 1 in all others."""
    key = ["query_id", "query_start"]
    again = rows.where("visits > 1").select(key).distinct()
    return rows.join(again, key, "left_semi").groupBy(key).agg((F.sum(F.col("visits") * F.col("len")) / F.sum("len")).alias("self_coverage"))


def map_segments(g: Graph, queries: DataFrame, targets: DataFrame, best: int = 1, least: float = 0.0) -> DataFrame:
    """The best target segments of each query segment by the share of nodes, visit for visit.

    Segments are ``(path_id, start, end, ...)``; the k-th visit of a node in one is paired with
    the k-th in the other.  Adds ``jaccard``, ``inverted`` (more bases on other strands than on
    equal ones), ``self_coverage`` (mean visits of the query's path to the segment's bases) and
    ``nth``.  Equal shares put the query's own path first, then inverted and later segments.

    Where the best one of a table of segments is asked for among the same table, a segment meets
    itself; pairs whose lengths alone keep them below that share are left out before they move.
    """
    g = with_visits(g)
    q, t = _segment_rows(g, queries, "query"), _segment_rows(g, targets, "target")
    held = queries is targets and best == 1
    if held:  # the bases of each segment's steps bound what it can share
        whole = lambda k: F.sum("len").over(Window.partitionBy(f"{k}_id", f"{k}_start"))
        q, t = q.withColumn("query_bases", whole("query")), t.withColumn("target_bases", whole("target"))
    inv = F.when(F.col("query_rev") != F.col("target_rev"), F.col("len")).otherwise(0)
    hit = q.drop("visits").join(t.drop("len", "visits"), ["node_id", "visit"])
    q_len, t_len = F.col("query_end") - F.col("query_start"), F.col("target_end") - F.col("target_start")
    if held:
        share = lambda i, both: F.when(both > i, i / F.nullif(both - i, F.lit(0)))
        most = share(F.least("query_bases", "target_bases"), q_len + t_len)
        hit = hit.where(F.coalesce(most >= share(F.col("query_bases"), 2 * q_len), F.lit(True)))
    # Pairs move once: sums and places are both within a query segment.
    hit = hit.select("query_id", "query_start", "query_end", "target_id", "target_start", "target_end", "len", inv.alias("inv")).repartition("query_id", "query_start")
    hit = hit.groupBy("query_id", "query_start", "query_end", "target_id", "target_start", "target_end").agg(F.sum("len").alias("i"), F.sum("inv").alias("inv"))
    hit = hit.withColumn("jaccard", F.col("i") / (q_len + t_len - F.col("i"))).withColumn("inverted", F.col("inv") * 2 > F.col("i"))
    own_path = (F.col("query_id") == F.col("target_id")).cast("int")
    order = Window.partitionBy("query_id", "query_start").orderBy(F.desc("jaccard"), F.desc(own_path), F.desc("inverted"), F.desc("target_id"), F.desc("target_start"))
    ranked = hit.withColumn("nth", F.row_number().over(order)).where((F.col("nth") <= best) & (F.col("jaccard") >= least))
    ranked = ranked.join(_self_coverage(q), ["query_id", "query_start"], "left").withColumn("self_coverage", F.coalesce("self_coverage", F.lit(1.0)))
    return ranked.select("query_id", "query_start", "query_end", "target_id", "target_start", "target_end", "jaccard", "inverted", "self_coverage", "nth")


def cut_nodes(g: Graph, paths: DataFrame, targets: DataFrame, merge: int = 0) -> DataFrame:
    """``(node_id)`` on which segments begin: loop ends of the paths, and where they first and last meet a target."""
    cuts = segment_paths(g, paths, merge=merge).select("path_id", F.col("start_rank").alias("step_rank"))
    own = g.steps.join(cuts, ["path_id", "step_rank"], "left_semi").select("node_id")
    hit = g.steps.join(targets.select("path_id"), "path_id", "left_semi").select("node_id").distinct()
    meet = g.steps.join(paths.select("path_id"), "path_id", "left_semi").join(hit, "node_id", "left_semi")
    ends = meet.groupBy("path_id").agg(F.min_by("node_id", "step_rank").alias("a"), F.max_by("node_id", "step_rank").alias("z"))
    return own.union(ends.select(F.explode(F.array("a", "z")).alias("node_id"))).distinct()


def untangle(g: Graph, queries: DataFrame, targets: DataFrame, best: int = 1, least: float = 0.0, merge: int = 0, cuts: DataFrame | None = None) -> DataFrame:
    """Query paths in segments, each mapped to its most similar target segments.

    Both are cut at their loops and on the nodes of ``cuts``, by default those of
    :func:`cut_nodes` for all of them.
    """
    g = with_visits(g)
    if cuts is None:
        cuts = cut_nodes(g, queries.select("path_id").union(targets.select("path_id")).distinct(), targets, merge)
    cuts = materialize(cuts, "cut-nodes")
    t = materialize(segment_paths(g, targets, cuts, merge), "target-segments")
    q = materialize(segment_paths(g, queries, cuts, merge), "query-segments")
    return map_segments(g, q, t, best, least)


def merge_mappings(mappings: DataFrame) -> DataFrame:
    """Neighbouring mappings that continue each other on query and target, on one strand, as one."""
    w = Window.partitionBy("query_id", "target_id", "inverted").orderBy("query_start")
    ahead = F.when(F.col("inverted"), F.lag("target_start").over(w) == F.col("target_end")).otherwise(F.lag("target_end").over(w) == F.col("target_start"))
    goes_on = (F.lag("query_end").over(w) == F.col("query_start")) & ahead
    m = mappings.where("nth = 1").withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return m.groupBy("query_id", "target_id", "inverted", "run").agg(F.min("query_start").alias("query_start"), F.max("query_end").alias("query_end"), F.min("target_start").alias("target_start"), F.max("target_end").alias("target_end"), F.avg("jaccard").alias("jaccard")).drop("run")


# --- what mappings are written as ----------------------------------------------------------


def _named(g: Graph, mappings: DataFrame) -> DataFrame:
    """Mappings with the names and lengths of both paths, and a strand of ``+`` or ``-``."""
    p = g.path_lengths()
    of = lambda k: p.select(F.col("path_id").alias(f"{k}_id"), F.col("path_name").alias(f"{k}_name"), F.col("length_bp").alias(f"{k}_length"))
    return mappings.join(of("query"), "query_id").join(of("target"), "target_id").withColumn("strand", F.when(F.col("inverted"), "-").otherwise("+"))


def paf(g: Graph, mappings: DataFrame) -> DataFrame:
    """The columns of a PAF file: names, lengths and ranges of both paths, then identity, similarity, self coverage and place.

    Matching bases are not counted (0), the block is the longer of both ranges, the quality 255.
    """
    span = F.greatest(F.col("target_end") - F.col("target_start"), F.col("query_end") - F.col("query_start"))
    return _named(g, mappings).select(
        "query_name", "query_length", "query_start", "query_end", "strand", "target_name", "target_length", "target_start", "target_end",
        F.lit(0).cast("long").alias("matches"), span.alias("block"), F.lit(255).alias("quality"), percent_identity(F.col("jaccard")).alias("identity"), "jaccard", "self_coverage", "nth",
    )


def paf_lines(rows: DataFrame) -> DataFrame:
    """``(value)``: rows of :func:`paf` as text, with the tags ``id jc sc nb``."""
    tag = lambda name, kind, c: F.concat(F.lit(f"{name}:{kind}:"), F.col(c).cast("string"))
    plain = [F.col(c).cast("string") for c in rows.columns[:12]]
    return rows.select(F.concat_ws("\t", *plain, tag("id", "f", "identity"), tag("jc", "f", "jaccard"), tag("sc", "f", "self_coverage"), tag("nb", "i", "nth")).alias("value"))


def bedpe(g: Graph, mappings: DataFrame) -> DataFrame:
    """The columns of a BEDPE file: both ranges, similarity, strand, self coverage and place."""
    return _named(g, mappings).select("query_name", "query_start", "query_end", "target_name", "target_start", "target_end", "jaccard", "strand", "self_coverage", "nth")


def gene_order(g: Graph, mappings: DataFrame) -> DataFrame:
    """``(query_name, place, target_name, query_start, query_end, target_start, target_end, inverted)``: targets along each query.

    Successive mappings of a query (by start, then place) are one range where they go on without a
    gap on the query and on one target, on one strand.  ``place`` counts from 0.
    """
    w = Window.partitionBy("query_id").orderBy("query_start", "nth")
    same = [F.lag(a).over(w) == F.col(b) for a, b in (("target_id", "target_id"), ("inverted", "inverted"), ("query_end", "query_start"), ("target_end", "target_start"))]
    goes_on = F.coalesce(same[0] & same[1] & same[2] & same[3], F.lit(False))
    runs = mappings.withColumn("place", F.sum(F.when(goes_on, 0).otherwise(1)).over(w) - 1)
    one = runs.groupBy("query_id", "target_id", "inverted", "place").agg(F.min("query_start").alias("query_start"), F.max("query_end").alias("query_end"), F.min("target_start").alias("target_start"), F.max("target_end").alias("target_end"))
    return _named(g, one).select("query_name", "place", "target_name", "query_start", "query_end", "target_start", "target_end", "inverted")


def gene_order_lines(order: DataFrame) -> DataFrame:
    """``(value)``: a line for each query: its name, a tab, and the targets' ranges with commas between."""
    span = F.concat("target_name", F.lit(":"), F.col("target_start").cast("string"), F.lit("-"), F.col("target_end").cast("string"))
    rows = order.groupBy("query_name").agg(F.sort_array(F.collect_list(F.struct("place", span.alias("s")))).alias("r"))
    return rows.select(F.concat("query_name", F.lit("\t"), F.array_join(F.transform("r", lambda x: x["s"]), ",")).alias("value"))


def gene_arrows(order: DataFrame, schematic: bool = False) -> DataFrame:
    """``(molecule, gene, start, end, strand)`` for plots of gene arrows; ``schematic`` sets ranges of 100 at gaps of 50."""
    start = F.col("place") * 150 if schematic else F.col("query_start")
    end = start + 100 if schematic else F.col("query_end")
    return order.select(F.col("query_name").alias("molecule"), F.col("target_name").alias("gene"), start.alias("start"), end.alias("end"), F.when(F.col("inverted"), 0).otherwise(1).alias("strand"))
