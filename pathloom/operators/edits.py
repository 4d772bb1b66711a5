"""Operators from graph to graph: chop, crush, flip, inject, prune, squeeze, order, extract, unchop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.dna import crush_n, reverse_complement
from pathloom.functions.names import subpath
from pathloom.operators.paths import drop_empty_paths, orientation_balance
from pathloom.operators.ranges import near_steps, range_steps
from pathloom.plans.components import connected_components
from pathloom.plans.graph import Graph, by_step, canonical_edges, step_edges, with_pan_pos, with_positions
from pathloom.plans.prefix import dense_index
from pathloom.plans.scratch import drop, materialize


def renumber(g: Graph, order: DataFrame) -> Graph:
    """Nodes renumbered 1, 2, ... by ``order(node_id, nth[, flip])``; flipped nodes turn over everywhere."""
    o = order if "flip" in order.columns else order.withColumn("flip", F.lit(False))
    m = o.select(F.col("node_id").alias("old"), (F.col("nth") + 1).cast("long").alias("new"), "flip")
    n = g.nodes.join(m, g.nodes.node_id == m.old)
    nodes = with_pan_pos(n.select(F.col("new").alias("node_id"), F.when(F.col("flip"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), (F.col("new") - 1).alias("rank")))
    ends = lambda k: m.select(F.col("old").alias(f"{k}_old"), F.col("new").alias(f"{k}_new"), F.col("flip").alias(f"{k}_flip"))
    e = g.edges.join(ends("f"), F.col("from_id") == F.col("f_old")).join(ends("t"), F.col("to_id") == F.col("t_old"))
    edges = canonical_edges(e.select(F.col("f_new").alias("from_id"), (F.col("from_rev") != F.col("f_flip")).alias("from_rev"), F.col("t_new").alias("to_id"), (F.col("to_rev") != F.col("t_flip")).alias("to_rev")))
    s = g.steps.join(m, g.steps.node_id == m.old)
    steps = s.select("path_id", "step_rank", F.col("new").alias("node_id"), (F.col("is_rev") != F.col("flip")).alias("is_rev"), "len", "pos")
    return Graph(nodes, edges, g.paths, steps)


def compact_ids(g: Graph) -> Graph:
    """Ids 1, 2, ... in storage order."""
    return renumber(g, dense_index(g.nodes.select("node_id", "rank"), ["rank"], "nth").select("node_id", "nth"))


def _pieces(g: Graph, cuts: DataFrame) -> tuple[Graph, DataFrame]:
    """Nodes cut at inner offsets ``cuts(node_id, offsets)`` (sorted, distinct), ids renumbered in order; and the pieces.

    Of these ``(node_id, k, last, piece_id, at, size)``: number ``k`` of ``last``, from ``at`` on.
    """
    n = g.nodes.join(cuts, "node_id", "left").withColumn("offsets", F.coalesce("offsets", F.array().cast("array<bigint>")))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("offsets"))
    n = n.select("node_id", "seq", "len", "rank", F.posexplode(F.arrays_zip(starts.alias("a"), F.concat(F.col("offsets"), F.array("len")).alias("z"))).alias("k", "p"), F.size("offsets").alias("last"))
    n = n.select("node_id", "k", "last", "rank", F.col("p.a").alias("at"), F.expr("substring(seq, cast(p.a + 1 AS int), cast(p.z - p.a AS int))").alias("seq"))
    made = materialize(dense_index(n, ["rank", "k"], "nth").withColumn("piece_id", F.col("nth") + 1), "pieces-of-nodes")
    pieces = made.select("node_id", "k", "last", "piece_id", "at", F.length("seq").cast("long").alias("size"))
    ids = pieces.select("node_id", "k", "last", "piece_id")
    # The way through a node's pieces is an edge; old edges leave and enter at its outer pieces.
    inner = ids.where("k < last").select(F.col("piece_id").alias("from_id"), F.lit(False).alias("from_rev"), (F.col("piece_id") + 1).alias("to_id"), F.lit(False).alias("to_rev"))
    ends = ids.groupBy("node_id").agg(F.min("piece_id").alias("lo"), F.max("piece_id").alias("hi"))
    e = g.edges.join(ends.select(F.col("node_id").alias("from_id"), F.col("lo").alias("flo"), F.col("hi").alias("fhi")), "from_id").join(ends.select(F.col("node_id").alias("to_id"), F.col("lo").alias("tlo"), F.col("hi").alias("thi")), "to_id")
    outer = e.select(F.when(F.col("from_rev"), F.col("flo")).otherwise(F.col("fhi")).alias("from_id"), "from_rev", F.when(F.col("to_rev"), F.col("thi")).otherwise(F.col("tlo")).alias("to_id"), "to_rev")
    s = g.steps.select("path_id", "step_rank", "node_id", "is_rev").join(ids, "node_id")
    part = F.when(F.col("is_rev"), F.col("last") - F.col("k")).otherwise(F.col("k"))
    s = s.withColumn("new_rank", F.row_number().over(Window.partitionBy("path_id").orderBy("step_rank", part)) - 1)
    nodes = materialize(with_pan_pos(made.select(F.col("piece_id").alias("node_id"), "seq", F.col("nth").alias("rank"))), "pieces")
    steps = with_positions(s.select("path_id", F.col("new_rank").alias("step_rank"), F.col("piece_id").alias("node_id"), "is_rev"), nodes)
    return Graph(nodes, canonical_edges(outer.union(inner)), g.paths, steps), pieces


def chop(g: Graph, most: int) -> Graph:
    """Nodes longer than ``most`` cut every ``most`` bases; ids are renumbered in order."""
    cuts = g.nodes.where(F.col("len") > most).select("node_id", F.sequence(F.lit(most).cast("long"), F.col("len") - 1, F.lit(most).cast("long")).alias("offsets"))
    return _pieces(g, cuts)[0]


def divide(g: Graph, cuts: DataFrame) -> Graph:
    """Nodes cut at the given inner offsets ``(node_id, offset)``."""
    return _divided(g, cuts)[0]


def _divided(g: Graph, cuts: DataFrame) -> tuple[Graph, DataFrame]:
    inside = cuts.join(g.nodes.select("node_id", "len"), "node_id").where("offset > 0 AND offset < len")
    return _pieces(g, inside.groupBy("node_id").agg(F.sort_array(F.collect_set(F.col("offset").cast("long"))).alias("offsets")))


def crush(g: Graph) -> Graph:
    """Runs of N inside nodes become one N."""
    nodes = materialize(with_pan_pos(g.nodes.select("node_id", crush_n(F.col("seq")).alias("seq"), "rank")), "crushed")
    return g.with_(nodes=nodes, steps=with_positions(g.steps, nodes))


def flip_paths(g: Graph, keep: DataFrame | None = None) -> Graph:
    """Paths with more reverse than forward bases are turned over and named ``..._inv``.

    Paths in ``keep`` never turn.  Missing edges between successive steps are added.
    """
    turn = orientation_balance(g).where("reverse_bp > forward_bp").select("path_id")
    if keep is not None:
        turn = turn.join(keep.select("path_id"), "path_id", "left_anti")
    turn = turn.withColumn("turn", F.lit(True))
    n = g.steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))
    s = g.steps.join(n, "path_id").join(turn, "path_id", "left").withColumn("turn", F.coalesce("turn", F.lit(False)))
    s = s.select("path_id", F.when(F.col("turn"), F.col("n") - 1 - F.col("step_rank")).otherwise(F.col("step_rank")).alias("step_rank"), "node_id", (F.col("is_rev") != F.col("turn")).alias("is_rev"))
    paths = g.paths.join(turn, "path_id", "left").select("path_id", F.when(F.col("turn"), F.concat("path_name", F.lit("_inv"))).otherwise(F.col("path_name")).alias("path_name"))
    steps = with_positions(s, g.nodes)
    return Graph(g.nodes, g.edges.union(step_edges(steps)).distinct(), paths, steps)


def inject(g: Graph, ranges: DataFrame) -> Graph:
    """Each range ``(path_id, start, end, name)`` becomes a path; nodes are cut at its ends.

    A name that is there already, or given twice, is an error.  A range's steps are worked out
    from the steps it touches: paths that nobody reads on are never cut.
    """
    ranges = materialize(ranges.select("path_id", "start", "end", "name"), "inject-ranges")
    taken = ranges.select(F.col("name").alias("path_name")).union(g.paths.select("path_name")).groupBy("path_name").count().where("count > 1")
    if first := taken.head():
        raise ValueError(f"path name given twice: {first.path_name}")
    g = g.written("nodes", "steps")
    edge = ranges.select("path_id", F.explode(F.array("start", "end")).alias("at"))
    inside = g.steps.join(edge, "path_id").where("pos < at AND at < pos + len")
    off = F.col("at") - F.col("pos")
    cut, pieces = _divided(g, inside.select("node_id", F.when(F.col("is_rev"), F.col("len") - off).otherwise(off).alias("offset")))
    first_id = g.paths.agg(F.coalesce(F.max("path_id"), F.lit(0)).alias("m"))
    new = dense_index(ranges.select(F.col("path_id").alias("of"), "start", "end", "name"), ["of", "start", "end", "name"], "nth").crossJoin(first_id)
    new = new.select((F.col("m") + 1 + F.col("nth")).alias("path_id"), "of", "start", "end", "name")
    asked = new.select(F.col("path_id").alias("new_id"), F.col("of").alias("path_id"), "start", "end")
    near = near_steps(g.steps, asked, F.col("start"), F.col("end")).where("pos + len >= start AND pos <= end").join(pieces, "node_id")
    before = F.when(F.col("is_rev"), F.col("len") - F.col("at") - F.col("size")).otherwise(F.col("at"))
    part = F.when(F.col("is_rev"), F.col("last") - F.col("k")).otherwise(F.col("k"))
    sub = near.withColumn("pos", F.col("pos") + before).where("pos >= start AND pos + size <= end")
    nth = F.row_number().over(Window.partitionBy("new_id").orderBy("step_rank", part)) - 1
    sub = sub.select(F.col("new_id").alias("path_id"), nth.alias("step_rank"), F.col("piece_id").alias("node_id"), "is_rev", F.col("size").alias("len"), (F.col("pos") - F.col("start")).alias("pos"))
    return Graph(cut.nodes, cut.edges, g.paths.union(new.select("path_id", F.col("name").alias("path_name"))), cut.steps.unionByName(sub))


def injected_paths(g: Graph, ranges: DataFrame) -> Graph:
    """The graph of :func:`inject` with the new paths only: the cut steps of the others are not worked out."""
    made = inject(g, ranges)
    # New ids follow the old ones; a plain bound is pushed below windows and down to the files.
    new = F.col("path_id") > F.lit(g.paths.agg(F.max("path_id")).first()[0]).cast("long")
    return made.with_(paths=made.paths.where(new), steps=made.steps.where(new))


def without_nodes(g: Graph, gone: DataFrame) -> Graph:
    """Without the nodes of ``gone`` and their edges; paths that lose a step are removed."""
    ids = gone.select("node_id").distinct()
    nodes = with_pan_pos(g.nodes.join(ids, "node_id", "left_anti").select("node_id", "seq", "rank"))
    e = g.edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_anti")
    broken = g.steps.join(ids, "node_id", "left_semi").select("path_id").distinct()
    return Graph(nodes, e.select("from_id", "from_rev", "to_id", "to_rev"), g.paths.join(broken, "path_id", "left_anti"), g.steps.join(broken, "path_id", "left_anti"))


def _canonical(pairs: DataFrame) -> DataFrame:
    """Canonical edges of ``(from_handle, to_handle)``."""
    half = lambda c: ((F.floor(F.col(f"{c}_handle") / 2) + 1).cast("long").alias(f"{c}_id"), (F.col(f"{c}_handle") % 2 == 1).alias(f"{c}_rev"))
    return canonical_edges(pairs.select(*half("from"), *half("to")))


def prune(
    g: Graph,
    max_degree: int = 0,
    min_depth: int = 0,
    max_depth: int = 0,
    cut_tips: bool = False,
    min_tip_depth: int = 0,
    drop_empty: bool = False,
    isolated: bool = False,
    edge_depth: bool = False,
    best_edges: int = 0,
    kmer: int = 0,
    max_furcations: int = 0,
) -> Graph:
    """Drop nodes by degree, edges of furcations, nodes or edges by depth, edges beyond the best, tips, isolated nodes and empty paths.

    In this order.  ``kmer`` and ``max_furcations`` go together (edges that a walk of ``kmer`` bases takes as
    one furcation too many); with ``edge_depth`` the depth bounds are on edges; ``best_edges`` keeps each
    node's most walked edges.  Both look at the graph as it is before either drops.  Paths over
    what is dropped go.
    """
    from pathloom.operators.edges import edges_beyond_best, edges_outside_depth
    from pathloom.operators.traverse import furcation_edges, without_edges

    if max_degree:
        g = without_nodes(g, g.degrees().where(F.col("degree") > max_degree))
    if kmer and max_furcations:
        g = without_edges(g, materialize(furcation_edges(g, kmer, max_furcations), "furcations"))
    gone = edges_beyond_best(g, best_edges) if best_edges else None
    few = None
    if edge_depth and (min_depth or max_depth):
        outside = edges_outside_depth(g, min_depth, max_depth)
        gone = outside if gone is None else gone.union(outside)
    elif min_depth or max_depth:
        d = F.col("depth")
        few = materialize(g.depths().where((F.lit(bool(min_depth)) & (d < min_depth)) | (F.lit(bool(max_depth)) & (d > max_depth))), "depths")
    if gone is not None:
        g = without_edges(g, materialize(_canonical(gone), "pruned-edges"))
    if few is not None:
        g = without_nodes(g, few)
    if isolated:
        g = without_nodes(g, isolated_nodes(g))
    if cut_tips:
        tips = g.degrees().where("deg_l = 0 OR deg_r = 0").select("node_id")
        if min_tip_depth:
            tips = tips.join(g.depths().where(F.col("depth") < min_tip_depth).select("node_id"), "node_id", "left_semi")
        g = without_nodes(g, tips)
    return drop_empty_paths(g) if drop_empty else g


def isolated_nodes(g: Graph) -> DataFrame:
    """Nodes without edges whose only step is a whole path."""
    alone = g.degrees().where("degree = 0").select("node_id")
    one = g.steps.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.first("path_id").alias("path_id")).where("n = 1")
    short = g.path_lengths().where("step_count = 1").select("path_id")
    return alone.join(one, "node_id").join(short, "path_id", "left_semi").select("node_id")


def squeeze(graphs: list[Graph], suffix: str | None = None) -> Graph:
    """Several graphs as one: ids of each follow the largest of those before.

    With ``suffix`` path names get it and the number of their graph.
    """
    out, node_shift, path_shift, rank_shift = None, 0, 0, 0
    for k, g in enumerate(graphs, 1):
        name = F.concat("path_name", F.lit(f"{suffix}{k}")) if suffix else F.col("path_name")
        part = Graph(
            g.nodes.select((F.col("node_id") + node_shift).alias("node_id"), "seq", (F.col("rank") + rank_shift).alias("rank")),
            g.edges.select((F.col("from_id") + node_shift).alias("from_id"), "from_rev", (F.col("to_id") + node_shift).alias("to_id"), "to_rev"),
            g.paths.select((F.col("path_id") + path_shift).alias("path_id"), name.alias("path_name")),
            g.steps.select((F.col("path_id") + path_shift).alias("path_id"), "step_rank", (F.col("node_id") + node_shift).alias("node_id"), "is_rev", "len", "pos"),
        )
        out = part if out is None else Graph(*[a.unionByName(b) for a, b in zip((out.nodes, out.edges, out.paths, out.steps), (part.nodes, part.edges, part.paths, part.steps), strict=True)])
        n = g.nodes.agg(F.max("node_id"), F.max("rank")).first()
        node_shift, rank_shift = node_shift + (n[0] or 0), rank_shift + (-1 if n[1] is None else n[1]) + 1
        path_shift += g.paths.agg(F.max("path_id")).first()[0] or 0
    return out.with_(nodes=with_pan_pos(out.nodes))


def expand(g: Graph, seeds: DataFrame, steps: int) -> DataFrame:
    """Nodes within ``steps`` edges of the seeds: a frontier join for each step."""
    sides = g.edges.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("nbr"))
    both = materialize(sides.union(sides.select(F.col("nbr").alias("node_id"), F.col("node_id").alias("nbr"))).distinct(), "neighbours")
    seen = frontier = materialize(seeds.select("node_id").distinct(), "seen")
    for _ in range(steps):
        new = both.join(frontier, "node_id", "left_semi").select(F.col("nbr").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        frontier = materialize(new, "frontier")
        if frontier.isEmpty():
            break
        seen = materialize(seen.union(frontier), "seen")
    return seen


def expand_bp(g: Graph, seeds: DataFrame, length: int) -> DataFrame:
    """The seeds and whole rounds of their neighbours until the nodes added hold ``length`` base pairs."""
    sides = g.edges.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("nbr"))
    both = materialize(sides.union(sides.select(F.col("nbr").alias("node_id"), F.col("node_id").alias("nbr"))).distinct(), "neighbours")
    seen = frontier = materialize(seeds.select("node_id").distinct(), "seen")
    added = 0
    while added < length:
        new = both.join(frontier, "node_id", "left_semi").select(F.col("nbr").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        frontier = materialize(new.join(g.nodes.select("node_id", "len"), "node_id"), "frontier")
        bp = frontier.agg(F.sum("len")).first()[0]
        if bp is None:
            break
        added += bp
        seen = materialize(seen.union(frontier.select("node_id")), "seen")
    drop(both)
    return seen


def flanks(g: Graph, ranges: DataFrame) -> DataFrame:
    """What each range leaves of its path: up to two ranges before and after it."""
    r = ranges.select("path_id", "start", "end").join(g.path_lengths().select("path_id", "length_bp"), "path_id")
    two = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("start").cast("long").alias("end")), F.struct(F.col("end").cast("long").alias("start"), F.col("length_bp").alias("end")))
    return r.select("path_id", F.explode(two).alias("r")).select("path_id", "r.start", "r.end").where("start < end")


def fill_gaps(g: Graph, keep: DataFrame, max_gap: int, rounds: int) -> DataFrame:
    """``keep(node_id)`` with the nodes of stretches that paths leave it for.

    A stretch lies between two steps of a path on kept nodes and holds at most ``max_gap``
    base pairs.  What a round adds may close further stretches; ``rounds`` bounds that.
    """
    for _ in range(rounds):
        inside = g.steps.join(keep, "node_id", "left_semi").select("path_id", "step_rank", (F.col("pos") + F.col("len")).alias("start"), "pos")
        after = inside.withColumn("end", F.lead("pos").over(by_step())).withColumn("next", F.lead("step_rank").over(by_step()))
        gaps = after.where((F.col("next") > F.col("step_rank") + 1) & (F.col("end") - F.col("start") <= max_gap)).select("path_id", "start", "end")
        new = materialize(range_steps(g.steps, gaps).select("node_id").distinct().join(keep, "node_id", "left_anti"), "gap-nodes")
        if new.isEmpty():
            drop(new)
            break
        keep, old = materialize(keep.union(new), "kept-nodes"), keep
        drop(new)
        drop(old)
    return keep


def laced(g: Graph, keep: DataFrame, lace: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph in which the stretches of the paths ``lace`` outside ``keep`` are a node each, and ``keep`` with these.

    A stretch's sequence reads along the path; its node gets an id and a rank after all others.
    """
    s = g.steps.join(lace.select("path_id").distinct(), "path_id", "left_semi")
    out = s.join(keep, "node_id", "left_anti")
    if out.isEmpty():
        return g, keep
    out = out.withColumn("run", F.col("step_rank") - F.row_number().over(by_step()))
    seq = F.when(F.col("is_rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    pieces = out.join(g.nodes.select("node_id", "seq"), "node_id").select("path_id", "run", "step_rank", seq.alias("piece"))
    runs = pieces.groupBy("path_id", "run").agg(F.min("step_rank").alias("step_rank"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step_rank", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    top = g.nodes.agg(F.max("node_id").alias("top_id"), F.max("rank").alias("top_rank"))
    made = dense_index(runs, ["path_id", "run"], "nth").crossJoin(top)  # one row
    made = materialize(made.select((F.col("top_id") + 1 + F.col("nth")).alias("node_id"), (F.col("top_rank") + 1 + F.col("nth")).alias("rank"), "seq", "path_id", "step_rank"), "laced")
    nodes = materialize(with_pan_pos(g.nodes.select("node_id", "seq", "rank").unionByName(made.select("node_id", "seq", "rank"))), "laced-nodes")
    stay = g.steps.select("path_id", "step_rank", "node_id", "is_rev").join(out.select("path_id", "step_rank"), ["path_id", "step_rank"], "left_anti")
    whole = stay.unionByName(made.select("path_id", "step_rank", "node_id", F.lit(False).alias("is_rev")))
    steps = materialize(with_positions(whole.withColumn("step_rank", F.row_number().over(by_step()) - 1), nodes), "laced-steps")
    return g.with_(nodes=nodes, steps=steps), materialize(keep.union(made.select("node_id")), "kept-nodes")


def extract(
    g: Graph,
    nodes: DataFrame | None = None,
    ranges: DataFrame | None = None,
    context_steps: int = 0,
    inverse: bool = False,
    context_bp: int = 0,
    pangenome: tuple[int, int] | None = None,
    full_range: bool = False,
    max_gap: int = 300_000,
    gap_rounds: int = 6,
    lace: DataFrame | None = None,
) -> Graph:
    """The sub-graph of some nodes and of the nodes that ranges touch.

    In this order: seeds ``nodes`` grow by ``context_steps`` edges or by rounds of edges until
    they gained ``context_bp``; with ``inverse`` they turn into all other nodes, and ranges into
    what they leave of their path or of the graph; nodes touched by ``ranges`` and by the graph
    range ``pangenome`` (both ends included) are added, with ``full_range`` all ids between the
    smallest and the largest too; stretches of at most ``max_gap`` base pairs that other paths
    make outside are filled in (:func:`fill_gaps`, up to ``gap_rounds``).  Paths that ranges name
    come out as these ranges, widened to whole nodes; the others as their maximal runs inside.
    Both are named ``path:start-end`` unless they are the whole path.  What the paths of ``lace``
    have outside becomes a node a stretch, so they stay whole.
    """
    if context_steps and context_bp:
        raise ValueError("grow by steps or by base pairs, not by both")
    g = g.written("nodes", "edges", "steps")  # each is read many times
    keep = nodes.select("node_id").distinct() if nodes is not None else None
    if keep is not None and context_steps:
        keep = expand(g, keep, context_steps)
    if keep is not None and context_bp:
        keep = expand_bp(g, keep, context_bp)
    if keep is not None and inverse and not keep.isEmpty():
        keep = g.nodes.select("node_id").join(keep, "node_id", "left_anti")
    parts = [keep] if keep is not None else []
    spans = named = None
    if ranges is not None:
        asked = flanks(g, ranges) if inverse else ranges.select("path_id", "start", "end")
        named = asked.select("path_id").distinct()
        hit = materialize(range_steps(g.steps, asked.distinct()), "range-steps")
        parts.append(hit.select("node_id"))
        # Widened to whole nodes, different ranges may be the same one.
        spans = hit.groupBy("path_id", F.col("start").alias("_s"), F.col("end").alias("_e")).agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("end"))
        spans = materialize(spans.select("path_id", "start", "end").distinct(), "spans")
    if pangenome is not None:
        a, b = pangenome
        touched = lambda lo, hi: (F.col("pan_pos") + F.col("len") >= lo) & (F.col("pan_pos") <= hi)
        if inverse:
            end = g.nodes.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
            parts += [g.nodes.where(touched(lo, hi)).select("node_id") for lo, hi in ((0, a), (b, end)) if lo < hi]
        else:
            parts.append(g.nodes.where(touched(a, b)).select("node_id"))
    if not parts:
        raise ValueError("name nodes, ranges or a range of the graph")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    keep = materialize(g.nodes.select("node_id").join(found.distinct(), "node_id", "left_semi"), "kept-nodes")
    if full_range:
        edge = keep.agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))  # one row
        keep = materialize(g.nodes.select("node_id").crossJoin(edge).where("node_id BETWEEN lo AND hi").select("node_id"), "kept-nodes")
    rest = g if named is None else g.select_paths(g.paths.join(named, "path_id", "left_anti"))
    if max_gap > 0:
        keep = fill_gaps(rest, keep, max_gap, gap_rounds)
    if lace is not None:
        g, keep = laced(g, keep, lace if named is None else lace.join(named, "path_id", "left_anti"))
    inside = g.nodes.join(keep, "node_id", "left_semi")
    e = g.edges.join(keep.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(keep.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    s = g.steps.join(keep, "node_id", "left_semi")
    if named is not None:
        s = s.join(named, "path_id", "left_anti")
    s = s.withColumn("run", (F.col("step_rank") - F.row_number().over(by_step())).cast("long"))
    runs = s.groupBy("path_id", "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("end"))
    if spans is not None:
        # A range and its steps share the range's start and end; two ranges of a path may share either.
        s = s.withColumn("last", F.lit(None).cast("long")).unionByName(range_steps(g.steps, spans).select("path_id", "step_rank", "node_id", "is_rev", "len", "pos", F.col("start").alias("run"), F.col("end").alias("last")))
        runs = runs.withColumn("last", F.lit(None).cast("long")).unionByName(spans.select("path_id", F.col("start").alias("run"), "start", "end", F.col("end").alias("last")))
    else:
        s, runs = s.withColumn("last", F.lit(None).cast("long")), runs.withColumn("last", F.lit(None).cast("long"))
    runs = dense_index(runs, ["path_id", "run", "end"], "nth").join(g.path_lengths(), "path_id")
    whole = (F.col("start") == 0) & (F.col("end") == F.col("length_bp"))
    runs = materialize(runs.select(F.col("path_id").alias("of"), F.col("run").alias("r"), F.col("last").alias("z"), "start", (F.col("nth") + 1).alias("new_id"), F.when(whole, F.col("path_name")).otherwise(subpath(F.col("path_name"), F.col("start"), F.col("end"))).alias("new_name")), "runs")
    s = s.join(runs, (F.col("path_id") == F.col("of")) & (F.col("run") == F.col("r")) & F.col("last").eqNullSafe(F.col("z")))
    steps = s.select(F.col("new_id").alias("path_id"), (F.row_number().over(Window.partitionBy("new_id").orderBy("step_rank")) - 1).alias("step_rank"), "node_id", "is_rev", "len", (F.col("pos") - F.col("start")).alias("pos"))
    edges = canonical_edges(e.select("from_id", "from_rev", "to_id", "to_rev").union(step_edges(steps)))
    return Graph(with_pan_pos(inside.select("node_id", "seq", "rank")), edges, runs.select(F.col("new_id").alias("path_id"), F.col("new_name").alias("path_name")), steps)


def explode_components(g: Graph, component: DataFrame) -> dict[str, DataFrame]:
    """The four tables with a ``component`` column each, to be written partitioned by it."""
    e = g.edges.join(component.withColumnRenamed("node_id", "from_id"), "from_id")
    s = g.steps.join(component, "node_id")
    p = g.paths.join(s.select("path_id", "component").distinct(), "path_id")
    return {"nodes": g.nodes.join(component, "node_id"), "edges": e, "steps": s, "paths": p}


def simple_links(g: Graph) -> DataFrame:
    """Oriented edges ``(a, a_rev, b, b_rev)`` along which two nodes may be merged.

    The edge is the only one on either side, and every path step over one node goes on to
    the other, so that no path ends, starts or turns between them.
    """
    d = g.degrees().select("node_id", "deg_l", "deg_r")
    side = lambda k: d.select(F.col("node_id").alias(f"{k}_id"), F.col("deg_l").alias(f"{k}_l"), F.col("deg_r").alias(f"{k}_r"))
    e = g.edges.where("from_id <> to_id").join(side("from"), "from_id").join(side("to"), "to_id")
    only = e.where("(CASE WHEN from_rev THEN from_l ELSE from_r END) = 1 AND (CASE WHEN to_rev THEN to_r ELSE to_l END) = 1")
    depth = g.depths().select("node_id", "depth")
    from pathloom.operators.edges import edge_walks

    key = ["from_id", "from_rev", "to_id", "to_rev"]
    walked = only.select(*key).join(edge_walks(g), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    walked = walked.join(depth.select(F.col("node_id").alias("from_id"), F.col("depth").alias("df")), "from_id").join(depth.select(F.col("node_id").alias("to_id"), F.col("depth").alias("dt")), "to_id")
    return walked.where("n = df AND n = dt").select(*key)


def unchop(g: Graph) -> Graph:
    """Merge maximal chains of nodes that nothing distinguishes; path sequences stay.

    Chains are components of mergeable links; a chain's nodes are brought in line from
    its end by doubling jumps, so the rounds grow with the logarithm of its length.
    Circles have no end and stay as they are.
    """
    link = materialize(simple_links(g), "simple-links")
    # Each oriented node and the one that follows it, in both reading directions.
    nxt = link.select(F.struct(F.col("from_id").alias("id"), F.col("from_rev").alias("rev")).alias("h"), F.struct(F.col("to_id").alias("id"), F.col("to_rev").alias("rev")).alias("t"))
    turned = link.select(F.struct(F.col("to_id").alias("id"), (~F.col("to_rev")).alias("rev")).alias("h"), F.struct(F.col("from_id").alias("id"), (~F.col("from_rev")).alias("rev")).alias("t"))
    back = nxt.union(turned).select(F.col("t").alias("h"), F.col("h").alias("p"), F.lit(1).cast("long").alias("d"))
    starts = back.select(F.col("p").alias("h")).distinct().join(back.select("h"), "h", "left_anti").select("h", F.col("h").alias("p"), F.lit(0).cast("long").alias("d"))
    rows = materialize(back.union(starts), "jumps")
    total = rows.count()
    rounds = 0
    while True:  # p: the node d places before; chains shrink to their start
        step = rows.select(F.col("h").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"))
        jumped = rows.join(step, "p").select("h", F.col("pp").alias("p"), (F.col("d") + F.col("dd")).alias("d"))
        new = materialize(jumped, "jumps")
        moved = new.agg(F.sum("d")).first()[0] != rows.agg(F.sum("d")).first()[0]
        drop(rows)
        rows, rounds = new, rounds + 1
        if not moved or 1 << rounds > 2 * total:
            break
    at_start = rows.join(starts.select(F.col("h").alias("p")), "p", "left_semi")
    chain = connected_components(link, "from_id", "to_id").withColumnRenamed("node", "id")
    lined = at_start.select(F.col("h.id").alias("id"), F.col("h.rev").alias("rev"), F.col("p").alias("start"), "d").join(chain, "id")
    # Of the two ways to read a chain, the one that starts at the smaller handle.
    first = lined.where("d = 0").groupBy("component").agg(F.min("start").alias("start"))
    lined = materialize(lined.join(first, ["component", "start"]).select("component", "id", "rev", "d"), "chains")
    size = lined.groupBy("component").agg(F.max("d").alias("last"))
    n = g.nodes.join(lined.withColumnRenamed("id", "node_id"), "node_id", "left")
    n = n.withColumn("chain", F.coalesce("component", "node_id")).withColumn("d", F.coalesce("d", F.lit(0))).withColumn("part", F.when(F.coalesce("rev", F.lit(False)), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    joined = n.groupBy("chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d", "part"))), lambda x: x["part"]), "").alias("seq"), F.avg("rank").alias("mean"))
    nodes = materialize(dense_index(joined, ["mean", "chain"], "nth").select("chain", "seq", "nth"), "unchopped")
    m = g.nodes.select("node_id").join(lined.withColumnRenamed("id", "node_id"), "node_id", "left").join(size, "component", "left")
    m = m.withColumn("chain", F.coalesce("component", "node_id")).join(nodes.select("chain", "nth"), "chain")
    m = materialize(m.select("node_id", (F.col("nth") + 1).alias("new"), F.coalesce("rev", F.lit(False)).alias("rev"), F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("last", F.lit(0)).alias("last")), "unchop-map")
    s = g.steps.select("path_id", "step_rank", "node_id", "is_rev").join(m, "node_id").withColumn("over", F.col("is_rev") != F.col("rev"))
    # A path enters a chain at its first node in reading direction; that step stands for the chain.
    s = s.where("(NOT over AND d = 0) OR (over AND d = last)")
    s = s.select("path_id", (F.row_number().over(by_step()) - 1).alias("step_rank"), F.col("new").alias("node_id"), F.col("over").alias("is_rev"))
    ends = lambda k: m.select(F.col("node_id").alias(f"{k}_id"), F.col("new").alias(f"{k}_new"), F.col("rev").alias(f"{k}_flip"))
    inner = g.edges.join(link, ["from_id", "from_rev", "to_id", "to_rev"], "left_anti")
    whole = link.join(ends("from"), "from_id").join(ends("to"), "to_id").where("from_new <> to_new").select("from_id", "from_rev", "to_id", "to_rev")
    e = inner.union(whole).join(ends("from"), "from_id").join(ends("to"), "to_id")
    edges = canonical_edges(e.select(F.col("from_new").alias("from_id"), (F.col("from_rev") != F.col("from_flip")).alias("from_rev"), F.col("to_new").alias("to_id"), (F.col("to_rev") != F.col("to_flip")).alias("to_rev")))
    out = with_pan_pos(nodes.select((F.col("nth") + 1).alias("node_id"), "seq", F.col("nth").alias("rank")))
    return Graph(out, edges, g.paths, with_positions(s, out))
