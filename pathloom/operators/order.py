"""Node orders: breadth and topology, path-guided gradient descent in one and two dimensions, grooming.

An order is ``(node_id, nth[, flip])`` for ``edits.renumber``.  Orders that are sequential
by nature run per connected component, one component a task.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.numbers import curve_levels, hilbert_point
from pathloom.operators.edits import renumber
from pathloom.operators.summary import components
from pathloom.operators.traverse import follow
from pathloom.plans.graph import Graph, handle
from pathloom.plans.prefix import dense_index
from pathloom.plans.scratch import materialize

#: Rows of an order that a task gives back at once.
ROWS = 1 << 16


def by_id(g: Graph) -> DataFrame:
    """Nodes by id."""
    return dense_index(g.nodes.select("node_id"), ["node_id"], "nth")


def reverse(g: Graph) -> DataFrame:
    """The storage order backwards."""
    return dense_index(g.nodes.select("node_id", (-F.col("rank")).alias("k")), ["k"], "nth").select("node_id", "nth")


def shuffled(g: Graph, seed: int = 0) -> DataFrame:
    """A seeded random order."""
    return dense_index(g.nodes.select("node_id", F.xxhash64(F.lit(seed), "node_id").alias("k")), ["k", "node_id"], "nth").select("node_id", "nth")


def by_paths(g: Graph, targets: DataFrame) -> DataFrame:
    """Nodes as the target paths first reach them, then the others in storage order."""
    first = g.steps.join(targets.select("path_id"), "path_id", "left_semi").groupBy("node_id").agg(F.min(F.struct("path_id", "step_rank")).alias("m"))
    k = g.nodes.select("node_id", "rank").join(first, "node_id", "left")
    k = k.select("node_id", F.col("m").isNull().alias("rest"), F.coalesce("m.path_id", "rank").alias("a"), F.coalesce("m.step_rank", F.lit(0)).alias("b"))
    return dense_index(k, ["rest", "a", "b", "node_id"], "nth").select("node_id", "nth")


def given(ids: DataFrame) -> DataFrame:
    """An explicit list ``(node_id, nth)``."""
    return ids.select("node_id", "nth")


def _per_component(g: Graph, kernel) -> DataFrame:
    """``(node_id, nth, flip)`` from ``kernel(ways, into)`` on each component.

    The kernel knows a component's nodes by their place among its ids, twice that and one more for
    the other reading.  A component comes to its task sorted, a row for each reading of a node, and
    is never there as a whole: :class:`_Stored`.
    """
    g = g.written("edges")
    c = materialize(components(g), "components")
    ways = follow(g).groupBy("h").agg(F.sort_array(F.collect_list("t")).alias("t"))
    both = c.select("component", F.explode(F.array(handle(F.col("node_id"), F.lit(False)), handle(F.col("node_id"), F.lit(True)))).alias("h"))
    rows = both.join(ways, "h", "left").select("component", "h", F.coalesce("t", F.array().cast("array<long>")).alias("t"))
    # The ids first, then the ways.
    ids = c.select("component", F.lit(0).alias("kind"), F.col("node_id").alias("h"), F.array().cast("array<long>").alias("t"))
    rows = ids.unionByName(rows.withColumn("kind", F.lit(1))).select("component", "kind", "h", "t").repartition("component").sortWithinPartitions("component", "kind", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for component, parts in groupby(_by_component(batches), lambda part: part[0]):
            with _Stored(part[1:] for part in parts) as stored:
                order = np.frombuffer(kernel(stored.ways, stored.into), dtype=np.int32)
                for at in range(0, len(order), ROWS):
                    some = order[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), component)), pa.array(np.arange(at, at + len(some))), pa.array(stored.nodes[some // 2]), pa.array(some % 2 == 1)], ["component", "k", "node_id", "flip"])

    local = materialize(rows.mapInArrow(run, "component long, k long, node_id long, flip boolean"), "component-orders")
    # Components in the order of their mean place.
    mean = local.join(g.nodes.select("node_id", "rank"), "node_id").groupBy("component").agg(F.avg("rank").alias("mean"))
    return dense_index(local.join(mean, "component"), ["mean", "component", "k"], "nth").select("node_id", "nth", "flip")


def _by_component(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(component, kind, h, size, t)`` of each batch's rows, cut where a component ends; ``t`` has the rows' ways behind each other."""
    for batch in batches:
        component, kind, h = (batch.column(i).to_numpy() for i in range(3))
        size, t = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)
        begin = np.concatenate(([0], np.cumsum(size)))
        cut = [0, *(np.flatnonzero(np.diff(component)) + 1).tolist(), len(component)] if len(component) else []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            yield int(component[a]), kind[a:z], h[a:z], size[a:z], t[begin[a] : begin[z]]


class _Stored:
    """A component whose ways lie in a file without a name: memory holds a few words for each node, however many ways it has.

    ``nodes`` are the sorted ids, ``ways(h)`` the places of what may follow a reading, ascending, and
    ``into`` how many ways lead to each: as many as lead on from the other reading.
    """

    def __init__(self, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self._file = tempfile.TemporaryFile()
        ids, sizes = [], []
        nodes = None
        for kind, h, size, t in parts:
            first = int(np.searchsorted(kind, 1))
            ids.append(h[:first].astype(np.int64))
            if first == len(kind):
                continue
            if nodes is None:
                nodes = np.concatenate(ids)
            sizes.append(size[first:].astype(np.int32))  # a row for each reading, in order
            (2 * np.searchsorted(nodes, t // 2 + 1) + t % 2).astype(np.int32).tofile(self._file)
        self.nodes = nodes
        size = np.concatenate(sizes)
        self._begin = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        self.into = array("i", size.reshape(-1, 2)[:, ::-1].tobytes())
        self._file.flush()

    def ways(self, h: int) -> list[int]:
        a, z = int(self._begin[h]), int(self._begin[h + 1])
        return np.frombuffer(os.pread(self._file.fileno(), 4 * (z - a), 4 * a), dtype=np.int32).tolist() if z > a else []

    def __enter__(self) -> _Stored:
        return self

    def __exit__(self, *why) -> None:
        self._file.close()


def _ways(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[Callable[[int], list[int]], np.ndarray]:
    """What may follow each reading of sorted ``nodes``, ascending, over edges from handles ``a`` to ``b``; and how many ways lead to each.

    Ways are two flat arrays: a few words an edge, however many a node has.
    """
    place = lambda h: 2 * np.searchsorted(nodes, h // 2 + 1) + h % 2
    a, b, n = place(a), place(b), 2 * len(nodes)
    both = np.unique(np.concatenate((a * n + b, (b ^ 1) * n + (a ^ 1))))
    begin, to = np.searchsorted(both, np.arange(n + 1) * n), both % n
    return lambda h: to[begin[h] : begin[h + 1]].tolist(), np.bincount(to, minlength=n)


def topological(g: Graph, heads_first: bool = True) -> DataFrame:
    """Each node after those before it, as far as cycles allow.

    Nodes without a way in come first (``heads_first``); where only cycles are left, the
    smallest handle that was reached, or else the smallest of all, breaks one.
    """

    def kernel(out: Callable[[int], list[int]], into: array) -> array:
        left = into[:]
        done, waits = bytearray(len(left) // 2), bytearray(len(left))
        order = array("i")
        rest = iter(range(0, len(left), 2))
        ready = [h for h in range(0, len(left), 2) if not left[h]] if heads_first else []  # ascending: a heap
        reached: list[int] = []
        while len(order) < len(done):
            h = None
            while ready and h is None:
                h = heapq.heappop(ready)
                h = None if done[h // 2] else h
            while reached and h is None:
                h = heapq.heappop(reached)
                h = None if done[h // 2] else h
            while h is None:
                h = next(rest)
                h = None if done[h // 2] else h
            done[h // 2] = True
            order.append(h)
            for t in out(h):
                if not done[t // 2]:
                    left[t] -= 1
                    if left[t] == 0:
                        heapq.heappush(ready, t)
                    elif not waits[t]:  # once is enough
                        waits[t] = True
                        heapq.heappush(reached, t)
        return order

    return _per_component(g, kernel)


def two_way(g: Graph) -> DataFrame:
    """The later of a node's places in the orders with and without heads first."""
    a, b = topological(g), topological(g, heads_first=False)
    both = a.select("node_id", F.col("nth").alias("x")).join(b.select("node_id", F.col("nth").alias("y")), "node_id")
    return dense_index(both.select("node_id", F.greatest("x", "y").alias("k")), ["k", "node_id"], "nth").select("node_id", "nth")


def breadth_first(g: Graph) -> DataFrame:
    """Nodes by their distance from the heads of their component."""
    return _walked(g, depth=False)


def depth_first(g: Graph) -> DataFrame:
    """Nodes as a depth-first walk from the heads of their component meets them."""
    return _walked(g, depth=True)


def _walked(g: Graph, depth: bool) -> DataFrame:
    def kernel(out: Callable[[int], list[int]], into: array) -> array:
        done = bytearray(len(into) // 2)
        order = array("i")
        for head in sorted(range(0, len(into), 2), key=lambda h: (bool(into[h]), h)):
            waiting = deque([head])
            while waiting:
                h = waiting.pop() if depth else waiting.popleft()
                if done[h // 2]:
                    continue
                done[h // 2] = True
                order.append(h)
                ahead = [t for t in out(h) if not done[t // 2]]
                waiting += reversed(ahead) if depth else ahead
        return order

    return _per_component(g, kernel)


def groom(g: Graph, targets: DataFrame | None = None, depth: bool = False) -> Graph:
    """Each node turned so that a walk from the heads reads it forwards; the order stays.

    Nodes on target paths are read as those paths read them first.
    """
    found = _walked(g, depth).select("node_id", "flip")
    if targets is not None:
        first = g.steps.join(targets.select("path_id"), "path_id", "left_semi").groupBy("node_id").agg(F.min_by("is_rev", F.struct("path_id", "step_rank")).alias("t"))
        found = found.join(first, "node_id", "left").select("node_id", F.coalesce("t", "flip").alias("flip"))
    kept = dense_index(g.nodes.select("node_id", "rank"), ["rank"], "nth").select("node_id", "nth")
    return renumber(g, kept.join(found, "node_id"))


def _terms(steps: list[tuple[np.ndarray, np.ndarray]], n: int, rng: np.random.Generator, theta: float, cooling: bool) -> tuple[np.ndarray, ...]:
    """Random pairs of steps of one path: the first uniform, the second some jump away, as far as the path goes.

    Jumps have a density that falls as distance ** -theta, and half of the pairs are uniform in
    their path.  When cooling no pair is, and jumps are of one or two steps as often as the first
    two distances of that law come up, else uniform: near order is set at last while far
    distances hold.
    """
    sizes = np.array([len(s[0]) for s in steps])
    weight = np.where(sizes > 1, sizes, 0)  # a path of one step has no pair
    p = rng.choice(len(steps), n, p=weight / weight.sum())
    a = (rng.random(n) * sizes[p]).astype(np.int64)
    back = (rng.random(n) < 0.5) & (a > 0) | (a == sizes[p] - 1)
    room = np.where(back, a, sizes[p] - 1 - a)
    q = 1 - theta
    spread = ((room + 1.0) ** q - 1) / q  # the law's total over 1 .. room
    if cooling:
        at = rng.random(n) * (spread + np.euler_gamma)
        jump = np.where(at < 1, 1, np.where(at < 2, 2, 1 + rng.random(n) * room))
    else:
        jump = (1 + q * spread * rng.random(n)) ** (1 / q)
    jump = np.clip(jump.astype(np.int64), 1, room)
    b = np.where(back, a - jump, a + jump)
    if not cooling:
        b = np.where(rng.random(n) < 0.5, (rng.random(n) * sizes[p]).astype(np.int64), b)
    ok = a != b
    base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    return base[p[ok]] + a[ok], base[p[ok]] + b[ok]


def _descend(x: np.ndarray, at: np.ndarray, pos: np.ndarray, steps, seed: int, iterations: int, updates: int, theta: float, epsilon: float) -> np.ndarray:
    """Stochastic gradient descent on squared differences of layout and path distance.

    ``x`` is (points, dimensions); ``at`` gives each step's point, ``pos`` its path position.
    """
    rng = np.random.default_rng(seed)
    longest = max(len(s[0]) for s in steps)
    eta_max = float(max(longest, 2)) ** 2
    decay = np.log(eta_max / epsilon) / max(1, iterations - 1)
    for t in range(iterations):
        eta = eta_max * np.exp(-decay * t)
        left = updates
        while left > 0:
            # Small batches: terms of one batch do not see each other's moves.
            n = min(left, max(64, len(x) // 4))
            left -= n
            i, j = _terms(steps, n, rng, theta, t >= iterations // 2)
            d = np.abs(pos[i] - pos[j]).astype(float)
            keep = (d > 0) & (at[i] != at[j])
            i, j, d = at[i[keep]], at[j[keep]], d[keep]
            diff = x[i] - x[j]
            mag = np.sqrt((diff**2).sum(1))
            mag[mag == 0] = 1e-9
            move = (np.minimum(1.0, eta / d) * (mag - d) / 2 / mag)[:, None] * diff
            hits = np.bincount(np.concatenate((i, j)), minlength=len(x))[:, None].clip(1)
            step = np.zeros_like(x)
            np.add.at(step, i, -move)
            np.add.at(step, j, move)
            x += step / hits
    return x


def _layout(g: Graph, dims: int, seed: int, iterations: int, per_step: float, theta: float, start: str = "d") -> DataFrame:
    c = components(g)
    begin = layout_start(g, start, seed).groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("end", "x", "y"))), lambda e: F.array(e["x"], e["y"])).alias("begin"))  # two rows a node
    n = g.nodes.join(c, "node_id").join(begin, "node_id").select("component", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("path_id"), F.lit(0).cast("long").alias("step_rank"), "node_id", F.lit(False).alias("is_rev"), "len", F.col("pan_pos").alias("pos"), F.flatten("begin").alias("begin"))
    s = g.steps.join(c, "node_id").select("component", F.lit(1).alias("kind"), "path_id", "step_rank", "node_id", "is_rev", "len", "pos", F.lit(None).cast("array<double>").alias("begin"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.kind == 0].sort_values("pos")
        walks = pdf[pdf.kind == 1].sort_values(["path_id", "step_rank"])
        place = {n: i for i, n in enumerate(nodes.node_id)}
        k = np.array([place[n] for n in walks.node_id], dtype=np.int64)
        rev, size, pos = walks.is_rev.to_numpy(bool), walks.len.to_numpy(), walks.pos.to_numpy()
        if dims == 1:
            x = nodes.pos.to_numpy(float).reshape(-1, 1).copy()
            at, where = k, pos
        else:  # two points a node: where it begins and where it ends
            x = np.concatenate(nodes.begin.to_list()).astype(float).reshape(-1, 2)
            end = np.random.default_rng(seed + 1).random(len(k)) < 0.5
            at, where = 2 * k + (end != rev), pos + np.where(end, size, 0)
        paths = walks.path_id.to_numpy()
        cut = np.flatnonzero(np.diff(paths)) + 1
        steps = [(a, a) for a in np.split(at, cut)] if len(at) else []
        if len(at) > 1 and max(len(s[0]) for s in steps) > 1:
            x = _descend(x, at, where, steps, seed, iterations, int(max(1, per_step * len(at))), theta, 0.01)
        if dims == 1:
            return pd.DataFrame({"component": pdf.component.iloc[0], "node_id": nodes.node_id.to_numpy(), "end": 0, "x": x[:, 0], "y": 0.0})
        return pd.DataFrame({"component": pdf.component.iloc[0], "node_id": np.repeat(nodes.node_id.to_numpy(), 2), "end": np.tile([0, 1], len(nodes)), "x": x[:, 0], "y": x[:, 1]})

    return materialize(n.union(s).groupBy("component").applyInPandas(run, "component long, node_id long, end int, x double, y double"), "layout")


def path_guided(g: Graph, seed: int = 0, iterations: int = 100, per_step: float = 1.0, theta: float = 0.99) -> DataFrame:
    """Nodes along a line on which path distances are kept, by gradient descent on random step pairs.

    Components follow each other by their mean id; judge the result by ``mean_links_length``.
    """
    x = _layout(g, 1, seed, iterations, per_step, theta)
    mean = x.groupBy("component").agg(F.avg("node_id").alias("mean"))
    return dense_index(x.join(mean, "component"), ["mean", "component", "x", "node_id"], "nth").select("node_id", "nth")


def layout_start(g: Graph, kind: str = "d", seed: int = 0) -> DataFrame:
    """``(node_id, end, x, y)``: where a layout begins.

    ``d``: along the graph, ``y`` normal noise; ``u``: the same with uniform noise; ``r``: uniform along the
    graph's length in both; ``g``: normal noise in both; ``h``: node ends in storage order on a Hilbert
    curve.  Noise is as wide as the square root of twice the nodes, and seeded.
    """
    ends = g.nodes.select("node_id", "rank", "pan_pos", "len", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    along = (F.col("pan_pos") + F.col("end") * F.col("len")).cast("double")
    n, total = g.nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    width = float(2 * n) ** 0.5
    # Two uniform numbers for each end and coordinate, whatever the partitioning.
    unit = lambda k: (F.xxhash64(F.lit(seed), F.lit(k), "node_id", "end").bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2.0 * F.log(unit(k))) * F.cos(2.0 * F.pi() * unit(k + 1)) * width
    # Few bytes, but work for each row: all cores get some, whatever the sizes of the tables say.
    ends = ends.repartition(2 * g.nodes.sparkSession.sparkContext.defaultParallelism)
    if kind == "h":
        p = hilbert_point(F.col("rank") * 2 + F.col("end"), curve_levels(2 * n))
        x, y = p["x"].cast("double"), p["y"].cast("double")
    else:
        ways = {"d": (along, normal(0)), "u": (along, unit(0) * width), "r": (unit(0) * float(total), unit(1) * float(total)), "g": (normal(0), normal(2))}
        x, y = ways[kind]
    return ends.select("node_id", "end", x.alias("x"), y.alias("y"))


def layout_2d(g: Graph, seed: int = 0, iterations: int = 30, per_step: float = 10.0, theta: float = 0.99, border: float = 1000.0, start: str = "d") -> DataFrame:
    """``(node_id, end, x, y)``: node ends in the plane, components stacked with a border between.

    ``start`` names where they begin (:func:`layout_start`).
    """
    x = _layout(g, 2, seed, iterations, per_step, theta, start)
    box = x.groupBy("component").agg(F.min("y").alias("lo"), (F.max("y") - F.min("y") + border).alias("h"), F.min("x").alias("left"))
    from pyspark.sql import Window

    # A row for each component; the running sum goes over their heights.
    base = box.select("component", "lo", "left", (F.sum("h").over(Window.orderBy("component")) - F.col("h")).alias("base"))
    return x.join(base, "component").select("node_id", "end", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("lo") + F.col("base")).alias("y"))


def sort(g: Graph, pipeline: str, targets: DataFrame | None = None, seed: int = 0) -> Graph:
    """Orders applied one after the other: ``s n d w b z r f Y g H`` as letters."""
    steps = {"s": topological, "n": lambda x: topological(x, False), "d": dagified, "w": two_way, "b": breadth_first, "z": depth_first, "f": reverse, "r": lambda x: shuffled(x, seed), "Y": lambda x: path_guided(x, seed), "H": lambda x: by_paths(x, targets)}
    for letter in pipeline:
        if letter == "g":
            g = groom(g, targets)
            continue
        o = steps[letter](g).select("node_id", "nth")
        g = renumber(g, o)
        g = Graph(*[materialize(t, "sorted") for t in (g.nodes, g.edges, g.paths, g.steps)])
    return g


def tension(g: Graph, layout: DataFrame) -> DataFrame:
    """``(node_id, total, mean)``: how much longer or shorter a node is drawn than it is, over its steps.

    A ratio below one counts by its inverse.
    """
    a = layout.where("end = 0").select("node_id", F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = layout.where("end = 1").select("node_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    ratio = F.sqrt(dx * dx + dy * dy) / F.col("len")
    n = g.nodes.join(a, "node_id").join(b, "node_id").join(g.depths(), "node_id").withColumn("ratio", F.when(ratio < 1, 1 / ratio).otherwise(ratio))
    total = F.col("ratio") * F.col("depth")
    return n.select("node_id", total.alias("total"), F.when(F.col("depth") > 0, F.col("ratio")).alias("mean"))


def path_tension(g: Graph, layout: DataFrame, window: int) -> DataFrame:
    """``(path_id, start, end, layout_dist, nuc_dist, ratio)`` of windows of at least ``window`` bases."""
    p = g.steps.join(layout.where("end = 0").select("node_id", F.col("x").alias("xa"), F.col("y").alias("ya")), "node_id").join(layout.where("end = 1").select("node_id", F.col("x").alias("xb"), F.col("y").alias("yb")), "node_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step_rank")
        rows, start, drawn, prev = [], None, 0.0, None
        for r in pdf.itertuples():
            a, b = ((r.xa, r.ya), (r.xb, r.yb))[:: -1 if r.is_rev else 1]
            start = r.pos if start is None else start
            drawn += (0.0 if prev is None else float(np.hypot(a[0] - prev[0], a[1] - prev[1]))) + float(np.hypot(a[0] - b[0], a[1] - b[1]))
            prev = b
            if r.pos + r.len - start >= window:
                rows.append((r.path_id, start, r.pos + r.len, drawn, r.pos + r.len - start))
                start, drawn = None, 0.0
        if start is not None:
            rows.append((pdf.path_id.iloc[0], start, int((pdf.pos + pdf.len).iloc[-1]), drawn, int((pdf.pos + pdf.len).iloc[-1]) - start))
        out = pd.DataFrame(rows, columns=["path_id", "start", "end", "layout_dist", "nuc_dist"])
        return out.assign(ratio=out.layout_dist / out.nuc_dist)

    return p.groupBy("path_id").applyInPandas(run, "path_id long, start long, end long, layout_dist double, nuc_dist long, ratio double")


def cycle_breaking(g: Graph, max_bp: int = 1 << 20, max_steps: int | None = None) -> DataFrame:
    """The topological order of the graph without the edges that close short cycles."""
    from pathloom.operators.traverse import break_cycles

    bare = g.with_(paths=g.paths.limit(0), steps=g.steps.limit(0))
    return topological(break_cycles(bare, max_bp, max_steps), heads_first=False)


def by_strands(g: Graph) -> DataFrame:
    """Nodes as either of their strands comes first in the order of the strand-split graph."""
    from pathloom.operators.traverse import split_strands

    bare = split_strands(g.with_(paths=g.paths.limit(0), steps=g.steps.limit(0)))
    first = topological(bare).groupBy(F.floor((F.col("node_id") + 1) / 2).alias("node_id")).agg(F.min("nth").alias("k"))
    return dense_index(first, ["k", "node_id"], "nth").select("node_id", "nth")


def dagified(g: Graph) -> DataFrame:
    """Nodes by the mean place of their forward copies in the topological order of the unrolled, strand-split graph."""
    from pathloom.operators.structure import dagify
    from pathloom.operators.traverse import split_strands

    dag, names = dagify(split_strands(g.with_(paths=g.paths.limit(0), steps=g.steps.limit(0))), 1)
    # Splitting made 2k - 1 of node k's forward reading.
    forward = topological(dag).join(names, "node_id").where("old_id % 2 = 1").select(((F.col("old_id") + 1) / 2).cast("long").alias("node_id"), "nth")
    return dense_index(forward.groupBy("node_id").agg(F.avg("nth").alias("k")), ["k", "node_id"], "nth").select("node_id", "nth")
