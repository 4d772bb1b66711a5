"""Embedding near-dedup by collision-counting projections.

All vectors are projected on many random directions and each projection is sorted.  A
vector's window in a projection is centred on its own value; two vectors collide there
if one lies in the other's window.  Pairs with enough collisions are verified by their
cosine.  Window width and count come from the distance at the threshold: the projected
difference of such a pair is close to normal, which gives the chance of a collision and,
over all projections, the count that the wanted recall allows.

Equal vectors are one entry with a size.  Entries are cut into slabs of the first
projection, and each pair of slabs within a (wider) window of each other is one bounded
task, so memory does not grow with the table.  A task reports each vector's number of
links and one link to its group, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.blocks import fresh
from pathloom.plans.components import connected_components
from pathloom.plans.scratch import materialize

PROJECTIONS = 16
#: Half width of a window, and of the slab filter, in standard deviations at the threshold.
WINDOW, SLAB_WINDOW = 2.5, 4.0
SLAB_ROWS = 4096
QUERIES = 256


def misses_allowed(recall: float, projections: int = PROJECTIONS, window: float = WINDOW) -> int:
    """The fewest missed windows that still find a pair at the threshold with this recall."""
    miss = 1 - erf(window / sqrt(2))
    total = 0.0
    for k in range(projections + 1):
        total += comb(projections, k) * miss**k * (1 - miss) ** (projections - k)
        if total >= recall:
            return k
    return projections


def directions(dim: int) -> np.ndarray:
    """Random unit vectors, one a column; fixed by the dimension."""
    x = np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))
    return x / np.linalg.norm(x, axis=0)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # Scaled first, so that neither huge nor tiny components leave the range of doubles.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similar_pairs(a: np.ndarray, b: np.ndarray | None, cosine: float, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the verified pairs of rows of ``a`` and ``b`` (of ``a`` itself for None)."""
    dirs = directions(a.shape[1])
    sigma = sqrt(2 * (1 - cosine) / a.shape[1]) if cosine < 1 else 0.0
    half = max(WINDOW * sigma, 1e-9)
    pa_, own = a @ dirs, b is None
    b, pb = (a, pa_) if own else (b, b @ dirs)
    order = np.argsort(pb[:, 0], kind="stable")
    ranks, low, span = [], [], []
    for k in range(PROJECTIONS):
        by_value = np.argsort(pb[:, k], kind="stable")
        rank = np.empty(len(by_value), dtype=np.uint32)
        rank[by_value] = np.arange(len(by_value), dtype=np.uint32)
        values = pb[by_value, k]
        lo = np.searchsorted(values, pa_[:, k] - half, side="left").astype(np.uint32)
        ranks.append(rank[order])
        low.append(lo)
        span.append(np.searchsorted(values, pa_[:, k] + half, side="right").astype(np.uint32) - lo)
    queries = np.argsort(pa_[:, 0], kind="stable")
    reach = max(SLAB_WINDOW * sigma, 1e-9)
    first = np.searchsorted(pb[order, 0], pa_[queries, 0] - reach, side="left")
    last = np.searchsorted(pb[order, 0], pa_[queries, 0] + reach, side="right")
    dense = PROJECTIONS // 2
    left, right = [], []
    for at in range(0, len(queries), QUERIES):
        q = queries[at : at + QUERIES]
        c0, c1 = int(first[at : at + QUERIES].min()), int(last[at : at + QUERIES].max())
        if own:
            c0 = max(c0, at)  # the same order on both sides: each pair once
        if c1 <= c0:
            continue
        missed = np.zeros((len(q), c1 - c0), dtype=np.uint8)
        for k in range(dense):
            missed += (ranks[k][None, c0:c1] - low[k][q, None]) >= span[k][q, None]
        i, j = np.nonzero(missed <= allowed)
        count, x, y = missed[i, j].astype(np.int64), q[i], j + c0
        if own:
            keep = y > i + at
            count, x, y = count[keep], x[keep], y[keep]
        for k in range(dense, PROJECTIONS):
            count += (ranks[k][y] - low[k][x]) >= span[k][x]
            keep = count <= allowed
            count, x, y = count[keep], x[keep], y[keep]
        y = order[y]
        for p in range(0, len(x), 1 << 15):
            u, v = x[p : p + (1 << 15)], y[p : p + (1 << 15)]
            near = np.einsum("ij,ij->i", a[u], b[v]) >= cosine
            left.append(u[near])
            right.append(v[near])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _tile(table: pa.Table, dim: int, cosine: float, allowed: int) -> pa.Table:
    """A pair of slabs: for each linked entry its links here and its group's first entry."""
    table = table.combine_chunks()
    ids, sizes, side = (table.column(c).to_numpy() for c in ("cid", "size", "side"))
    x = _unit(table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v"), dim)
    if side.max(initial=0) == 0:
        u, v = similar_pairs(x, None, cosine, allowed)
    else:
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if not len(a) or not len(b):
            u = v = np.zeros(0, dtype=np.int64)
        else:
            u, v = similar_pairs(x[a], x[b], cosine, allowed)
            u, v = a[u], b[v]
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, u, sizes[v])
    np.add.at(links, v, sizes[u])
    group = ids.copy()
    while True:
        least = np.minimum(group[u], group[v])
        if (group[u] == least).all() and (group[v] == least).all():
            break
        np.minimum.at(group, u, least)
        np.minimum.at(group, v, least)
    at = np.flatnonzero(links)
    return pa.table({"cid": pa.array(ids[at], pa.int64()), "links": pa.array(links[at], pa.int64()), "group": pa.array(group[at], pa.int64())})


def _links_of_dimension(entries: DataFrame, dim: int, cosine: float, recall: float, slab_rows: int) -> DataFrame:
    """``(cid, links, group)`` rows for the entries of one dimension."""
    main = directions(dim)[:, 0]
    allowed = misses_allowed(recall)
    reach = max(SLAB_WINDOW * sqrt(2 * (1 - cosine) / dim) if cosine < 1 else 0.0, 1e-9)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(2), dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x @ main, pa.float64())], [*batch.schema.names, "p"])

    rows = entries.select("cid", "size", "v")
    placed = materialize(rows.mapInArrow(project, "cid long, size long, v array<double>, p double"), "projections")
    n = placed.count()
    slabs = max(1, -(-n // slab_rows))
    edges = []
    if slabs > 1:  # one number for some thousand entries
        edges = sorted(set(placed.agg(F.percentile_approx("p", [i / slabs for i in range(1, slabs)], 100 * slabs)).first()[0]))
    lower = np.array([-np.inf, *edges])
    upper = np.array([*edges, np.inf])
    partners = [[u for u in range(len(lower)) if lower[u] - upper[s] <= reach and lower[s] - upper[u] <= reach] for s in range(len(lower))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slab = np.searchsorted(np.array(edges), batch.column(3).to_numpy(), side="right")
            row = np.repeat(np.arange(len(slab)), [len(partners[s]) for s in slab])
            with_ = np.concatenate([np.array(partners[s]) for s in slab]) if len(slab) else np.zeros(0, dtype=np.int64)
            own = slab[row]
            side = np.where(with_ == own, 0, np.where(own < with_, 1, 2))
            tile = np.minimum(own, with_) * len(lower) + np.maximum(own, with_)
            out = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(2), pa.array(side, pa.int32()), pa.array(tile, pa.int64())], ["cid", "size", "v", "side", "tile"])

    dealt = placed.mapInArrow(deal, "cid long, size long, v array<double>, side int, tile long")
    return dealt.groupBy("tile").applyInArrow(lambda t: _tile(t, dim, cosine, allowed), "cid long, links long, group long")


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.999, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """``vectors`` plus ``n_links``, ``component_id`` and ``kept``.

    Two vectors link if their cosine in double precision is ``cosine`` or more (a link at
    the threshold is found with probability ``recall``, nearer ones more surely; nothing
    below it links).  ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable, its own included; ``kept`` says that
    the row has that id.  Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths.  Repeated rows are
    copies; a row with a null id counts for the links of others but gives no id to its
    component.  An empty table gives an empty table; columns named like a result are replaced.
    """
    names = ("n_links", "component_id", "kept")
    carried = [c for c in vectors.columns if c.lower() not in names]
    ok, vec, k1, k2 = fresh(carried, "ok", "v", "k1", "k2")
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    marked = vectors.select(*carried).withColumn(ok, fine).withColumn(vec, F.when(F.col(ok), v))
    # Equal arrays have equal keys; two hashes keep unequal ones apart.
    marked = marked.withColumn(k1, F.xxhash64(vec)).withColumn(k2, F.xxhash64(F.lit(1), vec))
    classes = marked.where(F.col(ok)).groupBy(F.col(k1).alias("_k1"), F.col(k2).alias("_k2")).agg(F.first(vec).alias("v"), F.count(F.lit(1)).alias("size"), F.min(id_col).alias("least"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    found = None
    for dim in dims:
        one = _links_of_dimension(classes.where(F.size("v") == dim), dim, cosine, recall, slab_rows)
        found = one if found is None else found.union(one)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "cid long, links long, group long")
    found = materialize(found, "vector-links")
    groups = connected_components(found.select(F.col("cid").alias("a"), F.col("group").alias("b"))).withColumnRenamed("node", "cid")
    per_class = classes.select("_k1", "_k2", "cid", "size", "least").join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(groups, "cid", "left")
    per_class = materialize(per_class.withColumn("component", F.coalesce("component", "cid")), "vector-groups")
    smallest = per_class.groupBy("component").agg(F.min("least").alias("_least"))
    labels = per_class.join(smallest, "component").select(
        "_k1", "_k2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.col("_least").alias("_component")
    )
    out = marked.join(labels, (marked[k1] == labels["_k1"]) & (marked[k2] == labels["_k2"]) & marked[ok], "left")
    component = F.when(marked[ok], labels["_component"]).otherwise(marked[id_col])
    return out.select(*[marked[c] for c in carried], F.coalesce(labels["_links"], F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), marked[id_col].eqNullSafe(component).alias("kept"))
