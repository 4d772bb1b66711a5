"""SimHash near-dedup by multi-index hashing.

Fingerprints are cut into segments with a radius each, such that two fingerprints
within the allowed distance must agree on some segment up to its radius (the radii plus
one sum to more than the distance).  Each fingerprint enumerates the small Hamming ball
around its value in every segment, looks these values up in that segment's table, and
the whole distance is verified in the join itself.

Copies share one fingerprint and are one entry.  A dense group of near copies could
still link in all pairs, so entries are first hung on hubs of their buckets, and the
lookup then reports only links between groups that are not joined yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.blocks import fresh, lean, put_columns, with_columns
from pathloom.llm.hashing import text_buffer
from pathloom.plans.components import connected_components
from pathloom.plans.scratch import materialize

SEED = 42
#: Shingles hashed at once, so that one very long text stays cheap.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the ``shingle``-word shingles of a text, A-Z in lower case.

    Words are separated by 0x20 and 0x09-0x0D; fewer words than a shingle count as one
    shingle, none as fingerprint zero.  A bit is set if more than half the hashes have it.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    n = max(1, len(words) - shingle + 1)
    last = starts[min(shingle, len(words)) :][:n] - 1
    ones = np.zeros(64, dtype=np.int64)
    h64 = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        h = np.array([h64(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, shingle: int, out: str = "_fp", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the fingerprint as a signed long in ``out``."""
    keep = docs.columns if keep is None else keep
    schema = with_columns(docs.select(*keep).schema, f"`{out}` long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            blob = raw.tobytes()
            fps = np.array([fingerprint(blob[a:b], shingle) for a, b in zip(offs[:-1], offs[1:], strict=True)], dtype=np.uint64).view(np.int64)
            yield put_columns(batch, schema, {out: pa.array(fps, pa.int64())})

    return docs.mapInArrow(lean(run), schema)


def segments(n: int, distance: int) -> list[tuple[int, int, int]]:
    """``(shift, width, radius)`` of each segment for ``n`` fingerprints.

    About as many bits a segment as the table's size has, so that a lookup meets few
    strangers: four segments up to 2**20 entries, three up to 2**28, then two.
    """
    m = 4 if n <= 1 << 20 else 3 if n <= 1 << 28 else 2
    radii = [(distance + 1) // m + (i < (distance + 1) % m) - 1 for i in range(m)]
    edges = [64 * i // m for i in range(m + 1)]
    return [(lo, hi - lo, r) for lo, hi, r in zip(edges[:-1], edges[1:], radii, strict=True) if r >= 0]


def _part(fp: str, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _lookup(entries: DataFrame, cuts: list[tuple[int, int, int]], distance: int) -> DataFrame:
    """Pairs of groups ``(a, b)`` that a link within ``distance`` joins."""
    table = entries.select("fp", "grp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _part("fp", s, w).alias("v")) for k, (s, w, _) in enumerate(cuts)])).alias("e"))
    probes = None
    for k, (s, w, r) in enumerate(cuts):
        masks = F.array(*[F.lit(x).cast("long") for x in _ball(w, r)])
        one = entries.select(F.col("fp").alias("fp2"), F.col("grp").alias("grp2"), F.lit(k).alias("k"), F.explode(masks).alias("mask"), _part("fp", s, w).alias("v0"))
        one = one.select("fp2", "grp2", "k", F.col("v0").bitwiseXOR(F.col("mask")).alias("v"))
        probes = one if probes is None else probes.union(one)
    table = table.select("fp", "grp", F.col("e.k").alias("k"), F.col("e.v").alias("v"))
    near = (F.col("grp") != F.col("grp2")) & (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    hit = probes.join(table, (probes.k == table.k) & (probes.v == table.v) & near)
    return hit.select(F.greatest("grp", "grp2").alias("a"), F.least("grp", "grp2").alias("b")).distinct()


def _hubs(entries: DataFrame, cuts: list[tuple[int, int, int]], distance: int) -> DataFrame:
    """Links of fingerprints to a few hubs of the segment buckets they are in."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _part("fp", s, w).alias("v")) for k, (s, w, _) in enumerate(cuts)])).alias("e")
    rows = entries.select("fp", parts).select("fp", "e.k", "e.v")
    hub = rows.groupBy("k", "v").agg(F.min("fp").alias("h1"), F.max("fp").alias("h2"), F.min_by("fp", F.xxhash64("fp")).alias("h3"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = rows.join(hub, ["k", "v"]).select("fp", F.explode(F.array("h1", "h2", "h3")).alias("hub"))
    return near.where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= distance)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def group_fingerprints(fps: DataFrame, distance: int) -> DataFrame:
    """``(fp, grp)`` for distinct fingerprints: ``grp`` is equal where links connect them."""
    n = fps.count()
    cuts = segments(n, distance)
    first = connected_components(_hubs(fps, cuts, distance))
    entries = materialize(fps.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("grp")), "simhash-groups")
    second = connected_components(_lookup(entries, cuts, distance))
    return entries.join(second.withColumnRenamed("node", "grp"), "grp", "left").select("fp", F.coalesce("component", "grp").alias("grp"))


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` plus ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents link if their fingerprints differ in ``distance`` bits or fewer; the
    component is the smallest id reachable by links, a document's own included.  Null and
    empty texts have fingerprint zero and link like any other.  Rows with a null id get
    the smallest id of their component (null if it has none).  Repeated rows are copies.
    An empty table gives an empty table; input columns named like a result are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("fingerprint", "component_id")]
    fp = fresh(kept, "fp")[0]
    marked = materialize(with_fingerprint(docs.select(*kept), text_col, shingle, fp), "simhash-docs")
    labels = component_labels(marked.select(F.col(id_col), F.col(fp).alias("_fp")), id_col, distance)
    out = marked.join(labels.select("_lfp", F.col("component_id").alias("_lid")), marked[fp] == labels["_lfp"])
    return out.select(*[marked[c] for c in kept], F.lower(F.lpad(F.hex(marked[fp]), 16, "0")).alias("fingerprint"), F.col("_lid").alias("component_id"))


def component_labels(marked: DataFrame, id_col: str, distance: int) -> DataFrame:
    """``(_lfp, grp, component_id)`` from a table with ids and fingerprints in ``_fp``."""
    least = materialize(marked.groupBy("_fp").agg(F.min(id_col).alias("least")).withColumnRenamed("_fp", "fp"), "simhash-fps")
    groups = materialize(group_fingerprints(least.select("fp"), distance).join(least, "fp"), "simhash-labels")
    smallest = groups.groupBy("grp").agg(F.min("least").alias("component_id"))
    return materialize(groups.join(smallest, "grp").select(F.col("fp").alias("_lfp"), "grp", "component_id"), "simhash-components")


def simhash_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id.

    A null id comes after all others; of repeated rows one stays, whichever.
    """
    fp, row = fresh(docs.columns, "fp", "row")
    marked = materialize(with_fingerprint(docs, text_col, shingle, fp).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    narrow = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("_fp"), F.col(row).alias("row"))
    labels = component_labels(narrow, "id", distance)
    stay = narrow.join(labels, F.col("_fp") == F.col("_lfp")).groupBy("grp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("m")).select(F.col("m.row").alias(row))
    return marked.join(stay, row, "left_semi").select(*docs.columns)
