"""Blocks of documents, and which 64-bit keys occur in more than one of them.

Text deduplication has to learn which of very many small items (anchors, windows)
occur again anywhere in the corpus.  A row per item would shuffle several times the
text.  Instead documents are packed into blocks of about two megabytes (a row with a
compressed Arrow batch), written once to the shared folder.  A block sends each of its
distinct keys once, sorted and cut into buckets; a bucket sees which keys came from two
or more blocks and answers each block with those of its keys.  A key held by a third of
all documents therefore travels once per block, not once per document, and no task
holds more than a bucket, whose number grows with the keys.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.hashing import text_buffer
from pathloom.plans.scratch import materialize

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 24 << 20


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system at the end of each task.

    Idle workers stay with their executor; what their allocators keep would count on.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Return unused memory of the Arrow pool and of malloc."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def slices(batch: pa.RecordBatch, text_col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most`` text bytes, or one row."""
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _encode(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def decode(payload: bytes) -> pa.RecordBatch:
    """The documents of a block, all columns."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_next_batch()


def pack(docs: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block_id, payload)``, written to the shared folder; one text never spans two blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for part in slices(batch, text_col, block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_encode(part)], pa.binary())], ["block_id", "payload"])
                number += 1

    return materialize(docs.mapInArrow(lean(cut), "block_id long, payload binary"), "blocks")


def bucket_count(blocks: DataFrame, keys_per_block: int) -> int:
    """Buckets such that each gets about BUCKET_BYTES of keys, and no task waits for work."""
    n = blocks.count()
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-n * keys_per_block * 8 // BUCKET_BYTES))


def keys_of(found: list[bytes] | None) -> np.ndarray:
    """The sorted keys that the buckets sent back to one block."""
    parts = [np.frombuffer(x, dtype=np.uint64) for x in found or ()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def is_in(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Mask of those of ``keys`` that ``sorted_keys`` holds."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def repeated(keys: np.ndarray) -> np.ndarray:
    """The sorted keys that occur twice or more in one block."""
    s = np.sort(keys)
    return np.unique(s[1:][s[1:] == s[:-1]])


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted keys, cut by equal ranges of their value (of its upper half, so ``buckets`` is below 2**32)."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else [0]
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        yield int(of[a]), keys[a:z]


def send(blocks: DataFrame, keys: Callable[[pa.RecordBatch, list[bytes] | None], np.ndarray], buckets: int) -> DataFrame:
    """``(bucket, block_id, keys)``: the distinct keys of each block."""
    answered = "found" in blocks.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                back = batch.column(2)[i].as_py() if answered else None
                mine = np.unique(keys(decode(batch.column(1)[i].as_py()), back))
                cut = list(by_bucket(mine, buckets))
                block = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int32()), pa.array([block] * len(cut), pa.int64()), pa.array([k.tobytes() for _, k in cut], pa.binary())], ["bucket", "block_id", "keys"])

    return blocks.mapInArrow(lean(emit), "bucket int, block_id long, keys binary")


def _shared(table: pa.Table, most: int) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("keys")]
    of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    held = np.repeat(np.diff(edge), np.diff(edge))  # by how many blocks, for each place
    blocks = table.column("block_id").to_numpy()
    out: dict[str, list] = {"block_id": [], "keys": [], "hot": []}
    for hot, mask in ((False, (held > 1) & (held <= most)), (True, (held > 1) & (held > most))):
        k, o = keys[mask], of[mask]
        order = np.argsort(o, kind="stable")
        k, o = k[order], o[order]
        ids, starts = np.unique(o, return_index=True)
        out["block_id"] += blocks[ids].tolist()
        out["keys"] += [x.tobytes() for x in np.split(k, starts[1:])] if len(ids) else []
        out["hot"] += [hot] * len(ids)
    return pa.table({"block_id": pa.array(out["block_id"], pa.int64()), "keys": pa.array(out["keys"], pa.binary()), "hot": pa.array(out["hot"], pa.bool_())})


def shared(sent: DataFrame, most: int = 1 << 62) -> DataFrame:
    """``(block_id, found, hot)``: for each block, its keys that another block has too.

    Keys that more than ``most`` blocks have are in ``hot`` instead of ``found``.
    """
    answers = sent.groupBy("bucket").applyInArrow(lambda t: _shared(t, most), "block_id long, keys binary, hot boolean")
    pick = lambda c: F.collect_list(F.when(c, F.col("keys")))
    return answers.groupBy("block_id").agg(pick(~F.col("hot")).alias("found"), pick(F.col("hot")).alias("hot"))


def answer(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``(block_id, payload, ...)`` with the other columns of ``found``, null where nothing came back."""
    return blocks.join(found, "block_id", "left").select("block_id", "payload", *[c for c in found.columns if c != "block_id"])


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that differ from all ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def with_columns(schema: T.StructType, extra: str) -> T.StructType:
    """``schema`` plus the columns of ``extra``, which replace columns of the same name."""
    new = T.StructType.fromDDL(extra)
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(new))


def put_columns(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with the arrays of ``new``, in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(batch.schema.get_field_index(f.name)) for f in schema], [f.name for f in schema])
