"""Best-fit packing of tokenized documents by a configuration linear program.

Documents become token ids where they are read, and longer ones are cut into pieces.
Only the histogram of piece lengths (as many numbers as a sequence has tokens) goes to
the driver, where the program is solved and rounded.  Pieces then take their places by
their number among the pieces of equal length.  A length that a third of all pieces
have is numbered within each task, with the tasks' offsets added after, so no task or
window ever holds all pieces of one length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import config_lp
from pathloom.llm.blocks import fresh, lean, put_columns, slices, with_columns
from pathloom.llm.tokens import byte_bpe
from pathloom.plans.scratch import materialize


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, text_col: str = "text", numbers: tuple[str, str] = ("_task", "_nth")) -> DataFrame:
    """A row for each piece: the columns of ``docs`` but the text, ``piece``, ``start``, ``length``, ``ids``;
    and in the columns ``numbers`` its task and the piece's number there among those of its length.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit bytes; ``end_id``
    closes each document.  Only documents of more than ``capacity`` tokens are cut, into
    pieces of ``capacity`` with the shorter one first.  A null text counts as empty: one
    piece that holds the end alone.
    """
    kept = docs.drop(text_col)
    schema = with_columns(kept.schema, "piece int, start long, length long, ids binary, `{numbers[0]}` int, `{numbers[1]}` long".format(numbers=numbers))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer_path)
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            rows, piece, start, length, ids = [], [], [], [], []
            for i, raw in enumerate(encoder.encode_all(texts)):
                raw += end
                n = len(raw) // 4
                edges = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    ids.append(raw[4 * a : 4 * z])
            new = _numbers(task, seen, length, numbers)
            new |= {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary())}
            yield put_columns(batch.take(pa.array(rows, pa.int64())), schema, new)

    return docs.mapInArrow(lean(run), schema)


def _numbers(task: int, seen: dict[int, int], lengths: list[int], names: tuple[str, str]) -> dict[str, pa.Array]:
    nth = []
    for n in lengths:
        nth.append(seen[n])
        seen[n] += 1
    return {names[0]: pa.array([task] * len(nth), pa.int32()), names[1]: pa.array(nth, pa.int64())}


def place_pieces(pieces: DataFrame, capacity: int, numbers: tuple[str, str] | None = None) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``: the fewest sequences that the program finds.

    ``pieces`` has ``length`` from 1 to ``capacity``; its other columns are carried,
    whatever their names, and columns named like a result replaced.  In every sequence
    the pieces follow each other from offset 0 without gaps.  Repeated rows are separate
    pieces; none give none.  ``numbers`` names the columns of :func:`token_pieces` with
    the pieces' numbers, which saves a pass; they are not carried.
    """
    known = numbers or ()
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset") and c not in known]
    task_col, nth_col = numbers or fresh(kept, "task", "nth")
    before_col = fresh([*kept, task_col, nth_col], "before")[0]
    pieces = pieces.select(*kept, *known)
    numbered_schema = with_columns(pieces.schema, f"`{task_col}` int, `{nth_col}` long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            yield put_columns(batch, numbered_schema, _numbers(task, seen, batch.column(batch.schema.get_field_index("length")).to_pylist(), (task_col, nth_col)))

    numbered = materialize(pieces if numbers else pieces.mapInArrow(lean(number), numbered_schema), "pieces")
    by_task = materialize(numbered.groupBy(task_col, "length").count(), "piece-counts")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("count")).collect():  # at most `capacity` rows
        counts[length] = n
    slots = _slots(config_lp.plan(counts, capacity))
    before = Window.partitionBy("length").orderBy(task_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select(task_col, "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias(before_col))
    joined = numbered.join(offsets, [task_col, "length"]).withColumn(nth_col, F.col(nth_col) + F.col(before_col)).select(*kept, nth_col)
    schema = with_columns(pieces.select(*kept).schema, "sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            nth = batch.column(batch.schema.get_field_index(nth_col)).to_numpy()
            sequence, offset = np.empty(len(nth), dtype=np.int64), np.empty(len(nth), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, each, base, shift = slots[int(n)]
                k = np.searchsorted(first, nth[at], side="right") - 1
                inside = nth[at] - first[k]
                sequence[at] = base[k] + inside // each[k]
                offset[at] = shift[k] + inside % each[k] * n
            yield put_columns(batch, schema, {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    return joined.mapInArrow(lean(place), schema)


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first piece number, pieces a sequence, first sequence and offset of each configuration."""
    out: dict[int, list[list[int]]] = defaultdict(lambda: [[], [], [], []])
    used: dict[int, int] = defaultdict(int)
    base = 0
    for config, times in plan:
        shift = 0
        for length, each in config.items():
            for x, y in zip(out[length], (used[length], each, base, shift), strict=True):
                x.append(y)
            used[length] += each * times
            shift += length * each
        base += times
    return {length: tuple(np.array(x, dtype=np.int64) for x in rows) for length, rows in out.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their token ids and places in sequences of ``capacity`` tokens."""
    numbers = tuple(fresh(docs.columns, "task", "nth"))
    return place_pieces(token_pieces(docs, tokenizer_path, end_id, capacity, text_col, numbers), capacity, numbers)
