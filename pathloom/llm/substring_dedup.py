"""Substring dedup by difference-cover anchors.

With a difference cover D modulo v, for any two positions i and j there is a shift
d < v such that (i + d) mod v and (j + d) mod v are both in D.  So if the window of W
words at i equals the window at j, both hold an anchor of W - v + 1 words at the same
distance d from their starts.  Only anchors at cover positions are hashed and
exchanged; an anchor that occurs elsewhere then extends by up to v - 1 words to either
side into the windows that hold it, and those windows are exchanged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm import blocks as B
from pathloom.llm.hashing import covered, runs, text_buffer, windows, word_hashes, words
from pathloom.plans.scratch import materialize


@cache
def difference_cover(v: int) -> tuple[int, ...]:
    """The smallest set of residues whose differences give every residue modulo ``v``."""
    for extra in range(v):
        for rest in combinations(range(1, v), extra):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return cover
    return tuple(range(v))


def _period(window: int) -> int:
    """Up to 21, and at most three fifths of the window, so that anchors stay selective."""
    return max(1, min(21, window * 3 // 5))


class _Texts:
    """The words of one block and their hashes."""

    def __init__(self, batch: pa.RecordBatch, text_col: str):
        self.raw, self.offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
        self.starts, self.ends, self.first = words(self.raw, self.offs)
        self.hashes = word_hashes(self.raw, self.starts, self.ends)

    def place(self) -> np.ndarray:
        """Each word's index in its own text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], np.diff(self.first))

    def whole(self, width: int) -> np.ndarray:
        """Which words start a run of ``width`` words inside one text."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))
        return left >= width

    def anchors(self, v: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors and their hashes."""
        at = np.flatnonzero(np.isin(self.place() % v, difference_cover(v)) & self.whole(width))
        return at, windows(self.hashes, width)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def candidates(self, window: int, found: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that hold an anchor seen elsewhere."""
        v = _period(window)
        at, keys = self.anchors(v, window - v + 1)
        hit = at[B.is_in(keys, B.keys_of(found)) | B.is_in(keys, B.repeated(keys))]
        near = np.zeros(len(self.starts) + 1, dtype=np.int32)
        np.add.at(near, np.maximum(hit - (v - 1), 0), 1)
        np.add.at(near, hit + 1, -1)
        start = np.flatnonzero((np.cumsum(near[:-1]) > 0) & self.whole(window))
        # The window hash has other symbols than the anchors': a false anchor is not a false window.
        return start, windows(self.hashes * np.uint64(0xA24BAED4963EE407), window)[start] if len(start) else np.zeros(0, dtype=np.uint64)


def repeated_words(docs: DataFrame, text_col: str = "text", window: int = 35, rewrite: bool = True) -> DataFrame:
    """Remove every word covered by a ``window``-word run that also starts anywhere else.

    Words are maximal runs of bytes other than space and 0x09-0x0D.  Windows are judged
    on the input.  Returns all columns of ``docs`` plus ``n_words``, ``n_removed`` and
    ``kept_sha256`` (of the kept words joined by one space); with ``rewrite`` the text
    becomes those words, otherwise it stays.  Input columns of these names are replaced.

    Null or empty texts, and texts with fewer words than the window, lose nothing; their
    kept text is their words joined (empty for none).  Repeated rows are separate texts,
    so both lose all their windows.  An empty table gives an empty table.  A text of any
    length is one text; memory follows the longest text of a block.
    """
    v = _period(window)
    width = window - v + 1
    blocks = B.pack(docs, text_col)
    buckets = B.bucket_count(blocks, B.BLOCK_BYTES // 6 * len(difference_cover(v)) // v)
    found = B.shared(B.send(blocks, lambda batch, _: _Texts(batch, text_col).anchors(v, width)[1], buckets)).select("block_id", "found")
    found = materialize(found, "anchors")
    again = B.shared(B.send(B.answer(blocks, found), lambda batch, back: _Texts(batch, text_col).candidates(window, back)[1], buckets)).select("block_id", "found")
    # Both answers meet the block once more: the first gives its candidates, the second which of them repeat.
    both = B.answer(blocks, found.withColumnRenamed("found", "anchors").join(again, "block_id", "left").selectExpr("block_id", "array(anchors, found) AS found"))
    schema = B.with_columns(docs.schema, "n_words long, n_removed long, kept_sha256 string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, seen = batch.column(2)[i].as_py() or (None, None)
                yield _rewrite(decode_batch := B.decode(batch.column(1)[i].as_py()), _Texts(decode_batch, text_col), anchors, seen)

    def _rewrite(batch: pa.RecordBatch, t: _Texts, anchors, seen) -> pa.RecordBatch:
        start, keys = t.candidates(window, anchors)
        dup = start[B.is_in(keys, B.keys_of(seen)) | B.is_in(keys, B.repeated(keys))]
        gone = covered(len(t.starts), dup, window) if len(dup) else np.zeros(len(t.starts), dtype=bool)
        removed = np.concatenate(([0], np.cumsum(gone)))
        blob, kept = t.raw.tobytes(), []
        for d in range(batch.num_rows):
            a, b = int(t.first[d]), int(t.first[d + 1])
            body = blob[t.offs[d] : t.offs[d + 1]]
            if removed[b] == removed[a]:
                kept.append(b" ".join(body.split()))
            else:
                kept.append(b" ".join(x for s, e in zip(*runs(~gone[a:b]), strict=True) for x in blob[t.starts[a + s] : t.ends[a + e - 1]].split()))
        new = {
            "n_words": pa.array(np.diff(t.first), pa.int64()),
            "n_removed": pa.array(removed[t.first[1:]] - removed[t.first[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        if rewrite:
            new[text_col] = pa.array(kept, pa.binary()).cast(pa.string())
        return B.put_columns(batch, schema, new)

    return both.mapInArrow(B.lean(finish), schema)
