"""Suffix-array dedup over a distributed corpus.

A sorted list of all suffixes can't be cut by machine without sending each suffix with
its whole context.  So suffixes are grouped first: each window of W bytes names the
smallest hashed k-gram in it, equal windows name the same one at the same offset, and
consecutive windows mostly share it.  One anchor suffix thus stands for all windows
that name its k-gram, and equal windows can only be met in the group of one k-gram.

Anchors whose k-gram occurs once are done.  The others send the bytes their windows
span to the group, identical spans of a block once.  There the suffixes from the anchor
and the reversed prefixes before it are ordered by deep-shallow sorting; joining
neighbours of the suffix order from the longest common prefix downwards, and looking
for the nearest prefix in each joined interval, finds every window that occurs twice
without comparing all pairs.

A passage that a large part of all documents share would make one group of them.  Anchors
whose k-gram stands in more than a bounded number of blocks therefore don't form a
group: there the windows themselves are exchanged by hash, each once per block, which
spreads a hot passage over all buckets and finds the same repeats.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import blocks as B
from pathloom.llm.hashing import BYTE_VALUES, mix, runs, text_buffer, windows
from pathloom.llm.suffix_sort import common_prefix, deep_shallow_sort
from pathloom.plans.scratch import materialize

PLACE_BITS = 22
SEGMENT = 1 << 21
#: Blocks that may share a k-gram before its windows are exchanged one by one.
GROUP_BLOCKS = 64


def _gram(window: int) -> int:
    return max(1, min(50, window // 8))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of fixed pieces."""
    n = len(values)
    pad = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:n] = values
    pieces = pad.reshape(-1, width)
    ahead = np.minimum.accumulate(pieces, axis=1).reshape(-1)
    back = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: k-gram hash, anchor, first and last window start."""
    k = _gram(window)
    out: list[list[np.ndarray]] = [[], [], [], []]
    ends = offs[1:]
    for at in range(0, max(0, len(raw) - window + 1), SEGMENT):
        piece = raw[at : at + SEGMENT + window - 1]
        h = windows(BYTE_VALUES[piece], k)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = _sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), window - k + 1)
        place = (least & mask).astype(np.int64)
        start = np.arange(at, at + len(place))
        text = np.searchsorted(ends, start, side="right")
        whole = np.flatnonzero(start + window <= ends[text])
        if not len(whole):
            continue
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (place[whole[1:]] != place[whole[:-1]]) | (whole[1:] != whole[:-1] + 1) | (text[whole[1:]] != text[whole[:-1]])
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(whole)])) - 1
        # Anchors have the smallest hashes; mixed again they fill all buckets alike.
        for x, y in zip(out, (mix(h[place[whole[first]]]), place[whole[first]] + at, whole[first] + at, whole[last] + at), strict=True):
            x.append(y)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in zip(out, kinds, strict=True))


def _anchors_of(batch: pa.RecordBatch, text_col: str, window: int):
    raw, offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
    return raw, anchors(raw, offs, window)


def _window_keys(raw: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows at ascending ``starts``, other ones than those of k-grams."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for at in range(0, max(0, len(raw) - window + 1), SEGMENT):
        a, z = np.searchsorted(starts, (at, at + SEGMENT))
        if z > a:
            piece = BYTE_VALUES[raw[at : at + SEGMENT + window - 1]] * np.uint64(0xA24BAED4963EE407)
            out[a:z] = windows(piece, window)[starts[a:z] - at]
    return out


def _starts(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All window starts of ascending runs ``first..last``."""
    n = last - first + 1
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)


def _spans(batch: pa.RecordBatch, text_col: str, window: int, found: list[bytes] | None, hot: list[bytes] | None) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The distinct spans of a block whose k-gram occurs again, ordered by k-gram; the hot
    windows' distinct keys; and the runs of windows that these are of."""
    raw, (keys, anchor, first, last) = _anchors_of(batch, text_col, window)
    is_hot = B.is_in(keys, B.keys_of(hot))
    again = np.flatnonzero((B.is_in(keys, B.keys_of(found)) | B.is_in(keys, B.repeated(keys))) & ~is_hot)
    blob = raw.tobytes()
    spans: dict[tuple[int, int, bytes], list[int]] = defaultdict(list)
    for key, a, f, z in zip(keys[again].tolist(), anchor[again].tolist(), first[again].tolist(), last[again].tolist(), strict=True):
        spans[key, a - f, blob[f : z + window]].append(a)
    order = sorted(spans, key=lambda s: s[0])
    rows = pa.RecordBatch.from_arrays(
        [pa.array([s[0] for s in order], pa.uint64()), pa.array([s[1] for s in order], pa.int32()), pa.array([s[2] for s in order], pa.large_binary()), pa.array([spans[s] for s in order], pa.list_(pa.int64()))],
        ["key", "before", "span", "anchors"],
    )
    runs_ = np.stack((first[is_hot], last[is_hot]), axis=1)
    return rows, np.unique(_window_keys(raw, _starts(first[is_hot], last[is_hot]), window)), runs_


def _hot_repeats(raw: np.ndarray, runs_: np.ndarray, found: np.ndarray, window: int) -> np.ndarray:
    """Starts of the hot windows that occur again, here or in another block."""
    starts = _starts(runs_[:, 0], runs_[:, 1])
    keys = _window_keys(raw, starts, window)
    return starts[B.is_in(keys, found) | B.is_in(keys, B.repeated(keys))]


def repeated_offsets(spans: list[tuple[int, bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each different span ``(bytes before its anchor, bytes)``: ranges of distances
    from a window's start to the anchor at which some other span holds an equal window.
    """
    suffix = [s[b:] for b, s in spans]
    prefix = [s[:b][::-1] for b, s in spans]
    order = deep_shallow_sort(suffix)
    by_prefix = deep_shallow_sort(prefix)
    rank = {x: i for i, x in enumerate(by_prefix)}
    least = window - max(b for b, _ in spans)
    shared = sorted(((p, i) for i in range(len(order) - 1) if (p := common_prefix(suffix[order[i]], suffix[order[i + 1]])) >= least), reverse=True)
    cluster: list[list[int]] = [[rank[x]] for x in order]
    home = list(range(len(order)))

    def root(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    for p, i in shared:
        a, b = root(i), root(i + 1)
        if len(cluster[a]) < len(cluster[b]):
            a, b = b, a
        large = cluster[a]
        for r in cluster[b]:
            at = bisect_left(large, r)
            x = by_prefix[r]
            for y in large[max(0, at - 1) : at + 1]:
                y = by_prefix[y]
                left = common_prefix(prefix[x], prefix[y])
                if left + p >= window:
                    out[x].append((window - p, left))
                    out[y].append((window - p, left))
            large.insert(at, r)
        cluster[b], home[b] = [], a
    return out


def _merge(table: pa.Table, window: int) -> pa.Table:
    """For each block of a bucket: anchors and ranges of distances of repeated windows."""
    parts = [B.decode(x.as_py()) for x in table.column("payload")]
    owner = np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])
    local = np.concatenate([np.arange(p.num_rows) for p in parts])
    keys = np.concatenate([p.column(0).to_numpy() for p in parts])
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True])))
    answers: dict[int, list[int]] = defaultdict(list)
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        members: dict[tuple[int, bytes], list[tuple[int, list[int]]]] = defaultdict(list)
        for e in order[a:z].tolist():
            p, i = int(owner[e]), int(local[e])
            row = parts[p]
            members[row.column(1)[i].as_py(), row.column(2)[i].as_py()].append((p, row.column(3)[i].as_py()))
        different = list(members)
        ranges = repeated_offsets(different, window) if len(different) > 1 else [[]]
        for (before, span), found in zip(different, ranges, strict=True):
            who, low = members[before, span], before + window - len(span)
            if sum(len(at) for _, at in who) > 1:
                found = [(low, before)]
            found = {(max(lo, low), min(hi, before)) for lo, hi in found if max(lo, low) <= min(hi, before)}
            for p, at in who:
                answers[p] += [v for x in at for lo, hi in found for v in (x, lo, hi)]
    blocks = table.column("block_id").to_pylist()
    return pa.table({"block_id": pa.array([blocks[p] for p in answers], pa.int64()), "ranges": pa.array([np.array(v, dtype=np.int64).tobytes() for v in answers.values()], pa.binary())})


def repeated_bytes(docs: DataFrame, text_col: str = "text", window: int = 400, rewrite: bool = True) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts anywhere else.

    Texts are UTF-8 bytes, matches lie inside one text, overlapping ones count, and all
    are judged on the input.  Returns all columns of ``docs`` plus ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256`` (of the
    remaining bytes); input columns of these names are replaced.  With ``rewrite`` the
    text becomes what remains, where a character that loses only some bytes stays whole.

    Null texts count as empty and stay null; texts shorter than the window lose nothing.
    Repeated rows are separate texts.  An empty table gives an empty table.
    """
    blocks = B.pack(docs, text_col)
    per_block = 2 * B.BLOCK_BYTES // (window - _gram(window) + 2)
    sent = B.send(blocks, lambda batch, _: _anchors_of(batch, text_col, window)[1][0], B.bucket_count(blocks, per_block))
    found = materialize(B.shared(sent, GROUP_BLOCKS), "suffix-anchors")
    buckets = B.bucket_count(blocks, per_block * window // 8)
    kinds = "kind string, bucket int, block_id long, payload binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, keys, runs_ = _spans(B.decode(batch.column(1)[i].as_py()), text_col, window, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                at, rows = 0, []
                for b, of_bucket in B.by_bucket(mine.column(0).to_numpy(), buckets):
                    rows.append(("span", b, B._encode(mine.slice(at, len(of_bucket)))))
                    at += len(of_bucket)
                rows += [("window", b, k.tobytes()) for b, k in B.by_bucket(keys, buckets)]
                if len(runs_):
                    rows.append(("run", -1, runs_.tobytes()))
                block = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "bucket", "block_id", "payload"])

    made = materialize(B.answer(blocks, found).mapInArrow(B.lean(emit), kinds), "suffix-spans", partition_by="kind")
    merged = made.where("kind = 'span'").select("bucket", "block_id", "payload").groupBy("bucket").applyInArrow(lambda t: _merge(t, window), "block_id long, ranges binary")
    ranges = merged.groupBy("block_id").agg(F.collect_list("ranges").alias("ranges"))
    hot = B.shared(made.where("kind = 'window'").select("bucket", "block_id", F.col("payload").alias("keys"))).select("block_id", F.col("found").alias("again"))
    hot_runs = made.where("kind = 'run'").select("block_id", F.col("payload").alias("runs")).join(hot, "block_id", "left")
    answers = ranges.join(hot_runs, "block_id", "full").select("block_id", "ranges", "runs", "again")
    schema = B.with_columns(docs.schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _rewrite(B.decode(batch.column(1)[i].as_py()), *(batch.column(c)[i].as_py() for c in (2, 3, 4)))

    def _rewrite(batch: pa.RecordBatch, found: list[bytes] | None, hot: bytes | None, again: list[bytes] | None) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(text_col))
        raw, offs = text_buffer(column)
        edge = np.zeros(len(raw) + 1, dtype=np.int32)
        for part in found or ():
            anchor, low, high = np.frombuffer(part, dtype=np.int64).reshape(-1, 3).T
            np.add.at(edge, anchor - high, 1)
            np.add.at(edge, anchor - low + window, -1)
        if hot:
            starts_ = _hot_repeats(raw, np.frombuffer(hot, dtype=np.int64).reshape(-1, 2), B.keys_of(again), window)
            np.add.at(edge, starts_, 1)
            np.add.at(edge, starts_ + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[offs[1:]] - total[offs[:-1]]
        blob = raw.tobytes()
        starts = np.append((raw & 0xC0) != 0x80, True)
        hashes, texts, n_spans = [], [], []
        for d in range(batch.num_rows):
            a, z = int(offs[d]), int(offs[d + 1])
            s, e = runs(gone[a:z]) if removed[d] else ((), ())
            n_spans.append(len(s))
            cuts = [(a + int(x), a + int(y)) for x, y in zip(s, e, strict=True)]
            hashes.append(hashlib.sha256(_without(blob, a, z, cuts)).hexdigest())
            if rewrite:
                texts.append(_without(blob, a, z, [_whole(x, y, starts) for x, y in cuts]) if column[d].is_valid else None)
        new = {"n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())}
        if rewrite:
            new[text_col] = pa.array(texts, pa.binary()).cast(pa.string())
        return B.put_columns(batch, schema, new)

    return B.answer(blocks, answers).mapInArrow(B.lean(finish), schema)


def _without(blob: bytes, a: int, z: int, cuts: list[tuple[int, int]]) -> bytes:
    out, at = [], a
    for x, y in cuts:
        out.append(blob[at:x])
        at = y
    return b"".join([*out, blob[at:z]])


def _whole(x: int, y: int, starts: np.ndarray) -> tuple[int, int]:
    """The span, shrunk to whole characters."""
    while x < y and not starts[x]:
        x += 1
    while y > x and not starts[y]:
        y -= 1
    return x, y
