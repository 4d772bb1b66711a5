"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions, each with a context tree of its own over the
bytes before it.  A node of such a tree (a context of d bytes and the bits of the byte so
far) counts zeros and ones in the training texts and estimates the next bit as
Krichevsky and Trofimov do, ``(n + 1/2) / (zeros + ones + 1)``.  With ``Pe`` the probability
that this estimate gives to all the node's training bits, the weighted probability is
``Pw = Pe`` at full depth and ``Pw = (Pe + product of the children's Pw) / 2`` above, and
the next bit's probability mixes the estimates of all depths on its path: a node counts
with ``Pe / (Pe + product)``, what lies deeper with the rest.  Contexts without training bits
have no evidence; there the mix ends one depth above.

``Pe`` depends on the counts only, so training is aggregation.  Everything that a tree of
``depth`` bytes needs is how often each string of ``depth + 1`` bytes (a context and the byte
that follows) occurs.  These strings are 64-bit keys, most recent context byte first:

1. texts are packed into blocks; a block sends each different key once, with its count, to
   the key's bucket (by hash, so that no context is hot); buckets add up and remember which
   of their keys each block has;
2. the different keys of one pair of most recent bytes are a subtree, weighted from its
   leaves up to depth 2 in one task; the nodes of depth 1 and 0 (at most 256 x 255 and 255 of
   them, whatever the corpus) are sums over pairs;
3. keys get their log-probability and buckets answer the blocks, which score their texts.

Words of the unigram base go the same way with a hash of the word as their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import blocks as B
from pathloom.llm.hashing import mix, text_buffer, word_hashes, words
from pathloom.plans.scratch import materialize

#: Bytes of text in a block; the longest text may exceed it.
BLOCK_BYTES = 16 << 20
#: Bytes of text sorted at once.
CHUNK_BYTES = 1 << 20
#: Keys of a subtree in one row.
PIECE = 1 << 18
#: Stands before the first and after the last byte of a text; UTF-8 never uses it.
EDGE = 0xFF
#: The key of a text's end among the words.
END = np.uint64(0)
GRAM, WORD = 0, 1
LN2, LN10 = np.log(2.0), np.log(10.0)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, n_bytes long, base_score double, score double, bits_per_byte double"


# --- estimates -----------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series eight above."""
    x = np.asarray(x, dtype=np.float64)
    low = np.ones_like(x)
    for k in range(8):
        low *= np.where(x < 16, x + k, 1.0)
    y = np.where(x < 16, x + 8, x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The natural logarithm of the estimator's probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """``(log Pw, share)`` of nodes whose children's ``log Pw`` add up to ``below`` (None: no children).

    ``share`` is the weight of the node's own estimate against what lies deeper.
    """
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones_like(own)
    return np.logaddexp(own, below) - LN2, 1 / (1 + np.exp(np.minimum(below - own, 700)))


# --- one subtree ---------------------------------------------------------------------------


def _sums(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different codes and the sums of the values of each; ``codes`` are sorted."""
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, dtype=int)
    return codes[edge], *(np.add.reduceat(v, edge) for v in values)


def _look(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Nodes at depth ``top`` and the mix from there down, of sorted different keys.

    Gives for each of the eight bits ``(code, zeros, ones, log Pw)``, a code being the context
    and the bits so far after a leading one, and for each key and bit the probability of
    its bit (NaN where no training bit was seen at depth ``top``).
    """
    u = np.uint64
    sym_of = keys & u(255)
    trained = counts > 0
    code, n = keys[trained], counts[trained].astype(np.int64)
    mixed = np.full((len(keys), 8), np.nan)
    levels, below = [], None
    for d in range(depth, top - 1, -1):
        if d < depth:  # contexts lose their farthest byte
            shorter = (code >> u(16) << u(8)) | (code & u(255))
            order = np.argsort(shorter, kind="stable")
            code, n = _sums(shorter[order], n[order])
        context, sym = code >> u(8), code & u(255)
        level, up = [], []
        for i in range(8):
            node = context << u(8) | u(1 << i) | sym >> u(8 - i)
            bit = (sym >> u(7 - i) & u(1)).astype(np.int64)
            nodes, total, ones = _sums(node, n, n * bit)
            under = None
            if below is not None:
                under = np.bincount(_look(nodes, below[i][0])[0], weights=below[i][1], minlength=len(nodes))
            lw, share = weigh(total - ones, ones, under)
            level.append((nodes, total - ones, ones, lw, share))
            up.append((nodes >> u(16) << u(8) | nodes & u(255), lw))
        levels.append(level)
        below = up
    for i in range(8):
        bit = sym_of >> u(7 - i) & u(1)
        for d, level in zip(range(depth, top - 1, -1), levels, strict=True):
            nodes, zeros, ones, _, share = level[i]
            node = (keys >> u(8 * (depth - d + 1))) << u(8) | u(1 << i) | sym_of >> u(8 - i)
            at, there = _look(nodes, node)
            if len(nodes):
                p = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
                deeper = mixed[:, i]
                mixed[:, i] = np.where(there, np.where(np.isnan(deeper), p, share[at] * p + (1 - share[at]) * deeper), np.nan)
    return [x[:4] for x in levels[-1]], mixed


class Roots:
    """The nodes of depth 1 and 0: at most 256 contexts with 255 nodes each."""

    def __init__(self, nodes: list[tuple[int, int, int, int, float]]):
        """From sums over all pairs ``(last byte, node, zeros, ones, sum of log Pw)``."""
        self.zeros, self.ones, below = (np.zeros((257, 256)) for _ in range(3))  # row 256: depth 0
        for byte, node, zeros, ones, lw in nodes:
            self.zeros[byte, node], self.ones[byte, node], below[byte, node] = zeros, ones, lw
        self.zeros[256], self.ones[256] = self.zeros[:256].sum(0), self.ones[:256].sum(0)
        self.share = np.ones((257, 256))
        lw, self.share[:256] = weigh(self.zeros[:256], self.ones[:256], below[:256])
        seen = self.zeros[:256] + self.ones[:256] > 0
        self.share[256] = weigh(self.zeros[256], self.ones[256], np.where(seen, lw, 0).sum(0))[1]

    def log10(self, keys: np.ndarray, mixed: np.ndarray, depth: int) -> np.ndarray:
        """The logarithm of each key's last byte after its context, from the mixes at depth 2."""
        u = np.uint64
        sym, last = (keys & u(255)).astype(np.int64), (keys >> u(8 * depth)).astype(np.int64)
        out = np.zeros(len(keys))
        for i in range(8):
            node, bit = (1 << i) | sym >> (8 - i), sym >> (7 - i) & 1
            deeper = mixed[:, i]
            for row in (last, np.full_like(last, 256)):
                zeros, ones, share = self.zeros[row, node], self.ones[row, node], self.share[row, node]
                p = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
                here = np.where(np.isnan(deeper), p, share * p + (1 - share) * deeper)
                deeper = np.where(zeros + ones > 0, here, np.nan)
            out += np.log(np.where(np.isnan(deeper), 0.5, deeper))
        return out / LN10


# --- keys of texts -------------------------------------------------------------------------


def _gram_keys(raw: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """A key for each byte of each text and one for its end."""
    pad = np.full(len(raw) + len(sizes) * (depth + 1), EDGE, dtype=np.uint8)
    shift = np.repeat(np.arange(1, len(sizes) + 1) * depth + np.arange(len(sizes)), sizes)
    pad[np.arange(len(raw)) + shift] = raw
    key = np.zeros(len(pad) - depth, dtype=np.uint64)
    for j in range(1, depth + 1):
        key = key << np.uint64(8) | pad[depth - j : len(pad) - j]
    key = key << np.uint64(8) | pad[depth:]
    # Positions inside the padding before a text predict nothing.
    starts = np.cumsum(sizes + depth + 1) - (sizes + depth + 1)
    real = np.ones(len(pad), dtype=bool)
    for j in range(depth):
        real[starts + j] = False
    return key[real[depth:]]


class Chunk:
    """Some texts of a block: their keys of one kind, sorted, each with the text it is from."""

    def __init__(self, keys: np.ndarray, of: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, self.of = keys[order], of[order].astype(np.uint32)
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
        self.keys, self.nth = keys[first], (np.cumsum(first) - 1).astype(np.uint32)

    @classmethod
    def packed(cls, keys: np.ndarray, of: np.ndarray, bits: int) -> Chunk:
        """The same where key and text number fit one integer: one sort of plain numbers."""
        self = cls.__new__(cls)
        both = keys << np.uint64(bits) | of.astype(np.uint64)
        both.sort()
        self.of = (both & np.uint64((1 << bits) - 1)).astype(np.uint32)
        both >>= np.uint64(bits)
        first = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.zeros(0, dtype=bool)
        self.keys, self.nth = both[first], (np.cumsum(first) - 1).astype(np.uint32)
        return self

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts of weight one."""
        return np.bincount(self.nth, weights=weight[self.of], minlength=len(self.keys)).astype(np.int64)

    def total(self, values: np.ndarray, texts: int) -> np.ndarray:
        """For each text the sum of its keys' values, repeats included."""
        return np.bincount(self.of, weights=values[self.nth], minlength=texts)


def chunks(batch: pa.RecordBatch, text_col: str, depth: int) -> Iterator[tuple[int, int, dict[int, Chunk], np.ndarray]]:
    """``(first text, texts, chunks by kind, bytes of each text)``, a few megabytes at a time."""
    raw, offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
    bits = 64 - 8 * (depth + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, side="right")) - 1, at + (1 << bits)))
        part, ends = _LOWER[raw[offs[at] : offs[to]]], offs[at : to + 1] - offs[at]
        sizes = np.diff(ends)
        texts = np.arange(to - at)
        grams = Chunk.packed(_gram_keys(part, sizes, depth), np.repeat(texts, sizes + 1), bits)
        starts, stops, first = words(part, ends)
        named = np.concatenate((word_hashes(part, starts, stops), np.full(to - at, END)))
        of = np.concatenate((np.repeat(texts, np.diff(first)), texts))
        yield at, to - at, {GRAM: grams, WORD: Chunk(named, of)}, sizes
        at = to


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings sorted keys together by bucket, and the bucket of each after it."""
    of = ((mix(keys.copy()) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(of, kind="stable")
    return order, of[order].astype(np.int64)


def _groups(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(value, from, to)`` of the runs of equal values."""
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, dtype=int)
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(of[a]), a, z


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def _numbers(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=kind)


# --- Spark ---------------------------------------------------------------------------------

_SENT = "kind int, bucket int, block_id long, keys binary, counts binary"
#: Without a block: a bucket's keys and counts.  With one: which of them the block has.
_ADDED = "kind int, bucket int, block_id long, keys binary, counts binary, n_seen long, n_all long"
_PAIRED = "pair int, keys binary, counts binary"
_WEIGHED = "pair int, node int, zeros long, ones long, lw double, keys binary, mixed binary"
_VALUES = "kind int, bucket int, keys binary, held binary"
_ANSWER = "block_id long, kind int, keys binary, held binary"


def _send(packed: DataFrame, text_col: str, held: str, depth: int, buckets: int) -> DataFrame:
    """The different keys of each block, each bucket's in a row, with their training counts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, block = B.decode(batch.column(1)[i].as_py()), batch.column(0)[i].as_py()
                train = ~np.asarray(docs.column(docs.schema.get_field_index(held)).to_numpy(zero_copy_only=False), dtype=bool)
                found: dict[int, list] = {GRAM: [], WORD: []}
                for at, texts, by_kind, _ in chunks(docs, text_col, depth):
                    weight = train[at : at + texts].astype(np.float64)
                    for kind, c in by_kind.items():
                        found[kind].append((c.keys, c.counts(weight)))
                for kind, parts in found.items():
                    keys = _merged([k for k, _ in parts])
                    n = np.zeros(len(keys), dtype=np.int64)
                    for k, more in parts:
                        n[np.searchsorted(keys, k)] += more
                    order, of = _dealt(keys, buckets)
                    keys, n = keys[order], n[order].astype(np.uint32)
                    yield _rows(_SENT, [(kind, b, block, keys[a:z].tobytes(), n[a:z].tobytes()) for b, a, z in _groups(of)])

    return packed.mapInArrow(B.lean(emit), _SENT)


def _members(size: int, at: np.ndarray) -> bytes:
    """The places ``at`` of a table of ``size``, as a list or as bits, whichever is shorter."""
    if len(at) * 32 < size:
        return b"\x00" + at.astype(np.uint32).tobytes()
    mask = np.zeros(size, dtype=bool)
    mask[at] = True
    return b"\x01" + np.packbits(mask).tobytes()


def _places(size: int, members: bytes) -> np.ndarray:
    """Inverse of :func:`_members`."""
    if members[0] == 0:
        return np.frombuffer(members, dtype=np.uint32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(members, dtype=np.uint8, offset=1), count=size))


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    mine = [_numbers(x, np.uint64) for x in table.column("keys")]
    keys, n = np.concatenate(mine), np.concatenate([_numbers(x, np.uint32) for x in table.column("counts")])
    order = np.argsort(keys, kind="stable")
    keys, n = _sums(keys[order], n[order].astype(np.int64))
    kind, bucket = key[0].as_py(), key[1].as_py()
    rows = [(kind, bucket, None, keys.tobytes(), n.tobytes(), int((n > 0).sum()), int(n.sum()))]
    rows += [(kind, bucket, block, _members(len(keys), np.searchsorted(keys, k)), None, None, None) for block, k in zip(table.column("block_id").to_pylist(), mine, strict=True)]
    return pa.Table.from_batches([_rows(_ADDED, rows)])


def _pairs(depth: int):
    """Totals cut by the two most recent bytes of the context."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                keys, n = _numbers(k, np.uint64), _numbers(c, np.int64)
                yield _rows(_PAIRED, [(p, keys[a:z].tobytes(), n[a:z].tobytes()) for p, a, z in _groups((keys >> np.uint64(8 * (depth - 1))).astype(np.int64))])

    return B.lean(cut)


def _weigh_pair(depth: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.concatenate([_numbers(x, np.uint64) for x in table.column("keys")])
        n = np.concatenate([_numbers(x, np.int64) for x in table.column("counts")])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        pair = key[0].as_py()
        nodes, mixed = subtree(keys, n, depth, 2)
        rows = [(pair, int(c) & 255, int(z), int(o), float(w), None, None) for part in nodes for c, z, o, w in zip(*part, strict=True)]
        rows += [(pair, None, None, None, None, keys[a : a + PIECE].tobytes(), mixed[a : a + PIECE].tobytes()) for a in range(0, len(keys), PIECE)]
        return pa.Table.from_batches([_rows(_WEIGHED, rows)])

    return run


def _values(roots: Roots, depth: int, buckets: int):
    """The log-probability of each key, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m in zip(batch.column(0), batch.column(1), strict=True):
                keys = _numbers(k, np.uint64)
                value = roots.log10(keys, _numbers(m, np.float64).reshape(-1, 8), depth)
                order, of = _dealt(keys, buckets)
                keys, value = keys[order], value[order]
                yield _rows(_VALUES, [(GRAM, b, keys[a:z].tobytes(), value[a:z].tobytes()) for b, a, z in _groups(of)])

    return B.lean(run)


def _answer(members: pa.Table, known: pa.Table) -> pa.Table:
    """For each block its keys of one bucket, with their values."""
    rows = []
    if members.num_rows:
        keys = np.concatenate([_numbers(x, np.uint64) for x in known.column("keys")])
        held = np.concatenate([_numbers(x, np.float64) for x in known.column("held")])
        order = np.argsort(keys)
        keys, held = keys[order], held[order]
        for kind, block, mine in zip(*(members.column(c) for c in ("kind", "block_id", "keys")), strict=True):
            at = _places(len(keys), mine.as_py())
            rows.append((block.as_py(), kind.as_py(), keys[at].tobytes(), held[at].tobytes()))
    return pa.Table.from_batches([_rows(_ANSWER, rows)])


def _as_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts as the floating-point values that answers carry (exact up to 2**53)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([_numbers(x, np.int64).astype(np.float64).tobytes() for x in batch.column(3)], pa.binary())], ["kind", "bucket", "keys", "held"])


def _score(schema: T.StructType, text_col: str, held: str, depth: int, n_all: int, n_seen: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, found = B.decode(batch.column(1)[i].as_py()), batch.column(2)[i].values
                value, keys = {}, {}
                for kind in (GRAM, WORD):
                    own = found.filter(pc.equal(found.field("kind"), kind))
                    keys[kind], value[kind] = (np.concatenate([_numbers(x, t) for x in own.field(c)]) for c, t in (("keys", np.uint64), ("held", np.float64)))
                    order = np.argsort(keys[kind])
                    keys[kind], value[kind] = keys[kind][order], value[kind][order]
                for at, texts, by_kind, sizes in chunks(docs, text_col, depth):
                    mine = {k: value[k][np.searchsorted(keys[k], c.keys)] for k, c in by_kind.items()}
                    seen = mine[WORD]
                    score = by_kind[GRAM].total(mine[GRAM], texts)
                    out = {
                        "held_out": docs.column(docs.schema.get_field_index(held)).slice(at, texts),
                        "n_tokens": pa.array(by_kind[WORD].total(np.ones_like(seen), texts).astype(np.int64)),
                        "n_known": pa.array(by_kind[WORD].total((seen > 0).astype(np.float64), texts).astype(np.int64)),
                        "train_tokens": pa.array(np.full(texts, n_all, dtype=np.int64)),
                        "n_bytes": pa.array(sizes.astype(np.int64)),
                        "base_score": pa.array(by_kind[WORD].total(np.log10((seen + 1) / (n_all + n_seen + 1)), texts)),
                        "score": pa.array(score),
                        "bits_per_byte": pa.array(-score * (LN10 / LN2) / (sizes + 1)),
                    }
                    yield B.put_columns(docs.slice(at, texts), schema, out)

    return B.lean(run)


def score_documents(docs: DataFrame, held_out: Column, text_col: str = "text", depth: int = 5) -> DataFrame:
    """``docs`` with the score of each text under a model of the texts that are not held out.

    Adds ``held_out`` (null counts as false), ``n_tokens``, ``n_known``, ``train_tokens`` and
    ``base_score`` of the add-one unigram base, ``n_bytes``, ``score`` (log10 of the probability
    of the lower-cased text's bytes and its end) and ``bits_per_byte`` (code length over bytes and
    end); columns of these names are replaced.  ``depth`` is the longest context in bytes, 2 to 6.

    A null text is empty and keeps its row; an empty text is its end alone.  Repeated rows count
    as often as they occur and score alike.  An empty table gives no rows; without training
    texts every bit has probability 1/2.  A single text is one unit of memory (some 80 bytes for
    each of its bytes).  Word counts go by 64-bit hashes.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6 bytes")
    # Plain names on the way: Python workers can't take a name that holds a dot.
    names, held = [f"_{i}" for i in range(len(docs.columns))], "_held"
    text = names[[c.lower() for c in docs.columns].index(text_col.lower())]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.coalesce(held_out, F.lit(False)).alias(held))
    packed = B.pack(plain, text, BLOCK_BYTES)
    buckets = B.bucket_count(packed, 1 << 19)
    added = materialize(_send(packed, text, held, depth, buckets).groupBy("kind", "bucket").applyInArrow(_add_up, _ADDED), "lm-totals")
    totals = added.where("block_id IS NULL")
    n_all, n_seen = totals.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_seen"), F.lit(0))).first()
    paired = totals.where(F.col("kind") == GRAM).select("keys", "counts").mapInArrow(_pairs(depth), _PAIRED)
    weighed = materialize(paired.groupBy("pair").applyInArrow(_weigh_pair(depth), _WEIGHED), "lm-subtrees")
    upper = weighed.where("node IS NOT NULL").groupBy(F.shiftright("pair", 8).alias("byte"), "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("lw"))
    roots = Roots([tuple(r) for r in upper.collect()])  # at most 256 x 255 rows, whatever the corpus
    values = weighed.where("node IS NULL").select("keys", "mixed").mapInArrow(_values(roots, depth, buckets), _VALUES)
    counts = totals.where(F.col("kind") == WORD).select("kind", "bucket", "keys", "counts").mapInArrow(_as_numbers, _VALUES)
    members = added.where("block_id IS NOT NULL").select("kind", "bucket", "block_id", "keys")
    by = ("kind", "bucket")
    answers = members.groupBy(*by).cogroup(values.union(counts).groupBy(*by)).applyInArrow(_answer, _ANSWER)
    found = answers.groupBy("block_id").agg(F.collect_list(F.struct("kind", "keys", "held")).alias("found"))
    schema = B.with_columns(T.StructType([f for f in plain.schema if f.name != held]), _SCORES)
    out = packed.join(found, "block_id").select("block_id", "payload", "found").mapInArrow(_score(schema, text, held, depth, int(n_all), int(n_seen)), schema)
    new = [f.name for f in T.StructType.fromDDL(_SCORES)]
    kept = [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True) if c.lower() not in new]
    return out.select(*kept, *new)
