"""Vectorised 64-bit hashes of words, k-grams and windows over a byte buffer.

All of them are polynomial prefix sums modulo 2**64 with an odd base: the hash of any
run of symbols is a difference of two prefix sums times an inverse power, so a window
costs three array operations whatever its width.  Symbols are random 64-bit values
(one per byte, or a mixed word hash), which keeps structured texts from colliding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes 0x09-0x0D and 0x20 end a word; UTF-8 never uses them inside a character.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once, so that one very long text needs no more memory than a block.
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; the longest table so far is kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of ``symbols[i] * BASE**i``, with a leading zero."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=out[1:])
    return out


def windows(symbols: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``symbols[i:i + width]`` for every i that has a whole window."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix(symbols)
    out = sums[width:] - sums[:n]
    out *= powers(INVERSE, n)
    return mix(out)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the word index at which each text starts."""
    solid = np.zeros(len(raw) + 1, dtype=bool)
    solid[:-1] = ~SPACE[raw]
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = solid[:-1]
    cut = offs[:-1][offs[:-1] < len(raw)]
    inside = before.copy()
    inside[cut] = False
    starts = np.flatnonzero(solid & ~inside)
    follows = solid.copy()
    follows[cut] = False
    ends = np.flatnonzero(before & ~follows)
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed hash of each word, computed over chunks that start at a word."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        sums = prefix(BYTE_VALUES[raw[low : int(ends[to - 1])]])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * powers(INVERSE, len(sums))[s]
        at = to
    # The length goes in too: a word is not its own zero-extended neighbour.
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the ``n`` places covered by a run of ``width`` from any of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
