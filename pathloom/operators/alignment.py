"""Local alignment of sequence pairs, many pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Table cells filled at once; pairs of like size share a batch.
CELLS = 1 << 22


def _codes(texts: list[str], pad: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0)), pad, dtype=np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    return out


def score_tables(a: list[str], b: list[str], match: int, mismatch: int, gap: int) -> np.ndarray:
    """``(pairs, m + 1, n + 1)``: best local scores, an anti-diagonal of all pairs at a time."""
    x, y = _codes(a, -1), _codes(b, -2)
    m, n = x.shape[1], y.shape[1]
    h = np.zeros((len(a), m + 1, n + 1), dtype=np.int32)
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        j = d - i
        step = np.where(x[:, i - 1] == y[:, j - 1], match, mismatch)
        h[:, i, j] = np.maximum(0, np.maximum(h[:, i - 1, j - 1] + step, np.maximum(h[:, i - 1, j], h[:, i, j - 1]) + gap))
    return h


def score_matrix(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> np.ndarray:
    """The table of one pair."""
    return score_tables([a], [b], match, mismatch, gap)[0]


def best_score(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best score and where it first stands by row, keeping three anti-diagonals only."""
    x, y = _codes([a], -1)[0], _codes([b], -2)[0]
    m, n = len(x), len(y)
    last, here, best = np.zeros(m + 1, dtype=np.int32), np.zeros(m + 1, dtype=np.int32), (0, 0, 0)
    for d in range(2, m + n + 1):
        lo, hi = max(1, d - n), min(m, d - 1)
        i = np.arange(lo, hi + 1)
        step = np.where(x[lo - 1 : hi] == y[d - i - 1], match, mismatch)
        new = np.zeros(m + 1, dtype=np.int32)
        new[lo : hi + 1] = np.maximum(0, np.maximum(last[lo - 1 : hi] + step, np.maximum(here[lo - 1 : hi], here[lo : hi + 1]) + gap))
        top = int(new[lo : hi + 1].argmax()) + lo if hi >= lo else 0
        if new[top] > best[0] or new[top] == best[0] > 0 and (top, d - top) < best[1:]:
            best = (int(new[top]), top, d - top)
        last, here = here, new
    return best


def trace(h: np.ndarray, a: str, b: str, match: int, mismatch: int, gap: int) -> tuple[int, int, int, str, str]:
    """Best score, where it first stands (by row), and the aligned strings with gaps.

    The way back prefers the diagonal, then up, then left, and stops at zero.
    """
    i, j = divmod(int(h[: len(a) + 1, : len(b) + 1].argmax()), len(b) + 1)
    score, end_i, end_j, top, low = int(h[i, j]), i, j, [], []
    while i > 0 and j > 0 and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            top.append(a[i])
            low.append(b[j])
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
            top.append(a[i])
            low.append("-")
        else:
            j -= 1
            top.append("-")
            low.append(b[j])
    return score, end_i, end_j, "".join(reversed(top)), "".join(reversed(low))


def align(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, str, str]:
    """One pair's alignment."""
    return trace(score_matrix(a, b, match, mismatch, gap), a, b, match, mismatch, gap)


def align_all(a: list[str], b: list[str], match: int, mismatch: int, gap: int) -> list[tuple[int, int, int, str, str]]:
    """Alignments of many pairs, batched by size."""
    out: list = [None] * len(a)
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    at = 0
    while at < len(order):
        to, m, n = at, 0, 0
        while to < len(order):
            m2, n2 = max(m, len(a[order[to]])), max(n, len(b[order[to]]))
            if to > at and (to + 1 - at) * (m2 + 1) * (n2 + 1) > CELLS:
                break
            m, n, to = m2, n2, to + 1
        part = order[at:to]
        for k, h in zip(part, score_tables([a[k] for k in part], [b[k] for k in part], match, mismatch, gap), strict=True):
            out[k] = trace(h, a[k], b[k], match, mismatch, gap)
        at = to
    return out


def local_alignments(pairs: DataFrame, a: str = "a", b: str = "b", match: int = 2, mismatch: int = -1, gap: int = -1, traced: bool = True) -> DataFrame:
    """``pairs`` plus ``score``, ``end_a``, ``end_b`` and, if ``traced``, the aligned strings.

    A null sequence counts as empty; empty sequences score zero at (0, 0).  Without the
    strings a pair needs memory for its sequences only, not for their table.  Pairs are
    dealt over all cores first: a row is work, however few bytes it has.
    """
    extra = "score int, end_a int, end_b int" + (", aligned_a string, aligned_b string" if traced else "")
    schema = f"{pairs.schema.toDDL()}, {extra}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, y = [t or "" for t in pdf[a]], [t or "" for t in pdf[b]]
            found = align_all(x, y, match, mismatch, gap) if traced else [best_score(s, t, match, mismatch, gap) for s, t in zip(x, y, strict=True)]
            yield pd.concat([pdf, pd.DataFrame(found, columns=["score", "end_a", "end_b", "aligned_a", "aligned_b"][: 5 if traced else 3], index=pdf.index)], axis=1)

    return pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, schema)
