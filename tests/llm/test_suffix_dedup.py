import hashlib
import random

import pytest

from pathloom.llm.suffix_dedup import repeated_bytes, repeated_offsets
from pathloom.llm.suffix_sort import blind_trie, common_prefix, deep_shallow_sort


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - window + 1):
            seen.setdefault(b[i : i + window], []).append((d, i))
    gone = [bytearray(len(b)) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + window] = b"\1" * window
    out = []
    for b, g in zip(raw, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        spans = sum(1 for i, y in enumerate(g) if y and (i == 0 or not g[i - 1]))
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_sorts(seed=3):
    rng = random.Random(seed)
    for n in (1, 2, 40, 300):
        base = [bytes(rng.choices(b"ab", k=rng.randint(0, 300))) for _ in range(6)]
        s = [rng.choice(base)[: rng.randint(0, 300)] + bytes(rng.choices(b"abc", k=rng.randint(0, 4))) for _ in range(n)]
        assert [s[i] for i in deep_shallow_sort(s)] == sorted(s)
        assert [s[i] for i in blind_trie(s, list(range(n)))] == sorted(s)
        for x, y in zip(s, s[1:]):
            p = common_prefix(x, y)
            assert x[:p] == y[:p] and (p == min(len(x), len(y)) or x[p] != y[p])


def test_offsets_against_all_pairs():
    rng = random.Random(8)
    for _ in range(200):
        window = 12
        spans = set()
        for _ in range(rng.randint(2, 12)):
            before = rng.randint(0, 10)
            after = rng.randint(max(2, window - before), 14)
            spans.add((before, bytes(rng.choices(b"ab", weights=(9, 1), k=before)) + b"XY" + bytes(rng.choices(b"ab", weights=(9, 1), k=after))))
        spans = list(spans)
        got = repeated_offsets(spans, window)
        for i, (b, s) in enumerate(spans):
            want = set()
            for j, (c, t) in enumerate(spans):
                if i != j:
                    want |= {d for d in range(0, min(b, c) + 1) if len(s[b - d : b - d + window]) == window and s[b - d : b - d + window] == t[c - d : c - d + window]}
            have = {d for lo, hi in got[i] for d in range(max(lo, 0), hi + 1) if d <= b and len(s) - b + d >= window}
            assert have == want


@pytest.mark.parametrize("window", [8, 40, 400])
@pytest.mark.parametrize("group_blocks", [0, 2, 64])
def test_against_brute_force(spark, window, group_blocks, monkeypatch):
    import pathloom.llm.blocks as blocks
    import pathloom.llm.suffix_dedup as m

    monkeypatch.setattr(m, "GROUP_BLOCKS", group_blocks)
    monkeypatch.setattr(blocks.pack, "__defaults__", (900,))  # many blocks
    rng = random.Random(window)
    word = lambda: "".join(rng.choices("abcdeé語", k=rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(window))
    texts = []
    for _ in range(40):
        t = " ".join(word() for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, window)
            at = rng.randint(0, len(t))
            t = t[:at] + passage[a : a + rng.randint(window // 2, 2 * window)] + t[at:]
        texts.append(t)
    texts += [None, "", "a" * 3000, "ab" * 900, texts[2], texts[2], "x"]
    rows = [(i // 2, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(4)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(df, window=window).collect())
    assert got == sorted((r[0], *b) for r, b in zip(rows, brute(texts, window), strict=True))


def test_long_texts_over_segments(spark, monkeypatch):
    import numpy as np

    import pathloom.llm.suffix_dedup as m

    rng = random.Random(1)
    raw = np.frombuffer(bytes(rng.choices(b"abcd", k=5000)), dtype=np.uint8)
    offs = np.array([0, 1200, 1200, 5000])
    one = m.anchors(raw, offs, 40)
    monkeypatch.setattr(m, "SEGMENT", 333)
    many = m.anchors(raw, offs, 40)
    cover = lambda x: {(int(a), s) for a, f, z in zip(*x[1:], strict=True) for s in range(f, z + 1)}
    assert cover(one) == cover(many)


def test_empty_table_and_characters(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "é" * 500), (None, None)], "doc_id long, text string")
    got = sorted((r.n_removed, r.text) for r in repeated_bytes(df, window=401).collect() if r.text is not None)
    assert got == [(1000, "")]
