import hashlib
import random

import pytest

from pathloom.llm.substring_dedup import difference_cover, repeated_words


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [[False] * len(w) for w in split]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + window] = [True] * window
    out = []
    for w, g in zip(split, gone, strict=True):
        kept = b" ".join(x for x, y in zip(w, g, strict=True) if not y)
        out.append((len(w), sum(g), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("v", [1, 2, 5, 7, 13, 21])
def test_difference_cover_has_every_residue(v):
    c = difference_cover(v)
    assert {(a - b) % v for a in c for b in c} == set(range(v))


@pytest.mark.parametrize("window", [5, 12, 35])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(300)] + ["é", "ab", "ba"]
    passage = [rng.choice(vocab) for _ in range(window + 9)]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            a, n = rng.randint(0, 8), rng.randint(window - 2, window + 4)
            at = rng.randint(0, len(w))
            w[at:at] = passage[a : a + n]
        texts.append(rng.choice(["\n", "  ", "\t "]).join(w))
    texts += [None, "", "   ", "a" * 5000, texts[3], texts[3], "x " * 200, " ".join("abc")]
    rows = [(i // 2, t, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeated_words(df, window=window).collect())
    want = sorted((r[0], *b) for r, b in zip(rows, brute(texts, window), strict=True))
    assert got == want


def test_empty_table_and_null_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_words(df).count() == 0
    df = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed, r.text) for r in repeated_words(df).collect()] == [(0, 0, ""), (0, 0, "")]
