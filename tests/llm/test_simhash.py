import random
import re

import pytest
import xxhash

from pathloom.llm.simhash import group_fingerprints, segments, simhash_components, simhash_dedup


def plain_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, distance):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("n", [1000, 1 << 22, 1 << 30])
@pytest.mark.parametrize("distance", [1, 2, 4])
def test_groups_against_brute_force(spark, n, distance, monkeypatch):
    import pathloom.llm.simhash as m

    cuts = segments(n, distance)
    assert sum(r + 1 for _, _, r in cuts) == distance + 1
    monkeypatch.setattr(m, "segments", lambda *_: cuts)
    rng = random.Random(distance)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            fps.add(y)
            x = rng.choice([x, y])
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.fp: r.grp for r in group_fingerprints(df, distance).collect()}
    want = plain_components(fps, distance)
    assert len(got) == len(fps)
    pairs = {(got[signed(x)], w) for x, w in zip(fps, want, strict=True)}
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 60, 300]))) for _ in range(15)]
    texts = [None, "", " \n", "One", "one", "É é", "x " * 9000]
    for b in base:
        for _ in range(4):
            w = b.split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = "changed"
            texts.append(rng.choice([" ", "\n"]).join(w))
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)] + [(None, texts[9], "x"), (991, texts[9], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    fps = [plain_fingerprint(t, 4) for _, t, _ in rows]
    label = plain_components(fps, 4)
    least = {c: min(r[0] for r, x in zip(rows, label, strict=True) if x == c and r[0] is not None) for c in set(label)}
    want = sorted((str(r[0]), f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, label, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_components(df).collect())
    assert got == want


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names(spark):
    rows = [(1, "a b c d e", "x", "y", "z"), (2, "A b c d e", "u", "v", "w")]
    df = spark.createDataFrame(rows, ["doc_id", "text", "_fp", "_row", "_lfp"])
    got = sorted(simhash_components(df).collect())
    assert [tuple(r[:5]) for r in got] == rows and {r.component_id for r in got} == {1}
    assert [tuple(r) for r in simhash_dedup(df).collect()] == rows[:1]
