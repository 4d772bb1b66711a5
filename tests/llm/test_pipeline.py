import random
import re

import public_tokenizers
import pytest
from test_native import plain_base, plain_lines, prose, words
from test_simhash_similar import plain_firsts
from test_suffix_dedup import brute as plain_repeats
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

PHRASES = ["cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "subscribe to our", "lorem ipsum"]
MENU = r"^[^a-z]*(home|menu|log in|login|sign in|sign up|next|previous|read more|click here|share|search|back to top|contact us|about us)([^a-z]|\Z)"


def plain_fails(line):
    w = words(line)
    if not w:
        return False
    s = len(re.findall(r"[#*$%&|<>]", line))
    return (
        line.rstrip(" \t\n\x0b\x0c\r")[-1] not in '.!?…:;)]"”»。！？'
        or s * 10 > len(w)
        or len(w) >= 3 and not re.search("[a-z]", line) and bool(re.search("[A-Z]", line))
        or len(re.findall("[|»›•]", line)) >= 2
        or len(w) <= 6 and bool(re.search(MENU, line, re.I))
        or any(p in line.lower() for p in PHRASES)
    )


def plain_quality(text):
    base = plain_base(text)
    lines = (text or "").split("\n")
    bad = [plain_fails(x) for x in lines]
    lost = sum(len(x) for line, b in zip(lines, bad, strict=True) if b for x in words(line))
    kept = not base[5] and lost * 10 <= base[1] * 3
    return kept, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)


def rows_of(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


@pytest.fixture
def docs(spark):
    rng = random.Random(11)
    footer = "Visit the site again for more of this fine prose every day."
    shared = prose(rng, 8)
    rows = []
    for i in range(70):
        t = prose(rng, rng.randint(6, 14))
        if i % 7 == 0:
            t = shared.replace("\n", " ") + " " + t
        if i % 5 == 0:
            t += "\n" + footer
        if i % 9 == 0:
            t += "\nhome about\nWE USE COOKIES HERE."
        if i % 10 == 3:
            t = rows[-1][1] if rng.random() < 0.5 else rows[-1][1].replace("Word1", "word1", 1)
        if i % 10 == 4:
            t = rng.choice(["short one.", "a| b| c|" * 40, None, ""])
        rows.append((i, t, "en", f"s{i % 8}", len(t or "")))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages(spark, docs):
    rows, df = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    f = dict(corpus_pipeline.STAGES)
    step = lambda name, have: spark.createDataFrame(rows_of(f[name](spark, have, "")), df.schema)

    want = sorted((i, plain_quality(t)[1], g, s, len(plain_quality(t)[1])) for i, t, g, s, _ in rows if plain_quality(t)[0])
    one = step("quality_rules", df)
    assert rows_of(one) == want and 0 < len(want) < len(rows)

    cleaned = {i: x for i, x, _, _ in plain_lines([(i, t, s) for i, t, _, s, _ in want], 5)}
    want = sorted((i, cleaned[i], g, s, len(cleaned[i])) for i, _, g, s, _ in want)
    two = step("line_dedup", one)
    assert rows_of(two) == want

    stay, _ = plain_firsts([r[1] for r in want])  # ``want`` is ordered by id
    want = [want[i] for i in stay]
    three = step("simhash_near_dedup", two)
    assert rows_of(three) == want

    four = step("suffix_array_dedup", three)
    lost = {r[0]: b[1] for r, b in zip(want, plain_repeats([r[1] for r in want], corpus_pipeline.PASSAGE), strict=True)}
    got = rows_of(four)
    assert [r[0] for r in got] == [r[0] for r in want] and any(lost.values())
    for r, before in zip(got, want, strict=True):
        assert len(r[1].encode()) == len(before[1].encode()) - lost[r[0]] and r[4] == len(r[1])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = f["best_fit_packing"](spark, four, "").collect()
    total = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t, _, _, _ in got}
    for i, n in total.items():
        own = sorted((p for p in packed if p.doc_id == i), key=lambda p: p.piece)
        assert sum(p.length for p in own) == n
    places = {}
    for p in packed:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_run_equals_its_stages(spark, docs, tmp_path):
    _, df = docs
    df.write.parquet(f"{tmp_path}/documents.parquet")
    have = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        have = stage(spark, have, str(tmp_path))
    key = lambda x: sorted((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in x.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(corpus_pipeline.STAGES[-1][1](spark, have, ""))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
