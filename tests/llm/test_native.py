import random
import re

from pathloom.llm.line_dedup import line_dedup
from pathloom.llm.quality_rules import quality_rules


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def plain_base(text):
    w = words(text or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def prose(rng, lines):
    return "\n".join(" ".join(f"Word{rng.randint(0, 10**6)}" for _ in range(10)) + "." for _ in range(lines))


def test_quality_rules(spark):
    rng = random.Random(2)
    clean = prose(rng, 12)
    texts = [None, "", " \n\t", "a b a b a b a", "x " * 9000, clean]
    bad = ["home about us", "a | b | c.", "WE SHOUT THIS LINE.", "We use cookies: see our Cookie Policy.", "no end of a sentence here", "a# b# c# d#."]
    texts += [clean + "\n" + "\n".join(bad), clean + "\n" + "\n".join(bad * 20), prose(rng, 3000), " ".join(rng.choice("abcde") for _ in range(200)) + "."]
    df = spark.createDataFrame([(i, t, True, 4) for i, t in enumerate(texts)] * 2, "doc_id long, text string, kept boolean, extra int")
    out = quality_rules(df)
    rows = out.collect()
    assert len(rows) == 2 * len(texts) and out.columns == ["doc_id", "text", "extra", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(texts[r.doc_id])
    verdict = {r.doc_id: r.kept for r in rows}
    assert verdict[5] and verdict[6] and not verdict[7] and not any(verdict[i] for i in range(5))
    assert {r.doc_id: r.cleaned for r in rows}[6] == clean
    assert sorted({r.doc_id for r in out.where("kept").collect()}) == [i for i in verdict if verdict[i]]
    assert quality_rules(df.limit(0)).count() == 0


def plain_lines(rows, least):
    sites, home = {}, {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if k := x.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(k, set()).add(s)
                if i is not None:
                    home[k] = min(i, home.get(k, i))
    wide = {k for k, v in sites.items() if len(v - {None}) >= least}
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
        gone = [bool(k) and k in wide and k in home and home[k] != i for k in keys]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), sum(map(bool, keys)), sum(gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(7)
    pool = [f"line {i} é" for i in range(12)] + ["", "  ", " line 1 é\t"]
    for least in (2, 5, 40):
        rows = [(rng.choice([None, rng.randint(0, 60)]), rng.choice([None, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))]), rng.choice([None, f"s{rng.randint(0, 60)}", "hot", "hot"])) for _ in range(400)]
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_lines int").repartition(6)
        got = sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup(df, min_sites=least).collect())))
        assert got == sorted(map(str, plain_lines(rows, least)))
    assert line_dedup(df.limit(0)).count() == 0


def test_lines_with_clashing_names(spark):
    names = ["_row", "row", "gone", "split", "doc", "h", "_gone", "_split"]
    rows = [(i, "same line here\nown line %d" % i, f"s{i}", *[f"{c}{i}" for c in names]) for i in range(6)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = {r.doc_id: r for r in line_dedup(df).collect()}
    assert [out[i].text for i in range(6)] == [rows[0][1]] + [f"own line {i}" for i in range(1, 6)]
    assert all(out[i][c] == f"{c}{i}" for i in range(6) for c in names)
