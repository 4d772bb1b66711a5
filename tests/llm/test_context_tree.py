import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import context_tree as CT


def kt(zeros, ones):
    """The estimator one bit after the other."""
    p, n = 0.0, [0, 0]
    for bit in [0] * zeros + [1] * ones:
        p += math.log((n[bit] + 0.5) / (sum(n) + 1))
        n[bit] += 1
    return p


class Brute:
    """The trees as nested dictionaries, weighted by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n, self.kids = depth, {}, {}
        for t in texts:
            for context, sym in self.symbols(t):
                for d in range(depth + 1):
                    c = context[:d]
                    for i in range(8):
                        node = (c, sym >> (8 - i) | 1 << i)
                        self.n.setdefault(node, [0, 0])[sym >> (7 - i) & 1] += 1
                        if d < depth:
                            self.kids.setdefault(node, set()).add((context[: d + 1], node[1]))
        self.memo = {}

    def symbols(self, text):
        b = bytes([255] * self.depth) + (text or "").translate({c: c + 32 for c in range(65, 91)}).encode() + b"\xff"
        return [(b[i - self.depth : i][::-1], b[i]) for i in range(self.depth, len(b))]

    def weighted(self, node):
        if node not in self.memo:
            own = kt(*self.n[node])
            if len(node[0]) == self.depth:
                self.memo[node] = own, None
            else:
                below = sum(self.weighted(k)[0] for k in self.kids[node])
                self.memo[node] = np.logaddexp(own, below) - math.log(2), below - own
        return self.memo[node]

    def log10(self, context, sym):
        out = 0.0
        for i in range(8):
            mixed = None
            for d in range(self.depth, -1, -1):
                node, bit = (context[:d], sym >> (8 - i) | 1 << i), sym >> (7 - i) & 1
                if node not in self.n:
                    continue
                n = self.n[node]
                p = (n[bit] + 0.5) / (sum(n) + 1)
                if mixed is not None:
                    share = 1 / (1 + math.exp(min(self.weighted(node)[1], 700)))
                    p = share * p + (1 - share) * mixed
                mixed = p
            out += math.log10(0.5 if mixed is None else mixed)
        return out

    def score(self, text):
        return sum(self.log10(c, s) for c, s in self.symbols(text))


def base(texts, held):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for t in texts]
    count = {}
    for ts, h in zip(tokens, held, strict=True):
        for w in ts if not h else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return [(len(ts), sum(w in count for w in ts), n, sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ts)) for ts in tokens]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def is_held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 15.9, 16, 100.5, 1e6, 1e12])
    assert np.allclose(CT.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    assert np.allclose(CT.log_kt(np.array([0, 3, 5]), np.array([0, 0, 9])), [kt(0, 0), kt(3, 0), kt(5, 9)])


@pytest.mark.parametrize("depth", [2, 3, 5, 6])
def test_against_brute_force(spark, depth):
    rng = random.Random(depth)
    texts = ["".join(rng.choice("abcAé \n") for _ in range(rng.randint(0, 60))) for _ in range(30)] + [None, "", "Abc abc", "Abc abc", "日本 \U0001f600", "\x00\x0b x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = CT.score_documents(docs, is_held(), depth=depth).collect()
    held = [held_out(i) for i, _ in rows]
    model = Brute([t for (_, t), h in zip(rows, held, strict=True) if not h], depth)
    want = sorted((str(i), h, *b[:3], round(b[3], 7), round(model.score(t), 7)) for (i, t), h, b in zip(rows, held, base([t for _, t in rows], held), strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in got) == want
    assert any(held) and not all(held)


def test_next_bytes_sum_to_one(spark):
    """After any context the probabilities of all bytes add up to one."""
    model = Brute(["abab abc", "bca"], 3)
    for context in (b"aba", b"\xff\xff\xff", b"zzz", b"bzz"):
        assert math.isclose(sum(10 ** model.log10(context, s) for s in range(256)), 1)
        keys = np.array([int.from_bytes(context, "big") << 8 | s for s in range(256)], dtype=np.uint64)
        seen = {}
        for t in ("abab abc", "bca"):
            for c, s in model.symbols(t):
                k = int.from_bytes(c, "big") << 8 | s
                seen[k] = seen.get(k, 0) + 1
        nodes, parts = {}, []
        both = {}
        for k in [*keys.tolist(), *seen]:
            both[k] = seen.get(k, 0)
        for pair in {k >> 16 for k in both}:
            mine = np.array(sorted(k for k in both if k >> 16 == pair), dtype=np.uint64)
            found, mixed = CT.subtree(mine, np.array([both[k] for k in mine.tolist()]), 3, 2)
            parts.append((mine, mixed))
            for part in found:
                for c, z, o, w in zip(*part, strict=True):
                    at = nodes.setdefault((pair >> 8, int(c) & 255), [0, 0, 0.0])
                    at[0], at[1], at[2] = at[0] + z, at[1] + o, at[2] + w
        roots = CT.Roots([(*k, *v) for k, v in nodes.items()])
        p = {k: v for mine, mixed in parts for k, v in zip(mine.tolist(), roots.log10(mine, mixed, 3), strict=True)}
        assert math.isclose(sum(10 ** p[k] for k in keys.tolist()), 1)
        assert all(math.isclose(p[k], model.log10(context, k & 255)) for k in keys.tolist())


def test_no_training_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = CT.score_documents(docs, F.lit(True)).collect()
    assert {r.doc_id: round(r.score, 9) for r in rows} == {1: round(-24 * math.log10(2), 9), 2: round(-8 * math.log10(2), 9)}
    assert {(r.n_known, r.train_tokens, r.base_score) for r in rows} == {(0, 0, 0.0)}
    assert CT.score_documents(docs.limit(0), F.lit(False)).count() == 0


def test_clashing_and_dotted_names(spark):
    docs = spark.createDataFrame([(1, "ab ab", "x", "y", "z"), (2, "ab", "p", None, "q")], ["doc_id", "text", "a.b", "score", "_held"])
    out = CT.score_documents(docs, F.col("doc_id") == 2)
    assert out.columns[:4] == ["doc_id", "text", "a.b", "_held"] and "score" in out.columns
    assert {(r.doc_id, r["a.b"], r["_held"], r.held_out) for r in out.collect()} == {(1, "x", "z", False), (2, "p", "q", True)}


def test_a_text_longer_than_the_others(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(3000))
    rows = [(1, long), (2, "alpha beta"), (3, long[:500]), (4, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    model = Brute([t for i, t in rows if i != 2], 3)
    got = {r.doc_id: r.score for r in CT.score_documents(docs, F.col("doc_id") == 2, depth=3).collect()}
    assert all(math.isclose(got[i], model.score(t), rel_tol=1e-9) for i, t in rows)
