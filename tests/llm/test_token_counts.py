import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pathloom.llm.token_counts import TokenRollup, rollup_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long, extra int"


def test_signed_batches(spark, tmp_path):
    rng = random.Random(1)
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.totals().count() == 0
    live = []
    for batch in range(4):
        rows = []
        for _ in range(60):
            what = rng.random()
            new = (rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.choice([None, 0, 5, 12]))
            if what < 0.5 or not live:
                rows.append(("insert", *new, None, None, None, None, 1))
                live.append(new)
            else:
                old = live.pop(rng.randrange(len(live)))
                if what < 0.7:
                    rows.append(("delete", None, None, None, None, *old, 1))
                else:
                    rows.append(("revise", *new, *old, 1))
                    live.append(new)
        changes = spark.createDataFrame(rows, SCHEMA)
        assert rollup.commit(f"b{batch}", changes)
        assert not rollup.commit(f"b{batch}", changes)
        docs, tokens = Counter(), Counter()
        for s, g, v, n in live:
            docs[s, g, v] += 1
            tokens[s, g, v] += n or 0
        got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
        assert got == {k: (docs[k], tokens[k]) for k in docs}
    assert rollup.committed() == ["b0", "b1", "b2", "b3"]
    assert rollup.commit("empty", spark.createDataFrame([], SCHEMA))
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("bad", spark.createDataFrame([("upsert", *[None] * 9)], SCHEMA))


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "One two  three.\n", "été it's <|endoftext|>", "word " * 4000]
    rows = [(random.Random(i).choice(["s", None]), "en" if i % 2 else None, t, 9) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "source string, lang string, text string, tokens int")
    want = {}
    for s, g, t, _ in rows:
        for v, n in (("words", len((t or "").split())), ("bpe", len(library.encode(t or "", add_special_tokens=False).ids))):
            d, x = want.get((s, g, v), (0, 0))
            want[s, g, v] = (d + 1, x + n)
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup_documents(df, {"words": "", "bpe": PATH}).collect()}
    assert got == want
    assert rollup_documents(df.limit(0), {"words": ""}).count() == 0


def test_two_writers_and_folds(spark, tmp_path):
    change = lambda *rows: spark.createDataFrame([(op, "s", "en", "v", n, "s", "en", "v", o) for op, n, o in rows], "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long")
    one, two = (TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    held = lambda: [(r.n_docs, r.n_tokens) for r in one.totals().collect()]
    assert held() == [] and not one.fold()
    real = TokenRollup._put

    def late(self, staged, name):
        """The other writer commits between staging and renaming."""
        TokenRollup._put = real
        assert two.commit("a", change(("insert", 5, None)))
        return real(self, staged, name)

    TokenRollup._put = late
    try:
        assert not one.commit("a", change(("insert", 5, None)))
    finally:
        TokenRollup._put = real
    assert held() == [(1, 5)] and one.committed() == ["a"]
    assert one.commit("b", change(("insert", 7, None), ("revise", 4, 5))) and held() == [(2, 11)]
    assert one.fold() and held() == [(2, 11)] and not two.fold()
    assert not two.commit("a", change(("insert", 5, None))) and held() == [(2, 11)]
    assert two.commit("c", change(("delete", None, 7))) and held() == [(1, 4)]
    assert one.fold() and held() == [(1, 4)] and one.committed() == ["a", "b", "c"]
    assert two.commit("d", change(("delete", None, 4))) and held() == []
    assert not [x for x in (tmp_path / "r").iterdir() if x.name.startswith("staging")]
