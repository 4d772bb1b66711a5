import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm.bpe import NONE, RankTree, encode_decode, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def test_rank_tree():
    rng = random.Random(2)
    for n in (1, 2, 5, 17):
        ranks = [rng.choice([None, 1, 2, 3]) for _ in range(n)]
        tree = RankTree(ranks)
        for _ in range(60):
            live = [(r, i) for i, r in enumerate(ranks) if r is not None]
            assert tree.root() == (min(live)[0] << 32 | min(live)[1] if live else NONE)
            i = rng.randrange(n)
            ranks[i] = rng.choice([None, 1, 2, 3])
            tree.put(i, ranks[i])


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aàÀeéE̊sΣς ß's<|endoftext|>İ1２.,\n \u0085\x1c한글", max_size=60))
def test_ids_equal_the_library(text):
    bpe = word_bpe(PATH)
    found = [bpe.pieces[x] for x in text.encode().split()]
    e = LIBRARY.encode(text, add_special_tokens=False)
    assert " ".join(x[1].decode() for x in found if x[0]) == " ".join(map(str, e.ids))
    assert " ".join(x[2].decode() for x in found if x[0]) == LIBRARY.decode(e.ids, skip_special_tokens=False)


def test_query_rows(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "a" * 3000, "<|endoftext|>x <|startoftext|>", "don't I'll THE thé 123", " ".join("".join(rng.choices("abcdetion", k=rng.randint(1, 12))) for _ in range(3000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids int")
    rows = encode_decode(df, PATH).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        e = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(e.ids), " ".join(map(str, e.ids)), LIBRARY.decode(e.ids, skip_special_tokens=False))
    assert encode_decode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [100_000])
def test_long_word_is_fast(n):
    text = "".join(random.Random(1).choices("abcdetion", k=n))
    assert hashlib.sha256(word_bpe(PATH).piece(text.encode())[1]).hexdigest() == hashlib.sha256(" ".join(map(str, LIBRARY.encode(text, add_special_tokens=False).ids)).encode()).hexdigest()
