import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import config_lp
from pathloom.llm.packing import pack_documents, place_pieces
from pathloom.llm.tokens import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab É1'st.\n\t   　\x1ć語<|endoftext|>", max_size=60))
def test_ids_equal_the_library(text):
    got = np.frombuffer(byte_bpe(PATH).encode(text), dtype="<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """Exact bin count by search, for a handful of items."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in {b: k for k, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1 :])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(8))
def test_plan_near_the_fewest(seed):
    rng = random.Random(seed)
    capacity = 20
    lengths = [rng.randint(1, 20) for _ in range(11)]
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = config_lp.plan(counts, capacity)
    used = np.zeros(capacity + 1, dtype=int)
    for config, times in plan:
        assert sum(k * n for k, n in config.items()) <= capacity
        for k, n in config.items():
            used[k] += n * times
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= fewest(lengths, capacity) + 1


def test_plan_at_scale_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(200, 600, 100_000), minlength=1025)
    bins = sum(t for _, t in config_lp.plan(counts, 1024))
    assert bins <= 1.02 * (counts * np.arange(1025)).sum() / 1024


def best_fit_bins(lengths, capacity):
    """Best-fit decreasing, one item after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("low, high", [(200, 1024), (340, 600), (1, 1024), (20, 300)])
def test_plan_against_best_fit(low, high):
    """Every item is placed once; bins are close to best-fit decreasing's, and most come from the program."""
    lengths = np.random.default_rng(low).integers(low, high + 1, 6000)
    counts = np.bincount(lengths, minlength=1025)
    plan = config_lp.plan(counts, 1024)
    used = np.zeros(1025, dtype=int)
    for config, times in plan:
        assert sum(k * n for k, n in config.items()) <= 1024 and times > 0
        for k, n in config.items():
            used[k] += n * times
    assert (used == counts).all()
    plain = best_fit_bins(lengths.tolist(), 1024)
    assert sum(t for _, t in config_lp.best_fit(counts, 1024)) == plain
    assert sum(t for _, t in plan) <= 1.01 * plain + 1
    taken, left = config_lp.rounded(counts, 1024, config_lp.dual_prices(counts, 1024)[0], 1.0, 0.01, 0.05)
    assert left @ np.arange(1025) <= 0.06 * lengths.sum()


def test_dual_prices_bound_the_program():
    counts = np.bincount([600] * 10 + [400] * 10 + [300] * 5, minlength=1025)
    prices, bins = config_lp.dual_prices(counts, 1024)
    assert 8 < bins <= 12 and config_lp.price(prices, 1024)[0][1024] <= 1 + 1e-9


def test_documents(spark):
    rng = random.Random(3)
    texts = [None, "", "a <|endoftext|> b"] + [" ".join(rng.choice(["alpha", "Beta,", "été", "\n", "x  y"]) for _ in range(rng.choice([1, 20, 300, 3000]))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(4)
    rows = pack_documents(df, PATH, capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        ids = LIBRARY.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, dtype="<u4").tobytes()
        assert [r.length for r in own[1:]] == [256] * (len(own) - 1) and len(own) == -(-len(ids) // 256)
        assert all(zlib.crc32(bytes(r.ids)) >= 0 and len(r.ids) == 4 * r.length for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 256
    assert len(by_sequence) <= 1 + 1.02 * sum(r.length for r in rows) / 256
    assert pack_documents(df.limit(0), PATH).count() == 0
    again = place_pieces(df.selectExpr("doc_id AS k", "1 + doc_id % 9 AS length", "'x' AS _task", "0 AS _nth", "1 AS sequence_id"), 16).collect()
    assert sorted(r.k for r in again) == list(range(len(texts))) and {r._task for r in again} == {"x"} and len({(r.sequence_id, r.offset) for r in again}) == len(again)
