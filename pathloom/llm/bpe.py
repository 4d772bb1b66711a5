"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

A leaf holds the merge rank of one adjacent pair, an inner node the smaller of its
children with the left one first, so the root is the leftmost pair of lowest rank.  A
merge changes three leaves, each in logarithmically many steps, until the root says
that no pair can merge.

Text is cut at white space first (no token spans it), and each different piece is
encoded once per worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from pathloom.llm.blocks import lean, put_columns, slices, with_columns
from pathloom.llm.hashing import text_buffer
from pathloom.llm.tokens import byte_alphabet

#: Pieces remembered by a worker before the older half is forgotten; bounds memory, not results.
REMEMBERED = 500_000
NONE = 1 << 62
#: Below this, printable characters are in normal form C and one case rule holds for all libraries.
PLAIN = "\u0250"
#: The rule that cuts words, as the tokenizer file states it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

Made = tuple[int, bytes, bytes]


class Remembered(dict):
    """Results of ``make`` by key; of two generations the older is forgotten when the newer is full."""

    def __init__(self, make: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class RankTree:
    """Minimum segment tree over ``rank << 32 | position``."""

    __slots__ = ("leaves", "nodes")

    def __init__(self, ranks: list[int | None]):
        self.leaves = 1 << max(0, len(ranks) - 1).bit_length()
        self.nodes = [NONE] * (2 * self.leaves)
        for i, r in enumerate(ranks):
            if r is not None:
                self.nodes[self.leaves + i] = r << 32 | i
        for i in range(self.leaves - 1, 0, -1):
            a, b = self.nodes[2 * i], self.nodes[2 * i + 1]
            self.nodes[i] = a if a < b else b

    def root(self) -> int:
        return self.nodes[1]

    def put(self, at: int, rank: int | None) -> None:
        nodes, i = self.nodes, self.leaves + at
        nodes[i] = NONE if rank is None else rank << 32 | at
        while i > 1:
            a, b = nodes[i], nodes[i ^ 1]
            low = a if a < b else b
            i >>= 1
            if nodes[i] == low:
                break
            nodes[i] = low


class WordBpe:
    """Encoder and decoder for a tokenizer file: BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t.encode() for t, i in (self.vocab | self.special).items()}
        self.decimal = {i: str(i).encode() for i in self.token}
        self.alphabet = byte_alphabet()
        self.pattern = regex.compile(WORDS)
        if WORDS not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            raise ValueError(f"{path} cuts words by another rule")
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Remembered(self.lowered)
        self.pieces = Remembered(self.piece)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges to the ids of one word's symbols."""
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, (None, 0)
        rank = lambda a, b: merges.get((a, b), none)[0]
        tree = RankTree([merges.get(p, none)[0] for p in zip(ids, ids[1:])])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree.root()) != NONE:
            at = low & 0xFFFFFFFF
            gone = after[at]
            ids[at] = merges[ids[at], ids[gone]][1]
            ids[gone] = -1
            nxt = after[at] = after[gone]
            if gone < n - 1:  # the pair that began at the part merged away
                tree.put(gone, None)
            if nxt < n:
                before[nxt] = at
                tree.put(at, rank(ids[at], ids[nxt]))
            else:
                tree.put(at, None)
            if before[at] >= 0:
                tree.put(before[at], rank(ids[before[at]], ids[at]))
        return [x for x in ids if x >= 0]

    def word(self, symbols: str) -> Made:
        """Number, decimal ids and tokens of one word in the byte alphabet of the vocabulary."""
        parts = list(symbols)
        parts[-1] += self.suffix
        return self.made(self.merge([self.vocab[p] for p in parts if p in self.vocab]))

    def made(self, ids: list[int]) -> Made:
        return len(ids), b" ".join([self.decimal[i] for i in ids]), b" ".join([self.token[i] for i in ids])

    def piece(self, raw: bytes) -> Made:
        """The same of a text without white space inside, special tokens' strings included as such."""
        text = raw.decode()
        low = text.lower()
        if low.isalpha() and max(low) < PLAIN and max(text) < PLAIN:  # one word, which normalizing only lowers
            return self.words[low]
        found: list[Made] = []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                found.append(self.made([self.special[part]]))
            elif part and part.isprintable() and max(part) < PLAIN and max(low := part.lower()) < PLAIN:
                found += map(self.words.__getitem__, self.pattern.findall(low))
            elif part:
                plain = self.library.normalizer.normalize_str(part)
                found += [self.word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        found = [x for x in found if x[0]]
        return found[0] if len(found) == 1 else (sum(x[0] for x in found), b" ".join([x[1] for x in found]), b" ".join([x[2] for x in found]))

    def lowered(self, word: str) -> Made:
        """A word that is normalized but not yet in the byte alphabet."""
        return self.word(word if word.isascii() else "".join([self.alphabet[b] for b in word.encode()]))


@cache
def word_bpe(path: str) -> WordBpe:
    """One encoder for each file and worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``ids`` (decimal, joined by a space) and ``decoded``.

    The tokenizer file must drop white space, as BPE with an end-of-word suffix does;
    its special tokens' strings in a text count as those tokens, and nothing is cut or
    padded.  Null and empty texts have no tokens.  Rows are independent: repeated rows get
    equal results, an empty table gives an empty table, and input columns named like a
    result are replaced.
    """
    schema = with_columns(docs.schema, ", ".join(["n_tokens long", *(f"{o} string" for o in outputs)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = word_bpe(tokenizer_path).pieces.__getitem__
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            raw, offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
            blob = raw.tobytes()
            counts, made = [], {"ids": [], "decoded": []}
            for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                found = [x for x in map(get, blob[a:z].split()) if x[0]]
                n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
                counts.append(sum(n))
                made["ids"].append(b" ".join(ids))
                made["decoded"].append(b" ".join(decoded))
            yield put_columns(batch, schema, {"n_tokens": pa.array(counts, pa.int64())} | {o: pa.array(made[o], pa.binary()).cast(pa.string()) for o in outputs})

    return docs.mapInArrow(lean(run), schema)
