"""Token ids by a byte-level BPE tokenizer file.

The file's merges are applied by a second library that is several times faster on long
texts.  Texts with characters beyond Latin script, where libraries may follow different
Unicode versions, and texts that spell a special token go through the file's own library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import tiktoken
from tokenizers import Tokenizer

#: The rule that cuts texts before merging, as byte-level tokenizer files have it built in.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Any character whose class a library might see otherwise.
UNSURE = re.compile(r"[^\t\n\r -~¡-ɏ]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next unused one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self) -> Tokenizer:
        """The file's own library; large, so only loaded when a text needs it."""
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """All ids of a text, without special tokens around it."""
        if UNSURE.search(text) or self.special and self.special.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        return map(self.encode, texts)


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file and worker."""
    return ByteBpe(path)
