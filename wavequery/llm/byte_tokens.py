"""Token ids of whole texts in a public byte-level vocabulary, for Arrow tasks.

The vocabulary file is read once per worker. Its merges run in tiktoken, several times as
fast as in tokenizers; the ids are the same for every code point.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
END = "<|endoftext|>"

# tiktoken's pattern engine gives up on longer runs of white space.
_LONG_GAP = re.compile(r"\s{10000}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _encoders(path: str) -> tuple[tiktoken.Encoding, Tokenizer]:
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in stored["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in stored["added_tokens"]}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return fast, Tokenizer.from_file(path)


def end_id(path: str) -> int:
    """The id that ends a document."""
    return _encoders(path)[1].token_to_id(END)


def encode(text: str, path: str, special: bool = True) -> np.ndarray:
    """Ids of a text. With ``special``, strings of special tokens in it become their ids."""
    fast, full = _encoders(path)
    if _LONG_GAP.search(text):
        full.encode_special_tokens = not special
        return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode(text, allowed_special="all") if special else fast.encode_ordinary(text), np.uint32)
