"""Byte-pair encoding and decoding with a vocabulary of word-end tokens.

A short word keeps the parts at its boundaries and the ranks of adjacent parts in two contiguous lists. The
least rank is found by scanning; the boundary between its parts is deleted and the ranks on both sides
are looked up again. Words of over ``SCANNED`` letters hold the same parts in linked lists under a heap, so
that an unbroken text of megabytes stays near linear; the merges are the same.

Words never span white space, so a worker encodes each distinct run between white space once
and looks later ones up. Runs with letters beyond the Latin blocks are normalized and split by the library, whose
character tables may be older than Python's.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from wavequery.llm import words
from wavequery.llm.byte_tokens import byte_letters

VOCABULARY = "word_bpe_49k.json"
SCANNED = 256
REMEMBERED = 150_000  # runs, and words, that a worker keeps the ids of; only speed depends on it

_NEVER = 1 << 60
_BEYOND_LATIN = regex.compile("[^\\u0000-\\u024f]")


class WordBpe:
    """One vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        # Pairs of ids by rank, under one number; merged[rank] is the id of the joined part.
        self.ranks = {self._pair(*map(self.vocabulary.get, pair)): i for i, pair in enumerate(model["merges"])}
        self.merged = [self.vocabulary[a + b] for a, b in model["merges"]]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.names = {i: t for t, i in (self.vocabulary | self.special).items()}
        split = next(p for p in stored["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.marks = [t.encode() for t in self.special]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = {b: letter for letter, b in byte_letters().items()}
        self.inner = [self.vocabulary[letters[b]] for b in range(256)]
        self.last = [self.vocabulary[letters[b] + self.end] for b in range(256)]
        self.library = Tokenizer.from_file(path)
        self.known = _Known(self.run)
        self.words = _Known(self.word)

    @staticmethod
    def _pair(a: int, b: int) -> int:
        return a << 32 | b

    def word(self, word: str) -> list[int]:
        """Ids of one word in normal form."""
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return self.scanned(parts) if len(parts) <= SCANNED else self.heaped(parts)

    def scanned(self, parts: list[int]) -> list[int]:
        """Merge by scanning the contiguous ranks."""
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, _NEVER) for a, b in itertools.pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            part = parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | part, _NEVER)
            if i < len(ranks):
                ranks[i] = get(part << 32 | parts[i + 1], _NEVER)
        return parts

    def heaped(self, parts: list[int]) -> list[int]:
        """The same merges with linked parts under a heap."""
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        rank = [self.ranks.get(self._pair(*pair), _NEVER) for pair in itertools.pairwise(parts)] + [_NEVER]
        heap = [(r, i) for i, r in enumerate(rank) if r != _NEVER]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            if rank[i] != least:  # its parts have changed
                continue
            j = after[i]
            parts[i], rank[j], after[i] = self.merged[least], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0:
                    rank[a] = _NEVER if b < 0 else self.ranks.get(self._pair(parts[a], parts[b]), _NEVER)
                    if rank[a] != _NEVER:
                        heapq.heappush(heap, (rank[a], a))
        return [p for p, r in zip(parts, rank, strict=True) if r != -1]

    def run(self, data: bytes) -> Sequence[int]:
        """Ids of a run between white space."""
        if data.isalpha():  # ASCII letters only
            return self.words[data.lower().decode()]
        ids: list[int] = []
        for part in self.cut.split(data.decode()) if any(m in data for m in self.marks) else [data.decode()]:
            if part in self.special:
                ids.append(self.special[part])
            elif _BEYOND_LATIN.search(part):
                plain = self.library.normalizer.normalize_str(part)
                for _, (begin, stop) in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    ids += self.words[plain[begin:stop]]
            else:
                for word in self.pattern.findall(unicodedata.normalize("NFC", part).lower()):
                    ids += self.words[word]
        return ids

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a whole text."""
        return np.fromiter(itertools.chain.from_iterable(map(self.known.__getitem__, data.split())), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by spaces: the vocabulary has no decoder of its own."""
        return " ".join(map(self.names.__getitem__, ids))


class _Known(dict):
    """Ids by run or word, filled on demand; what was not used while it filled up is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        ids = self.old.get(key)
        if ids is None:
            ids = tuple(self.make(key))
            if len(key) > 64:
                return ids
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


@functools.cache
def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, once per worker."""
    return WordBpe(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(data) for data in words.texts(batch)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "ids": pa.array(ids, pa.list_(pa.int32())),
                    "decoded": [bpe.decode(i.tolist()) for i in ids],
                }
            )

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (the ids turned back into text) of every whole text.

    Null text counts as empty: no ids, empty text. A null ``doc_id`` stays null; repeated rows are encoded each. Other
    columns are ignored.
    """
    schema = "doc_id bigint, ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(_encode(path or public_tokenizers.path(VOCABULARY)), schema)
