"""Repetition rules on whole texts, from a suffix array over words.

Prefix doubling sorts the suffixes of all documents of a block at once: the document
number is part of every first rank, so suffixes of different documents never
meet. Only suffixes that are still tied are sorted again. Neighbours in
the array share their longest common prefix; the intervals of equal prefixes are
the maximal repeated substrings. Their spans are united; a document passes if
the covered share and the longest repeat stay below their limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.llm import words

SHORTEST = 10  # words of a repeat that counts
COVERED_PERCENT = 25  # of the words, in repeats that count; they are repeats of three words too, of which 50 % pass
LONGEST_REPEAT = 100  # words
BLOCK_WORDS = 500_000

_SYMBOLS = b"#*$%&|<>"
_MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_covered_words longest_repeat".split()


def suffix_array(sequence: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, each suffix ending with its row."""
    n = len(sequence)
    order = np.lexsort((sequence, row))
    if n < 2:
        return order
    fresh = np.concatenate([[True], (sequence[order][1:] != sequence[order][:-1]) | (row[order][1:] != row[order][:-1])])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    last = np.searchsorted(row, row, "right")  # end of the row
    step = 1
    # slots: the places of the array whose suffix is tied with another one
    tied = ~fresh | ~np.concatenate([fresh[1:], [True]])
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        ahead = at + step
        second = np.where(ahead < last[at], rank[np.minimum(ahead, n)], -1)
        group = rank[at]
        by = np.lexsort((second, group))
        at, second, group = at[by], second[by], group[by]
        order[slots] = at
        opens = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[at] = slots[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
        slots = slots[~opens | ~np.concatenate([opens[1:], [True]])]
        step *= 2
    return order


def common_prefixes(sequence: np.ndarray, row: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in ``order`` with the one before it, in words.

    Kasai's bound, applied level by level: prefixes are compared in strides of powers of two by
    hash, from long to short.
    """
    n = len(sequence)
    common = np.zeros(n, np.int64)
    if n < 2:
        return common
    last = np.searchsorted(row, row, "right")
    left, right = order[:-1], order[1:]
    live = np.flatnonzero((row[left] == row[right]) & (sequence[left] == sequence[right]))
    a, b = left[live].copy(), right[live].copy()
    limit = np.minimum(last[a] - a, last[b] - b)
    levels, stride, going = [], 1, np.arange(len(live))
    while len(going):  # the longest stride that any pair shares
        going = going[limit[going] >= stride]
        if not len(going):
            break
        hashes = sequence if stride == 1 else words.rolling(sequence, stride)
        going = going[hashes[a[going]] == hashes[b[going]]]
        levels.append(stride)
        stride *= 2
    total = np.zeros(len(live), np.int64)
    for stride in reversed(levels):
        hashes = sequence if stride == 1 else words.rolling(sequence, stride)
        fits = np.flatnonzero(limit - total >= stride)
        x, y = a[fits] + total[fits], b[fits] + total[fits]
        total[fits[hashes[x] == hashes[y]]] += stride
    common[live + 1] = total
    return common


def repeats(sequence: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that repeats in its row."""
    order = suffix_array(sequence, row)
    common = common_prefixes(sequence, row, order)
    best = np.empty(len(sequence), np.int64)
    best[order] = np.maximum(common, np.concatenate([common[1:], [0]])) if len(order) else common
    return best


def _united(lengths: np.ndarray) -> np.ndarray:
    """Which positions the spans ``[i, i + lengths[i])`` cover."""
    steps = np.zeros(len(lengths) + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + lengths[at], -1)
    return np.cumsum(steps)[:-1] > 0


def _sums(flags: np.ndarray, row: np.ndarray, rows: int) -> list[int]:
    return np.bincount(row[flags], minlength=rows).tolist()


def _duplicate_lines(data: bytes) -> int:
    lines = [line for line in data.split(b"\n") if line.strip(words.WHITE)]
    return len(lines) - len(set(lines))


def _measure(shortest: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = words.texts(batch)
            at = 0
            while at < len(held):  # bounded blocks, at least one text each
                until, size = at, 0
                while until < len(held) and (until == at or size + len(held[until]) <= 6 * BLOCK_WORDS):
                    size += len(held[until])
                    until += 1
                data = held[at:until]
                sequence, row, _ = words.joined([words.codes(d) for d in data])
                best = repeats(sequence, row)
                longest = np.zeros(len(data), np.int64)
                np.maximum.at(longest, row, best)
                found = {
                    "n_words": np.bincount(row, minlength=len(data)).tolist(),
                    "word_chars": [len(d.translate(None, words.WHITE).decode()) for d in data],
                    "n_symbols": [len(d) - len(d.translate(None, _SYMBOLS)) for d in data],
                    "n_dup_lines": list(map(_duplicate_lines, data)),
                    "n_repeat_words": _sums(_united(np.where(best >= 3, 3, 0)), row, len(data)),
                    "n_covered_words": _sums(_united(np.where(best >= shortest, best, 0)), row, len(data)),
                    "longest_repeat": longest.tolist(),
                }
                columns = [batch.column(c).slice(at, until - at) for c in carried]
                columns += [pa.array(found[c], pa.int64()) for c in _MEASURES]
                yield pa.RecordBatch.from_arrays(columns, [*carried, *_MEASURES])
                at = until

    return run


def measure(docs: DataFrame, shortest: int = SHORTEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of words, characters, symbols, equal lines and repeats of every text, with ``doc_id`` and ``keep``.

    Null text counts as empty: all counts are 0. A null ``doc_id`` stays null; repeated rows are measured each. Texts of
    any length are measured whole, in memory linear in the longest text. Other columns are ignored.
    """
    needed = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    carried = [f for f in needed.schema if f.name == "doc_id" or f.name in keep]
    schema = T.StructType([*carried, *[T.StructField(m, T.LongType()) for m in _MEASURES]])
    return needed.mapInArrow(_measure(shortest, [f.name for f in carried]), schema)


def judged(
    measured: DataFrame, covered_percent: int = COVERED_PERCENT, longest_repeat: int = LONGEST_REPEAT
) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the counts."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeated = (100 * F.col("n_covered_words") > covered_percent * F.col("n_words")) | (
        F.col("longest_repeat") > longest_repeat
    )
    return measured.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~repeated)
