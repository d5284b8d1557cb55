"""Words of whole texts as arrays of 64-bit codes, for Arrow tasks.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``. ``bytes.split`` cuts
at exactly those bytes, and none of them occurs inside a UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WHITE = b" \t\n\x0b\x0c\r"
REMEMBERED = 300_000  # words a worker keeps codes of; only speed depends on it

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Codes(dict):
    """Code by word, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def codes(data: bytes) -> np.ndarray:
    """The code of each word, in order."""
    words = data.split()
    return np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (one-to-one)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


def rolling(sequence: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every ``width`` consecutive codes."""
    n = len(sequence) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        falling = np.full(len(sequence), _INVERSE, np.uint64)
        falling[0] = 1
        prefix = np.zeros(len(sequence) + 1, np.uint64)
        np.cumsum(sequence * np.cumprod(falling), out=prefix[1:])
        rising = np.full(n, _BASE, np.uint64)
        rising[0] = pow(_BASE, width - 1, 1 << 64)
        return mixed((prefix[width:] - prefix[:n]) * np.cumprod(rising))


def blocks(
    batches: Iterator[pa.RecordBatch], columns: list[str], text: str, size: int
) -> Iterator[tuple[list[list], list[np.ndarray]]]:
    """Gather rows until they hold ``size`` words: their other columns, and the codes of each text."""
    rows: list[list] = [[] for _ in columns]
    found: list[np.ndarray] = []
    words = 0
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        for i, data in enumerate(texts(batch, text)):
            sequence = codes(data)
            for held, column in zip(rows, values, strict=True):
                held.append(column[i])
            found.append(sequence)
            words += len(sequence)
            if words >= size:
                yield rows, found
                rows, found, words = [[] for _ in columns], [], 0
    if found:
        yield rows, found


def joined(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes in one array, with the row number and the place in its row of each."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    row = np.repeat(np.arange(len(sequences)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.concatenate([np.empty(0, np.uint64), *sequences]), row, np.arange(len(row)) - first[row]
