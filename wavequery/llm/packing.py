"""Packing of documents into fixed windows by the sum-of-squares rule.

A window is full or open; ``level[h]`` counts the open windows filled up to ``h``. The tail of a
document goes on the level where the sum of squared counts becomes least, so levels
that complement each other stay in balance. Whole windows of a long document are full at once. Once ``MOST_OPEN`` windows are
open, a tail may also be cut to fill one, chosen by the same rule.

Each task packs the documents of its partition as one stream, without a shuffle. At its end the open
windows are poured together: they are cut again at the window size, and the rest at powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wavequery.llm import byte_tokens

WINDOW = 1024
END_ID = 0  # closes each document
MOST_OPEN = 16  # windows that a stream holds open before it cuts documents to fill one
PIECES = 20_000  # rows of one result batch

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)

NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


class Packer:
    """Open windows of one stream. A piece is ``(document, start, ids)``."""

    def __init__(self, window: int = WINDOW, most_open: int | None = None):
        self.window, self.most_open = window, most_open
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.level = np.zeros(window + 1, np.int64)
        self.count = 0

    def _lost(self, below: np.ndarray) -> np.ndarray:
        """Change of the sum of squares where a window leaves its level; a new window leaves none."""
        return np.where(below > 0, 1 - 2 * self.level[below], 0)

    def _won(self, above: np.ndarray) -> np.ndarray:
        """Change where a window comes to a level; neither a full nor an empty window counts."""
        return np.where((above > 0) & (above < self.window), 1 + 2 * self.level[above], 0)

    def place(self, piece: tuple) -> list[list[tuple]]:
        """Add a piece shorter than a window; the windows that it fills.

        With ``most_open`` windows open, if that is given, a piece may also be cut where it overshoots a window: that is then full, and
        the rest is placed as a piece of its own.
        """
        size = len(piece[2])
        below = 1 + np.flatnonzero(self.level[1 : self.window])
        if self.most_open is None or self.count < self.most_open:
            below = np.concatenate([[0], below[below + size <= self.window]])
        over = below + size > self.window
        change = self._lost(below) + self._won(below + size - over * self.window)
        # The least change; whole before cut, then the fullest.
        best = int(below[np.lexsort((-below, over, change))[0]])
        held = self.open[best].pop() if best else []
        self.level[best] -= best > 0
        self.count -= best > 0
        take = min(size, self.window - best)
        doc, start, ids = piece
        held.append((doc, start, ids[:take]))
        if best + take < self.window:
            self.open[best + take].append(held)
            self.level[best + take] += 1
            self.count += 1
            return []
        return [held] if take == size else [held, *self.place((doc, start + take, ids[take:]))]

    def pour(self) -> Iterator[list[tuple]]:
        """Windows of what is still open: full ones, then lengths of powers of two."""
        pieces = [p for held in reversed(self.open) for window in held for p in window]
        left = sum(len(p[2]) for p in pieces)
        room, out = min(self.window, 1 << (left.bit_length() - 1)) if left else 0, []
        for doc, start, ids in pieces:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                out.append((doc, start, part))
                start, left, room = start + len(part), left - len(part), room - len(part)
                if not room:
                    yield out
                    room, out = min(self.window, 1 << (left.bit_length() - 1)) if left else 0, []


def _pack(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = Packer(window, MOST_OPEN), TaskContext.get().partitionId() << 40
        columns: list[list[int]] = [[] for _ in range(7)]

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc_id, tokens), start, ids in pieces:
                values = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
                offset += len(ids)
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)
            for column in columns:
                column.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(byte_tokens.encode(text or "", path), np.uint32(END_ID)).astype("<u4")
                doc, whole = (doc_id, len(ids)), len(ids) // window * window
                for start in range(0, whole, window):
                    emit([(doc, start, ids[start : start + window])])
                if whole < len(ids):
                    for full in packer.place((doc, whole, ids[whole:].copy())):
                        emit(full)
                if len(columns[0]) >= PIECES:
                    yield batch_of()
        for pieces in packer.pour():
            emit(pieces)
        yield batch_of()

    return run


def packed(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document: its place in the document and in a window.

    A document is its token ids and ``END_ID``. Null and empty texts are that id alone. A null ``doc_id`` stays null;
    repeated rows are packed each. Texts of any length are cut into windows. An empty table gives no rows. Other columns
    are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_pack(path, window), SCHEMA)
