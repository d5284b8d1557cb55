"""Removal of passages that repeat across a corpus, by Rabin-Karp windows.

Every window of ``width`` consecutive words gets a rolling hash, and Spark gathers
equal hashes. A window whose words also start earlier is repeated; the
repeated windows of a document merge into maximal removal intervals.

The work is three shuffles:

1. A task hashes its documents in blocks. Inside a block only the first window of each hash
   goes on, so a passage in a third of all rows arrives once per block. Windows
   travel in packets, one per block and hash range, at about ten bytes a window.
2. Per hash range the windows of all blocks are compared; those with an earlier equal leave marks.
3. Marks meet the texts of their documents, in groups by a hash of ``doc_id``.

A text travels once. Equality is by 64-bit hash: a window is wrongly
marked with a chance of the number of windows over 2**64.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavequery.llm import words

WIDTH = 20
BLOCK_WORDS = 2_000_000  # words hashed together by one task
RANGE_WINDOWS = 4_000_000  # windows compared together, on average
GROUP_CHARS = 4_000_000  # characters of the texts in a group, on average
FEWEST = 256  # hash ranges and groups at least, so that small inputs spread too

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _packed(values: np.ndarray, kind: type) -> bytes:
    """A compressed array; equal bytes of the values lie together."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return zstandard.ZstdCompressor(level=1).compress(planes.T.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packet(doc: np.ndarray, start: np.ndarray) -> dict[str, bytes]:
    """Places sorted by document and start, as differences."""
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    at = np.flatnonzero(new)
    step = np.diff(start, prepend=0)
    step[new] = start[new]
    return {
        "docs": _packed(np.diff(doc[at], prepend=0), np.int64),
        "counts": _packed(np.diff(at, append=len(doc)), np.uint32),
        "starts": _packed(step, np.uint32),
    }


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    counts = _unpacked(row["counts"], np.uint32).astype(np.int64)
    doc = np.repeat(np.cumsum(_unpacked(row["docs"], np.int64)), counts)
    total = np.cumsum(_unpacked(row["starts"], np.uint32).astype(np.int64))
    first = np.cumsum(counts) - counts
    before = np.where(first > 0, total[first - 1], 0)
    return doc, total - np.repeat(before, counts)


_PACKET = pa.schema(
    [
        ("hash_range", pa.int32()),
        ("doc_group", pa.int32()),
        ("hashes", pa.binary()),
        ("docs", pa.binary()),
        ("counts", pa.binary()),
        ("starts", pa.binary()),
    ]
)
_PACKET_SQL = "hash_range int, doc_group int, hashes binary, docs binary, counts binary, starts binary"
_MARK = pa.schema([f for f in _PACKET if f.name not in ("hash_range", "hashes")])
_MARK_SQL = "doc_group int, docs binary, counts binary, starts binary"


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (words.mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _by_group(doc: np.ndarray, start: np.ndarray, groups: int) -> Iterator[dict]:
    """Marks as one packet for each group of documents."""
    group = _group_of(doc, groups)
    order = np.lexsort((start, doc, group))
    doc, start, group = doc[order], start[order], group[order]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else []
    for a, b in itertools.pairwise(edges):
        yield {"doc_group": int(group[a])} | _packet(doc[a:b], start[a:b])


def _repeats(hashes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each place is the first of its hash, and whether it lies after the first."""
    order = np.argsort(hashes, kind="stable")
    near = hashes[order]
    opens = np.concatenate([[True], near[1:] != near[:-1]]) if len(near) else np.empty(0, bool)
    run = np.cumsum(opens) - 1
    sizes = np.bincount(run)
    several = np.flatnonzero(sizes[run] > 1)
    picked = order[several]
    ranked = picked[np.lexsort((start[picked], doc[picked], run[several]))]
    order[several] = ranked
    lead = order[np.flatnonzero(opens)][run]
    first = np.zeros(len(hashes), bool)
    first[order[opens]] = True
    later = np.zeros(len(hashes), bool)
    later[order] = (doc[order] != doc[lead]) | (start[order] != start[lead])
    return first, later


def _hash_blocks(width: int, bits: int, groups: int):
    keep = 8 - bits // 8  # the range gives the leading bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), found in words.blocks(batches, ["doc_id"], "text", BLOCK_WORDS):
            ids = np.array(ids, np.int64)
            order = np.argsort(ids, kind="stable")
            sequence, row, place = words.joined([found[i] for i in order])
            hashes = words.rolling(sequence, width)
            whole = row[: len(hashes)] == row[width - 1 :][: len(hashes)]
            hashes, doc, start = hashes[whole], ids[order][row[: len(whole)][whole]], place[: len(whole)][whole]
            if not len(hashes):
                continue
            first, later = _repeats(hashes, doc, start)
            out = [r | {"hash_range": int(i)} for i, r in enumerate(_by_group(doc[later], start[later], groups))]
            hashes, doc, start = hashes[first], doc[first], start[first]
            at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order], prepend=-1, append=-1))
            raw = hashes.view(np.uint8).reshape(-1, 8)[:, :keep]
            for a, b in itertools.pairwise(edges):
                rows = order[a:b]
                packet = _packet(doc[rows], start[rows])
                out.append({"hash_range": int(at[rows[0]]), "hashes": raw[rows].tobytes()} | packet)
            yield pa.RecordBatch.from_pylist(out, schema=_PACKET)

    return run


def _compare(bits: int, groups: int):
    keep = 8 - bits // 8

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out, hashes, docs, starts = [], [], [], []
        for row in table.to_pylist():
            if row["hashes"] is None:
                out.append({k: row[k] for k in _MARK.names})
                continue
            raw = np.frombuffer(row["hashes"], np.uint8).reshape(-1, keep)
            doc, start = _places(row)
            hashes.append(np.pad(raw, ((0, 0), (0, 8 - keep))).view(np.uint64).ravel())
            docs.append(doc)
            starts.append(start)
        if hashes:
            doc, start = np.concatenate(docs), np.concatenate(starts)
            _, later = _repeats(np.concatenate(hashes), doc, start)
            out += _by_group(doc[later], start[later], groups)
        return pa.Table.from_pylist(out, schema=_MARK)

    return run


def _compress(groups: int):
    """Texts as compressed bytes, so that their shuffle is smaller, and the group of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data = [None if t is None else squeeze(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            keys = np.array([i if d is None else d for i, d in enumerate(ids)], np.int64)
            batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(data, pa.binary()))
            yield batch.append_column("doc_group", pa.array(_group_of(keys, groups), pa.int32()))

    return run


_SPAN = T.StructType().add("begin", T.IntegerType()).add("end", T.IntegerType())
_FOUND = T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("removed", T.ArrayType(_SPAN))


def _cut(data: bytes, gone: np.ndarray) -> bytes:
    """The text without the words in ``gone`` and the white space before each of them."""
    ends = [m.end() for m in _WORD.finditer(data)]
    begins = [0, *ends]
    kept = [data[begins[i] : ends[i]] for i in np.flatnonzero(~gone)]
    return b"".join(kept).lstrip(words.WHITE) if gone[0] else b"".join(kept) + data[ends[-1] :]


def _remove(width: int, schema: pa.Schema):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, marks: pa.Table) -> pa.Table:
        found = [_places(row) for row in marks.to_pylist()]
        doc = np.concatenate([np.empty(0, np.int64), *[d for d, _ in found]])
        start = np.concatenate([np.empty(0, np.int64), *[s for _, s in found]])
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        expand = zstandard.ZstdDecompressor().decompress
        texts, n_words, n_removed, spans = [], [], [], []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
            data = b"" if text is None else expand(text)
            count, gone, intervals = len(data.split()), None, []
            if doc_id is not None:
                a, b = np.searchsorted(doc, doc_id), np.searchsorted(doc, doc_id, "right")
                at = start[a:b][start[a:b] + width <= count]
                if len(at):
                    steps = np.bincount(at, minlength=count + 1) - np.bincount(at + width, minlength=count + 1)
                    gone = np.cumsum(steps)[:count] > 0
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    intervals = edges.reshape(-1, 2).tolist()
                    data = _cut(data, gone)
            texts.append(None if text is None else data.decode())
            n_words.append(count)
            n_removed.append(0 if gone is None else int(gone.sum()))
            spans.append([{"begin": x, "end": y} for x, y in intervals])
        made = {"text": texts, "n_words": n_words, "n_removed": n_removed, "removed": spans}
        columns = [pa.array(made[f.name], f.type) if f.name in made else docs.column(f.name).cast(f.type) for f in schema]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut every word that a window of ``width`` words covers whose words also start earlier.

    Earlier is a smaller ``doc_id``, or a smaller start in the same document. Returns ``doc_id``,
    ``text`` (what is left, in its own spacing), ``n_words``, ``n_removed``, ``removed`` (intervals of word
    numbers) and the columns in ``keep``. Windows are judged on the input.

    Null text: no words, stays null. Null ``doc_id``: the row is no source of repeats and stays whole. Repeated rows
    of one ``doc_id`` take the same place in the order, so neither is earlier; marks of any of them hold for all. Texts
    under ``width`` words stay whole. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(int(math.log2(FEWEST)), math.ceil(math.log2(max(1, chars / 6 / RANGE_WINDOWS))))
    groups = max(FEWEST, chars // GROUP_CHARS)
    named = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    packets = named.mapInArrow(_hash_blocks(width, bits, groups), _PACKET_SQL)
    marks = packets.groupBy("hash_range").applyInArrow(_compare(bits, groups), _MARK_SQL)

    carried = docs.select("doc_id", "text", *keep)
    fields = [T.StructField(f.name, f.dataType) for f in carried.schema]
    binary = [T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in fields]
    grouped = carried.mapInArrow(_compress(groups), T.StructType([*binary, T.StructField("doc_group", T.IntegerType())]))
    result = T.StructType([*fields, *_FOUND])
    remove = _remove(width, to_arrow_schema(result))
    return grouped.groupBy("doc_group").cogroup(marks.groupBy("doc_group")).applyInArrow(remove, result)
