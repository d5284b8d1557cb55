"""Near-duplicate documents by HyperMinHash sketches over word shingles.

A register holds the smallest hash of its share of a document's shingles as a leading-zero count and
mantissa bits, two bytes in all. Runs of registers form bands, and documents that agree on a
band are compared: first by the estimated Jaccard similarity, corrected for registers that
agree by chance, then by their full shingle sets.

Documents with equal sets form a class first and take part once. In a band, every class
is compared with the smallest one there. Classes that this leaves in different components are then
compared with each other, so a large group of near copies costs about one comparison each, yet no link
between components is lost.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.llm import stages, words

SHINGLE = 5
PERCENT = 85  # of the union that two linked sets share at least
BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
VALUE_BITS = 48
DEVIATIONS = 5  # standard errors below the limit at which an estimate still counts
TASK_ROWS = 2_000  # sketches that one task compares, on average
GROUP_ROWS = 512  # documents in each half of a block that is compared together


def shingles(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a shorter text is one shingle."""
    sequence = words.codes(data.lower())
    return np.unique(words.rolling(sequence, min(width, len(sequence)))) if len(sequence) else sequence


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set; 0 marks one without shingles."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    spread = words.mixed(hashes)
    value = spread & np.uint64((1 << VALUE_BITS) - 1)
    register = ((spread >> np.uint64(VALUE_BITS)) * np.uint64(REGISTERS)) >> np.uint64(64 - VALUE_BITS)
    np.minimum.at(least, register.astype(np.intp), value)
    filled = least != np.iinfo(np.uint64).max
    fraction, exponent = np.frexp(np.where(filled, least, 1).astype(np.float64))
    mantissa = np.clip((2 * fraction - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.uint16)
    zeros = (VALUE_BITS - exponent).astype(np.uint16)
    return np.where(filled, 1 + (zeros << np.uint16(MANTISSA_BITS)) + mantissa, 0).astype(np.uint16)


def chance_agreements(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected registers that agree for disjoint sets of ``n`` and ``m`` shingles.

    The smallest of ``n / REGISTERS`` uniform values has about an exponential density of that rate. Two agree if they
    fall into one cell; cells are ``2 ** -(zeros + MANTISSA_BITS + 1)`` wide.
    """
    x, y = np.maximum(n, 1) / REGISTERS, np.maximum(m, 1) / REGISTERS
    low = 2.0 ** -np.arange(1.0, VALUE_BITS + 1)
    shares = np.exp(-np.multiply.outer(x + y, low)) - np.exp(-np.multiply.outer(x + y, 2 * low))
    return REGISTERS * (shares @ low) / (1 << MANTISSA_BITS) * x * y / (x + y)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of sketches in the last axis, and the number of registers it rests on."""
    filled = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    agree = ((a == b) & (a > 0)).sum(-1)
    return np.clip((agree - chance_agreements(n, m)) / filled, 0, 1), filled


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate lies less than ``DEVIATIONS`` standard errors below the limit."""
    limit = percent / 100
    filled = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    least = limit - DEVIATIONS * np.sqrt(limit * (1 - limit) / filled)
    fits = ((a == b) & (a > 0)).sum(-1) >= least * filled
    at = np.flatnonzero(fits)  # the correction only lowers the estimate
    a, b, n, m = (np.broadcast_to(x, (*fits.shape, *y))[at] for x, y in ((a, a.shape[-1:]), (b, b.shape[-1:]), (n, ()), (m, ())))
    fits[at] = estimate(a, b, n, m)[0] >= least[at]
    return fits


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, prints, registers = [], [], []
        for data in words.texts(batch):
            hashes = shingles(data)
            counts.append(len(hashes))
            prints.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            registers.append(sketch(hashes).tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_shingles": pa.array(counts, pa.int64()),
                "print": pa.array(prints, pa.binary()),
                "sketch": pa.array(registers, pa.binary()),
            }
        )


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``print`` (of the shingle set) and ``sketch`` of every text."""
    schema = "doc_id bigint, n_shingles bigint, print binary, sketch binary"
    return docs.select("doc_id", "text").mapInArrow(_sketches, schema)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def densified(cells: np.ndarray) -> np.ndarray:
    """Registers with each empty one copied from a filled one, tried in an order of its own.

    Equal sets copy alike, so small sets agree on a band as rarely as large ones of that similarity.
    """
    cells, left = cells.copy(), np.flatnonzero((cells == 0).any(-1) & (cells > 0).any(-1))
    source = cells[left]
    for tried in _TRIED:
        empty = cells[left] == 0
        open_ = empty.any(-1)
        left, source, empty = left[open_], source[open_], empty[open_]
        if not len(left):
            break
        cells[left] = np.where(empty, source[:, tried], cells[left])
    return cells


# Row i has the i-th register that each empty register tries: a permutation per column.
_TRIED = np.argsort(words.mixed(np.arange(REGISTERS**2, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, -1), axis=0)


def band_keys(cells: np.ndarray) -> np.ndarray:
    """A key for each band of sketches."""
    rising = np.cumprod(np.full(ROWS, 0xD6E8FEB86659FD93, np.uint64))
    cells = densified(cells).reshape(-1, BANDS, ROWS)
    keys = words.mixed((cells * rising).sum(-1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return keys.view(np.int64)


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = band_keys(_registers(batch["sketch"]))
        yield pd.DataFrame({"band": keys.ravel(), "doc": np.repeat(batch["doc_id"].to_numpy(), BANDS)})


def _estimated(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = likely(
                _registers(batch["sketch_a"]),
                _registers(batch["sketch_b"]),
                batch["n_a"].to_numpy(),
                batch["n_b"].to_numpy(),
                percent,
            )
            yield batch.loc[fits, ["a", "b"]]

    return run


def _pairs_across(rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a band's part ``i``, each with the likely rows of part ``j`` in other components.

    ``rows`` may hold many blocks ``(band, i, j)``, sorted. A pair counts only in the first band that both
    documents share, so it is looked at once.
    """
    band, i, j, doc, part, component, sizes = (
        rows[c].to_numpy() for c in ("band", "i", "j", "doc", "part", "component", "n_shingles")
    )
    cells = _registers(rows["sketch"])
    keys = band_keys(cells)
    number = np.argmax(keys == band[:, None], axis=1)
    new = (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    for low, high in itertools.pairwise([0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]):
        if (component[low:high] == component[low]).all():
            continue
        right = low + np.flatnonzero(part[low:high] == j[low])
        other, names, many = component[right], doc[right], sizes[right]
        for x in low + np.flatnonzero(part[low:high] == i[low]):
            # Sets of very different sizes cannot be linked.
            open_ = (other != component[x]) & (100 * many >= percent * sizes[x]) & (100 * sizes[x] >= percent * many)
            if i[low] == j[low]:
                open_ &= names > doc[x]
            at = right[open_]
            if len(at):
                at = at[likely(cells[at], cells[x], sizes[at], sizes[x], percent)]
                at = at[~(keys[at, : number[x]] == keys[x, : number[x]]).any(-1)]
                if len(at):
                    yield x, at


_BLOCK = ["band", "i", "j"]


def _promising(percent: int):
    """The documents of each band's block that have a likely partner in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_BLOCK)
        at = {i for x, others in _pairs_across(rows, percent) for i in (x, *others.tolist())}
        return rows.iloc[sorted(at)][[*_BLOCK, "part", "component", "doc"]]

    return run


def _linked_across(percent: int):
    """Links between components, of texts in blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_BLOCK)
        expand, found = zstandard.ZstdDecompressor().decompress, []
        sets = [shingles(expand(text)) for text in rows["text"]]
        rows = rows.assign(n_shingles=[len(x) for x in sets], sketch=[sketch(x).tobytes() for x in sets])
        doc = rows["doc"].to_numpy()
        for x, others in _pairs_across(rows, percent):
            found += [(doc[x], doc[y]) for y in others if _similar(sets[x], sets[y], percent)]
        return pd.DataFrame([(min(p), max(p)) for p in found], columns=["a", "b"], dtype=np.int64)

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data = pa.array(map(squeeze, words.texts(batch)), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], ["doc_id", "text"])


def _verified(percent: int):
    """The pairs of a block whose full sets are similar enough."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, pairs: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        sets: dict[int, list[np.ndarray]] = {}
        for doc, text in zip(texts.column("doc_id").to_pylist(), texts.column("text"), strict=True):
            sets.setdefault(doc, []).append(shingles(expand(text.as_py())))

        both = zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)
        held = [(a, b) for a, b in both if any(_similar(x, y, percent) for x in sets.get(a, ()) for y in sets.get(b, ()))]
        return pa.Table.from_pydict({n: pa.array([p[i] for p in held], pa.int64()) for i, n in enumerate("ab")})

    return run


def _squeezed(docs: DataFrame) -> DataFrame:
    named = docs.select("doc_id", "text").where("doc_id is not null")
    return named.mapInArrow(_squeeze, "doc_id bigint, text binary")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are linked.

    Pairs that hang together are checked together, in blocks of about ``2 * GROUP_ROWS`` documents, so a text
    travels once per block and not once per pair.
    """
    families = stages.components(pairs)
    parts = families.groupBy("component").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))
    placed = pairs.join(families.withColumnRenamed("node", "a"), "a").join(parts, "component")
    of = {c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int") for c in ("a", "b")}
    block = ["component", "i", "j"]
    placed = placed.select(
        "component", F.least(of["a"], of["b"]).alias("i"), F.greatest(of["a"], of["b"]).alias("j"), "a", "b"
    )
    placed = stages.written(placed, "pairs")
    needed = placed.select(*block, F.col("a").alias("doc_id")).union(placed.select(*block, "b")).distinct()
    needed = needed.toDF("family", "left", "right", "doc_id")
    held = _squeezed(docs).join(needed.hint("merge"), "doc_id").groupBy("family", "left", "right")
    return held.cogroup(placed.groupBy(*block)).applyInArrow(_verified(percent), "a bigint, b bigint").distinct()


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    for side in ("a", "b"):
        named = classes.select(
            F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")
        )
        pairs = pairs.join(named, side)
    close = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    return pairs.where(close).mapInPandas(_estimated(percent), "a bigint, b bigint").distinct()


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of distinct shingles. A component is
    named by its smallest ``doc_id``, which is kept.

    Null and empty texts have no shingles and link with nothing. Rows without ``doc_id`` cannot be named: they stay
    alone, with a null component, and are kept. Rows of one ``doc_id`` are one document, linked if any of its texts
    is. An empty table gives no rows. Other columns are ignored.
    """
    every = stages.written(sketched(docs), "sketches")
    named = every.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("print").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    classes = stages.written(classes, "classes")
    bands = classes.select("doc_id", "sketch").mapInPandas(_bands, "band bigint, doc bigint")
    shared = bands.groupBy("band").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = stages.written(bands.join(shared, "band").where("doc != first"), "bands")

    pairs = members.select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    pairs = stages.written(_likely_pairs(pairs, classes, percent), "pairs")
    links = stages.written(verified(pairs, docs, percent), "links")
    labels = stages.components(links)

    # Bands whose other classes are still in different components.
    placed = members.where("n > 2").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    placed = placed.select("band", "doc", "n", F.coalesce("component", "doc").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    mixed = placed.join(mixed.where("_low != _high").select("band"), "band")
    parts = F.ceil(F.col("n") / GROUP_ROWS).cast("int")
    mixed = mixed.withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    mixed = mixed.select(
        "band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "component", "doc"
    )
    mixed = stages.written(mixed.join(classes.select(F.col("doc_id").alias("doc"), "n_shingles", "sketch"), "doc"), "bands")
    blocks = F.pmod(F.xxhash64(*_BLOCK), F.lit(max(1, mixed.count() // TASK_ROWS)))
    promising = mixed.groupBy(blocks).applyInPandas(
        _promising(percent), "band bigint, i int, j int, part int, component bigint, doc bigint"
    )
    promising = stages.written(promising, "bands")
    rows = promising.count()
    if rows:
        texts = _squeezed(docs).withColumnRenamed("doc_id", "doc")
        held = texts.join(promising.hint("merge"), "doc")
        more = held.groupBy(F.pmod(F.xxhash64(*_BLOCK), F.lit(max(1, rows // GROUP_ROWS)))).applyInPandas(
            _linked_across(percent), "a bigint, b bigint"
        )
        labels = stages.components(links.union(more))

    head = named.groupBy("print").agg(F.min("doc_id").alias("node")).join(labels, "node", "left")
    head = head.select("print", F.coalesce("component", "node").alias("component_id"))
    alone = every.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print"))
    placed = alone.join(head, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == component)
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
