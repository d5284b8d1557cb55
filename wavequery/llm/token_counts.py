"""Document lengths in flat token files that have no index.

A file is one stream of fixed-width token ids; an id that occurs nowhere else ends each document. Files
are read in blocks that take no notice of documents. A vectorized comparison finds the separators of a block, and
a prefix scan over the blocks of a file, on a few numbers each, gives what a block must know: how many
documents ended before it, and where the last of them did.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavequery.llm import byte_tokens, stages

BLOCK_BYTES = 1 << 20
TASK_BYTES = 128 << 20  # of flat files that one task reads
SCAN_BLOCKS = 1024  # blocks of one file whose prefix one task computes

FLAT = "file bigint, block bigint, data binary, began array<bigint>"
_SUMMARY = "file bigint, block bigint, tokens bigint, ends array<bigint>, began array<bigint>"


def flat_blocks(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents as flat files of 16-bit ids, one per partition, in blocks.

    ``began`` tells which documents begin in a block; the scan takes no notice of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, held, began = TaskContext.get().partitionId(), 0, bytearray(), []
        end = np.array([byte_tokens.end_id(path)], "<u2").tobytes()

        def made(data: bytes, starts: list) -> pa.RecordBatch:
            columns = [[file], [block], [data], [starts]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["file", "block", "data", "began"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                began.append(doc_id)
                held += byte_tokens.encode(text or "", path, special=False).astype("<u2").tobytes() + end
                while len(held) >= block_bytes:
                    yield made(bytes(held[:block_bytes]), began)
                    del held[:block_bytes]
                    block, began = block + 1, []
        if held:
            yield made(bytes(held), began)

    return docs.select("doc_id", "text").mapInArrow(run, FLAT)


def _opener(name: str):
    """File system of a path as Spark lists it, and what stands before the path's own part; None if pyarrow has none."""
    at = urlsplit(name)
    if at.scheme in ("", "file"):
        return pa_fs.LocalFileSystem(), ""
    try:
        files, base = pa_fs.FileSystem.from_uri(f"{at.scheme}://{at.netloc}/")
    except (pa.ArrowException, OSError, ValueError):
        return None
    return files, base.rstrip("/")


def _own_part(name: str) -> str:
    """The path in its store; a Hadoop path is not escaped, so a ``?`` or ``#`` belongs to it."""
    rest = name.partition(":")[2] if re.match(r"[a-zA-Z][\w+.-]*:/", name) else name
    return "/" + rest[2:].partition("/")[2] if rest.startswith("//") else rest


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Flat files of the folder ``path``, of any size, in blocks.

    Tasks get names and numbers of blocks and read only those bytes, by pyarrow's file systems. In a store that pyarrow
    cannot open, files are read whole by Spark, and must be below 2 GB each.
    """
    found = spark.read.format("binaryFile").load(path)
    listed = found.select(F.col("path").alias("file"), "length").where("length > 0")
    first = listed.select("file").first()
    if first is not None and _opener(first["file"]) is None:
        return _read_whole(found, block_bytes)
    last = F.floor((F.col("length") - 1) / block_bytes)
    blocks = listed.select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "length", "block"))
            for name, length, block in zip(*columns, strict=True):
                store, before = _opener(name)
                at = block * block_bytes
                with store.open_input_file(before + _own_part(name)) as source:
                    data = source.read_at(min(block_bytes, length - at), at)
                if len(data) != min(block_bytes, length - at):
                    raise OSError(f"{name} is shorter than when it was listed")
                columns = [pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "data"])

    return blocks.repartition(tasks).mapInArrow(run, "file string, block bigint, data binary")


def _read_whole(found: DataFrame, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                for block, at in enumerate(range(0, data.size, block_bytes)):
                    part = pa.array([data.slice(at, min(block_bytes, data.size - at)).to_pybytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([block], pa.int64()), part], ["file", "block", "data"]
                    )

    return found.select("path", "content").mapInArrow(run, "file string, block bigint, data binary")


def scanned(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """Tokens of each block and the places just behind its separators; the data are dropped."""
    names = [c for c in blocks.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ends = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                tokens.append(len(ids))
                ends.append(np.flatnonzero(ids == separator) + 1)
            arrays = [batch.column(n) for n in names]
            arrays += [pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "tokens", "ends"])

    kinds = [f"{n} {blocks.schema[n].dataType.simpleString()}" for n in names]
    return blocks.mapInArrow(run, ", ".join([*kinds, "tokens bigint", "ends array<bigint>"]))


def prefixed(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stands before each block and each group of blocks of its file, as two small written tables.

    One row per block: ``_at`` tokens, ``_done`` separators and ``_begun`` documents before it, and ``_from``, the place just
    behind the last separator before it. Groups of ``SCAN_BLOCKS`` blocks are scanned inside first, then the groups of a file. The
    table of groups also holds the tokens, the separators and the last place of the whole file.
    """
    began = F.size("began") if "began" in summary.columns else F.lit(0)
    last = F.try_element_at("ends", F.lit(-1))
    blocks = summary.select(
        "file", "block", F.floor(F.col("block") / SCAN_BLOCKS).alias("group"), "tokens",
        F.size("ends").alias("ends"), began.alias("began"), last.alias("last"),
    )
    counts = {"_at": "tokens", "_done": "ends", "_begun": "began"}
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in counts.items()])
    inside = inside.withColumn("_end", F.col("_at") + F.col("last"))
    inside = inside.select("*", F.max("_end").over(before).alias("_from"))
    inside = stages.written(inside.select("file", "block", "group", *counts.values(), "_end", *counts, "_from"), "token_prefix")

    groups = inside.groupBy("file", "group").agg(*[F.sum(c).alias(c) for c in counts.values()], F.max("_end").alias("_end"))
    whole = Window.partitionBy("file")
    before = whole.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in counts.items()])
    groups = groups.withColumn("_end", F.col("_at") + F.col("_end"))
    groups = groups.select(
        "file", "group", *counts, F.coalesce(F.max("_end").over(before), F.lit(0)).alias("_from"),
        *[F.sum(c).over(whole).alias(f"_all_{c}") for c in ("tokens", "ends")],
        F.coalesce(F.max("_end").over(whole), F.lit(0)).alias("_last"),
    )
    groups = stages.written(groups, "token_groups")

    carried = groups.select("file", "group", *[F.col(c).alias(f"{c}_up") for c in (*counts, "_from")])
    placed = inside.join(carried, ["file", "group"]).select(
        "file", "block", *[(F.col(c) + F.col(f"{c}_up")).alias(c) for c in counts],
        F.coalesce(F.col("_at_up") + F.col("_from"), F.col("_from_up")).alias("_from"),
    )
    return placed, groups


def stitched(summary: DataFrame, prefix: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``file``, ``ordinal``, ``n_tokens`` (without the separator) and ``closed`` of every document.

    ``summary`` comes from ``scanned``. What follows the last separator of a file is a document that is not closed.
    """
    placed, groups = prefix or prefixed(summary)
    ended = summary.select("file", "block", "ends").where(F.size("ends") > 0).join(placed, ["file", "block"])
    ended = ended.select("file", "_at", "_done", "_from", "ends", F.posexplode("ends").alias("_i", "_end"))
    start = F.when(F.col("_i") == 0, F.col("_from")).otherwise(F.col("_at") + F.try_element_at("ends", F.col("_i")))
    closed = ended.select(
        "file",
        (F.col("_done") + F.col("_i")).alias("ordinal"),
        (F.col("_at") + F.col("_end") - start - 1).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    left = groups.select("file", "_all_ends", "_all_tokens", "_last").distinct().where("_all_tokens > _last")
    left = left.select("file", F.col("_all_ends").alias("ordinal"), F.expr("_all_tokens - _last"), F.lit(False))
    return closed.union(left)


def counted(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every document, counted in its flat token file.

    Null and empty texts have no tokens. A null ``doc_id`` stays null; repeated rows are counted each. An
    empty table gives no rows. Other columns are ignored.
    """
    separator = byte_tokens.end_id(path)
    summary = stages.written(scanned(flat_blocks(docs, path), separator), "token_blocks")
    placed, groups = prefixed(summary)
    names = summary.select("file", "block", "began").where(F.size("began") > 0).join(placed, ["file", "block"])
    names = names.select("file", "_begun", F.posexplode("began").alias("_i", "doc_id"))
    names = names.select("file", (F.col("_begun") + F.col("_i")).alias("ordinal"), "doc_id")
    return names.join(stitched(summary, (placed, groups)), ["file", "ordinal"]).select("doc_id", "n_tokens")
