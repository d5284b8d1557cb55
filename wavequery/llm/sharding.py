"""Shards of bounded size by extendible hashing.

A document's key is a string of hash bits. The directory maps bit prefixes to shards: a bucket whose documents exceed the
byte limit splits on its next bit, alone, until every shard fits. Splits are found from sums per prefix, ``STEP`` bits a
round; a round looks only at the documents of buckets that are still too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavequery.llm import stages

LIMIT_BYTES = 16 << 20
STEP = 10  # bits a round looks ahead
KEY_BITS = 120


def bits(text) -> F.Column:
    """60 hash bits of a column, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(text), 1, 15), 16, 2), 60, "0")


def keyed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_bytes`` and ``key``: bits of the id, then bits of the text that tell rows of one id apart."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        *keep,
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.concat(bits(name.cast("binary")), bits(text.cast("binary"))).alias("key"),
    )


def _round(open_: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards that end within ``STEP`` bits from ``depth``, and the prefixes that are too large even then."""
    deepest = open_.groupBy(F.substring("key", 1, depth + STEP).alias("leaf")).agg(
        F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")
    )
    # A row for each prefix of a leaf; prefixes of one length lie below 2**STEP open buckets' leaves.
    spread = deepest.select("n_bytes", "n_docs", "leaf", F.explode(F.sequence(F.lit(depth), F.lit(depth + STEP))).alias("bits"))
    sums = spread.groupBy(F.expr("substring(leaf, 1, bits)").alias("prefix"), "bits").agg(
        F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs")
    )
    parent = sums.where(F.col("shard_bytes") > limit).select(
        F.col("prefix").alias("_parent"), (F.col("bits") + 1).alias("bits")
    )
    sums = sums.withColumn("_parent", F.expr("substring(prefix, 1, greatest(bits - 1, 0))"))
    # Only what lies below a bucket that is too large comes into being; the first level is there already.
    born = sums.where(F.col("bits") == depth).unionByName(sums.join(parent, ["_parent", "bits"], "left_semi").select(sums.columns))
    born = stages.written(born.drop("_parent"), "shards")
    return born.where(F.col("shard_bytes") <= limit), born.where((F.col("bits") == depth + STEP) & (F.col("shard_bytes") > limit))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``prefix``, ``bits``, ``shard_bytes`` and ``shard_docs`` of every shard, in ``rows`` from ``keyed``.

    Rows whose whole keys agree are copies of one document, or single documents over the limit: their shard has all
    ``KEY_BITS`` bits and may exceed the limit. ``assigned`` cuts it into pages.
    """
    found, open_, depth = [], rows, 0
    while True:
        done, large = _round(open_, depth, limit)
        found.append(done)
        depth += STEP
        if depth >= KEY_BITS or large.isEmpty():
            return reduce(DataFrame.union, [*found, large])
        open_ = rows.join(large.select(F.col("prefix").alias("_open")), F.substring("key", 1, depth) == F.col("_open"), "left_semi")


def assigned(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``shard`` (bit prefix), ``page``, ``shard_bytes`` and ``shard_docs`` of every document.

    A shard holds at most ``limit`` bytes. Documents that no bit tells apart (repeated rows) are dealt to pages of
    that size; a single longer document is a page of its own. Null text counts as empty; a null ``doc_id`` as an
    empty name. An empty table gives no rows. Other columns are ignored.
    """
    placed = _placed(docs, limit)
    fits = placed.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("bigint"))
    over = placed.where(F.col("shard_bytes") > limit).withColumn("page", _page("doc_id", limit))
    return fits.unionByName(over).select("doc_id", "n_bytes", F.col("prefix").alias("shard"), "page", "shard_bytes", "shard_docs")


def _placed(docs: DataFrame, limit: int) -> DataFrame:
    """Rows from ``keyed`` with the prefix and sums of their shard."""
    rows = stages.written(keyed(docs), "keys")
    shards = directory(rows, limit)
    lengths = [r["bits"] for r in shards.select("bits").distinct().collect()]  # at most KEY_BITS + 1 numbers
    wanted = F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array(F.lit(0))
    # A document lies in the one shard whose prefix its key has.
    tried = rows.select("*", F.explode(F.transform(wanted, lambda n: F.substring("key", F.lit(1), n))).alias("prefix"))
    return tried.join(shards, "prefix").drop("bits")


def _page(order, limit: int) -> F.Column:
    """Page of a row of a shard over the limit, whose rows all have one key."""
    alike = Window.partitionBy("key").orderBy(order)
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    page = F.when(F.col("shard_bytes") <= limit, 0).otherwise(F.floor((F.row_number().over(alike) - 1) / per_page))
    return page.cast("bigint")


def write(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write the documents to ``path`` as Parquet, each shard and page in a folder of its own.

    Every row is written once, with all its columns, also without a ``doc_id``. Rows of one id with different texts go to
    the shard of each; repeated rows over the limit are dealt to pages as in ``assigned``.
    """
    keys = _placed(docs, limit).select("key", F.col("prefix").alias("shard"), "shard_bytes").distinct()
    rows = keyed(docs, tuple(docs.columns)).join(keys, "key")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.xxhash64(F.to_json(F.struct(*others))) if others else F.col("key")  # the same pages if a task runs again
    fits = rows.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("bigint"))
    over = rows.where(F.col("shard_bytes") > limit).withColumn("page", _page(order, limit))
    dealt = fits.unionByName(over).select(*docs.columns, "shard", "page")
    dealt.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
