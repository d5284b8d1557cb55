"""Queries of the operators that work on tokens and bytes."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from wavequery.llm import bpe, packing, sharding, token_counts
from wavequery.llm.registry import query
from wavequery.session import table

_BYTES = "byte_bpe_50k.json"


@query(
    "op3_extendible_sharding",
    f"""
    WITH d AS (
      SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
             lpad(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT), 60, '0') AS key
      FROM documents
    ),
    s AS (
      SELECT bits, substr(key, 1, bits) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
      FROM d, range(0, 61) AS r(bits) GROUP BY ALL
    )
    SELECT doc_id, n_bytes, shard, 0::BIGINT AS page, shard_bytes, shard_docs
    FROM (
      SELECT doc_id, n_bytes, shard, shard_bytes, shard_docs,
             row_number() OVER (PARTITION BY doc_id ORDER BY bits) AS k
      FROM d JOIN s ON substr(key, 1, bits) = shard AND shard_bytes <= {sharding.LIMIT_BYTES}
    ) WHERE k = 1
    """,
)
def op3_extendible_sharding(spark, sf_dir):
    """The shard of every document."""
    return sharding.assigned(table(spark, sf_dir, "documents"))


@query("op4_rank_array_bpe")
def op4_rank_array_bpe(spark, sf_dir):
    """Word-end BPE of all documents, there and back."""
    done = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY))
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_separator_scan")
def op6_separator_scan(spark, sf_dir):
    """Token counts of all documents, from flat token streams."""
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(_BYTES))


@query("op9_sum_of_squares_packing")
def op9_sum_of_squares_packing(spark, sf_dir):
    """All documents packed into windows of 1024 ids."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(_BYTES))
