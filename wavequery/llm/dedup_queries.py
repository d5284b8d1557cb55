"""Queries of the operators that compare texts with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.llm import minhash, substring_dedup
from wavequery.llm.registry import query
from wavequery.session import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op8_substring_dedup",
    rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM d),
    k AS (
      SELECT doc_id, i, words[i] AS word, i + 19 <= len(words) AS whole, array_to_string(words[i:i + 19], ' ') AS k FROM w
    ),
    f AS (
      SELECT doc_id, i, word, whole AND row_number() OVER (PARTITION BY whole, k ORDER BY doc_id, i) > 1 AS later FROM k
    ),
    c AS (
      SELECT doc_id, i, word,
             bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
      FROM f
    ),
    s AS (
      SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
      FROM c GROUP BY doc_id
    )
    SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN s USING (doc_id)
    """,
)
def op8_substring_dedup(spark, sf_dir):
    """Words that repeated windows cover, cut from all documents."""
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(plain, 256).alias("kept_sha256"))


@query(
    "op7_hyperminhash_dedup",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
      ) AS words FROM documents
    ),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingle FROM d
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle)
          WHERE x.doc_id <> y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 85 * (u.n + v.n - shared)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
    m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op7_hyperminhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return minhash.linked(table(spark, sf_dir, "documents"))
