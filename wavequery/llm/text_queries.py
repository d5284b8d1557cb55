"""Queries of the operators that judge or extract single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.llm import html_text, multiset_hash, quality, toxicity
from wavequery.llm.registry import query
from wavequery.session import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op10_suffix_repetition",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM d),
    k AS (
      SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS k3, i + 2 <= len(words) AS has3,
             array_to_string(words[i:i + {quality.SHORTEST - 1}], ' ') AS km, i + {quality.SHORTEST - 1} <= len(words) AS hasm,
             array_to_string(words[i:i + {quality.LONGEST_REPEAT}], ' ') AS kl,
             i + {quality.LONGEST_REPEAT} <= len(words) AS hasl
      FROM w
    ),
    f AS (
      SELECT doc_id, i,
             has3 AND count(*) FILTER (has3) OVER (PARTITION BY doc_id, k3) > 1 AS r3,
             hasm AND count(*) FILTER (hasm) OVER (PARTITION BY doc_id, km) > 1 AS rm,
             hasl AND count(*) FILTER (hasl) OVER (PARTITION BY doc_id, kl) > 1 AS rl
      FROM k
    ),
    c AS (
      SELECT doc_id, rl,
             bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
             bool_or(rm) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {quality.SHORTEST - 1} PRECEDING AND CURRENT ROW) AS cm
      FROM f
    ),
    s AS (
      SELECT doc_id, count(*) FILTER (c3) AS n3, count(*) FILTER (cm) AS nm, bool_or(rl) AS long FROM c GROUP BY doc_id
    ),
    l AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ),
    o AS (
      SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n3, 0) AS n_repeat_words,
             coalesce(nm, 0) AS n_covered_words, coalesce(long, false) AS long
      FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
             AND NOT (100 * n_covered_words > {quality.COVERED_PERCENT} * n_words OR long) AS kept
    FROM o
    """,
)
def op10_suffix_repetition(spark, sf_dir):
    """Repetition verdicts of all documents."""
    return quality.judged(quality.measure(table(spark, sf_dir, "documents"))).drop("longest_repeat")


@query("op1_nnpu_toxicity")
def op1_nnpu_toxicity(spark, sf_dir):
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted.alias("predicted"))


_HALF, _SIGNS = multiset_hash.HALF, multiset_hash.SIGNS


@query(
    "op2_multiset_hash",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    o AS (
      SELECT doc_id, text, n,
             coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
             coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
      FROM d WINDOW w AS (ORDER BY doc_id DESC)
    ),
    t AS (
      SELECT doc_id, false AS edited, text FROM o
      UNION ALL SELECT doc_id, true, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) FROM o
    ),
    p AS (SELECT doc_id, edited, unnest(string_split(text, chr(10))) AS p FROM t),
    q AS (SELECT doc_id, edited, sha256('0' || p) || sha256('1' || p) AS h FROM p WHERE p <> ''),
    u AS (
      SELECT doc_id, edited, lane, sum(('0x' || substr(h, 1 + 8 * lane, 8))::BIGINT) % 4294967296 AS v
      FROM q, range(0, {multiset_hash.WIDE}) AS r(lane) GROUP BY ALL
    ),
    wide AS (
      SELECT doc_id, edited, string_agg(printf('%08x', coalesce(v, 0)::BIGINT), '' ORDER BY lane) AS w
      FROM t CROSS JOIN range(0, {multiset_hash.WIDE}) AS r(lane) LEFT JOIN u USING (doc_id, edited, lane) GROUP BY doc_id, edited
    ),
    s AS (
      SELECT doc_id, edited, md5(trim(x)) AS h
      FROM (SELECT doc_id, edited, unnest(string_split(replace(text, '.', chr(10)), chr(10))) AS x FROM t)
      WHERE trim(x) <> ''
    ),
    b AS (
      SELECT doc_id, edited, lane,
             sum(2 * ((('0x' || substr(h, 1 + 15 * (lane // {2 * _HALF}), 15))::BIGINT >> (lane % {2 * _HALF})) & 1) - 1) AS v
      FROM s, range(0, {_SIGNS}) AS r(lane) GROUP BY ALL
    ),
    signs AS (
      SELECT doc_id, edited, list((coalesce(v, 0))::BIGINT ORDER BY lane) AS v,
             string_agg(printf('%04x', ((coalesce(v, 0)::BIGINT + 65536) % 65536)::BIGINT), '' ORDER BY lane) AS x
      FROM t CROSS JOIN range(0, {_SIGNS}) AS r(lane) LEFT JOIN b USING (doc_id, edited, lane) GROUP BY doc_id, edited
    ),
    f AS (SELECT doc_id, edited, v, w || x AS fingerprint FROM wide JOIN signs USING (doc_id, edited)),
    j AS (
      SELECT o.doc_id, n, sha256(e.text) AS edited_sha256, a.fingerprint, c.fingerprint AS edited_fingerprint,
             a.v AS av, c.v AS cv, z.v AS zv
      FROM o JOIN f a ON a.doc_id = o.doc_id AND NOT a.edited JOIN f c ON c.doc_id = o.doc_id AND c.edited
      JOIN f z ON z.doc_id = o.next_id AND NOT z.edited JOIN t e ON e.doc_id = o.doc_id AND e.edited
    ),
    k AS (
      SELECT *, list_sum([x * x FOR x IN av])::BIGINT AS aa, list_sum([x * x FOR x IN cv])::BIGINT AS cc,
             list_sum([x * x FOR x IN zv])::BIGINT AS zz,
             list_sum([(av[i] - cv[i]) * (av[i] - cv[i]) FOR i IN range(1, {_SIGNS} + 1)])::BIGINT AS ac,
             list_sum([(av[i] - zv[i]) * (av[i] - zv[i]) FOR i IN range(1, {_SIGNS} + 1)])::BIGINT AS az
      FROM j
    )
    SELECT doc_id, n AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
           CASE WHEN ac = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - ac / (aa + cc)) END AS near_edited,
           CASE WHEN az = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - az / (aa + zz)) END AS near_next
    FROM k
    """,
)
def op2_multiset_hash(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return multiset_hash.compared(table(spark, sf_dir, "documents"))


@query("op5_text_density")
def op5_text_density(spark, sf_dir):
    """Main texts of all pages."""
    found = html_text.main_texts(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
