"""Queries of the operators that work on links, conversations and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequery.llm import burst_trie, link_graph, periods
from wavequery.llm.registry import query
from wavequery.session import table


# The rules that every url is judged by.
RULES = (
    link_graph.Rule("net", "/", "block"),
    link_graph.Rule("example.net", "/en/", "allow"),
    link_graph.Rule("example.com", "/de/", "block"),
    link_graph.Rule("org", "/fr/", "allow"),
)


def _rule_cases(host: str, path: str, what: str) -> str:
    """SQL of the longest rule that fits, or of its verdict."""
    cases = [
        f"WHEN ({host} = '{r.host}' OR {host} LIKE '%.{r.host}') AND starts_with({path}, '{r.path}') THEN '{getattr(r, what)}'"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    ]
    return f"CASE {' '.join(cases)} END"


def _host(url: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_link_graph",
    rf"""
    WITH RECURSIVE l AS (
      SELECT page_id, html, {_host("url")} AS host,
             CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
                  ELSE '' END AS path
      FROM pages
    ),
    r AS (SELECT page_id, html, host, path, {_rule_cases("host", "path", "name")} AS rule,
                 {_rule_cases("host", "path", "verdict")} AS verdict FROM l),
    a AS (SELECT host, unnest(regexp_extract_all(html, '{link_graph.LINKS.replace("'", "''")}', 1)) AS link FROM r WHERE host <> ''),
    t AS (SELECT host AS s, translate(regexp_extract(link, '{link_graph.LINK_HOST}', 1),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM a),
    e AS (SELECT DISTINCT s, t FROM t WHERE t <> '' AND t <> s),
    arcs AS (SELECT 'trust' AS kind, s AS a, t AS b FROM e UNION ALL SELECT 'distrust', t, s FROM e),
    g AS (SELECT *, count(*) OVER (PARTITION BY kind, a) AS degree FROM arcs),
    h AS (
      SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked
      FROM r WHERE host <> '' GROUP BY host
      UNION ALL
      SELECT b, 1, CASE WHEN v = 'allow' THEN 1 ELSE 0 END, CASE WHEN v = 'block' THEN 1 ELSE 0 END
      FROM (SELECT DISTINCT b, {_rule_cases("b", "'/'", "verdict")} AS v FROM arcs) WHERE b NOT IN (SELECT host FROM r)
    ),
    f(k, kind, host, mass) AS (
      SELECT 0, kind, host, ({link_graph.UNIT} * part // n)::BIGINT
      FROM (SELECT host, n, 'trust' AS kind, allowed AS part FROM h UNION ALL SELECT host, n, 'distrust', blocked FROM h)
      WHERE part > 0
      UNION ALL
      SELECT k + 1, kind, b, sum(part)::BIGINT
      FROM (SELECT f.k, g.kind, g.b, f.mass * {link_graph.PASSED_PERCENT} // (100 * g.degree) AS part
            FROM f JOIN g ON g.kind = f.kind AND g.a = f.host WHERE f.k < {link_graph.ROUNDS})
      WHERE part > 0 GROUP BY k, kind, b
    ),
    v AS (
      SELECT host FROM f GROUP BY host
      HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) >= {link_graph.BLOCKED}
         AND sum(mass) FILTER (kind = 'distrust') > coalesce(sum(mass) FILTER (kind = 'trust'), 0)
    )
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (FROM v) THEN 'block' ELSE 'allow' END) AS verdict
    FROM r
    """,
)
def op11_link_graph(spark, sf_dir):
    """Verdicts on the urls of all pages."""
    return link_graph.judged(table(spark, sf_dir, "pages"), RULES)


def recombined(convs: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first conversation of its hundred, by checksum of its id."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    mine = convs.select("conv_id", "symbols", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("_base"))
    base = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.col("symbols").alias("_of_base"))
    head = burst_trie.first_turns(F.coalesce("_of_base", F.lit(b"")), F.col("_h"))
    rebuilt = F.concat(head, burst_trie.later_turns(F.col("symbols"), F.col("_h")))
    return mine.join(base, "_base", "left").select("conv_id", rebuilt.alias("symbols"))


@query(
    "op12_burst_trie",
    """
    WITH RECURSIVE bits(i, k, v) AS (
      SELECT i, 0, i FROM range(0, 256) AS r(i)
      UNION ALL
      SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
    ),
    crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
    o AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
             md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m
      FROM conversations WHERE conv_id IS NOT NULL
    ),
    c AS (SELECT conv_id, list({'m': m, 'n': length(text)} ORDER BY turn NULLS FIRST, m) AS own FROM o GROUP BY conv_id),
    h AS (
      SELECT conv_id, own, xor(4294967295, list_reduce(
        [4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
        LAMBDA a, b: xor(a // 256, t[1 + xor(a, b) % 256]))) % 6 AS h
      FROM c, crc
    ),
    r AS (
      SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS turns
      FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100
    ),
    p AS (
      SELECT conv_id, d, [x.m FOR x IN turns[1:d]] AS key, CASE WHEN d = 0 THEN 0 ELSE turns[d].n END AS chars, d = len(turns) AS ended
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)
    ),
    n AS (
      SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends
      FROM p GROUP BY key, d
    ),
    k AS (
      SELECT x.key, x.d, x.conv_id, x.n_convs, x.chars, x.ends, u.conv_id AS parent, count(y.d) AS n_children
      FROM n x LEFT JOIN n u ON x.d > 0 AND u.d = x.d - 1 AND u.key = x.key[1:x.d - 1]
      LEFT JOIN n y ON y.d = x.d + 1 AND y.key[1:y.d - 1] = x.key GROUP BY ALL
    ),
    s AS (
      SELECT key[1:j] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM k) GROUP BY key[1:j]
    )
    SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved AS saved_tokens, ends AS ends_sha256
    FROM k JOIN s USING (key)
    """,
)
def op12_burst_trie(spark, sf_dir):
    """Prefix trie of all recombined conversations."""
    return burst_trie.trie(recombined(burst_trie.sequences(table(spark, sf_dir, "conversations"))))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; every tenth document, by checksum of its id, repeats some of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    docs = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    # Without words there is no position to start from.
    a = g % F.nullif(n, F.lit(0))
    docs = docs.select("*", a.alias("_a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("_p"))

    def word(i: Column) -> Column:
        place = F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
        return F.element_at("_words", (place + 1).cast("int"))

    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_words") - 1), word), " ")
    return docs.select("doc_id", F.when(F.size("_words") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of all documents."""
    found = periods.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # The greatest length first, then the smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", best.alias("_best"), F.array_join(lines, "").alias("_lines"))
    length, start, period = (F.col("_best").getField(f) for f in found.schema["_best"].dataType.names)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-start).alias("start"),
        length.alias("length"),
        (-period).alias("period"),
        F.floor(1000 * length / -period).alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
