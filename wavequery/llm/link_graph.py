"""URL verdicts from rules, and from the links between hosts where no rule fits.

The longest rule that fits a url decides. Ruled pages make seeds of their hosts: a host is trusted by the share of its pages that rules
allow, and blocked by the share that they block. Two personalised PageRanks run over the links between hosts: trust
goes from trusted hosts along the links, distrust from blocked hosts against them, to those that link there. Both are pushed in
rounds: a host passes on 85 % of what it has just received, in equal parts, and only hosts that received anything take
part in a round. Amounts are integers, so they don't depend on the order of addition. A threshold per host decides the
pages that no rule covers.

Everything is DataFrame functions. Hubs and hosts with very many pages are salted; there are at most ``HOT`` of each kind,
since each holds more than ``1 / HOT`` of all rows, so their list is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequery.llm import stages

UNIT = 1_000_000  # what a host with all its pages trusted or blocked starts with
PASSED_PERCENT = 85
ROUNDS = 20  # what would go further is below 0.85 ** 20 = 4 % of the whole
BLOCKED = UNIT // 2  # distrust of a host that is blocked, if it also exceeds the trust
HOT = 1000
SALTS = 32

# Comments and elements whose text is no markup (all end with the page at the latest), then anchors.
LINKS = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<textarea\b.*?(?:</textarea\b|\z)"
    r"""|<a[ \t\n\f\r/](?:[^<>]*?[ \t\n\f\r"'/])?href[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*([^"'<> \t\n\f\r]*)"""
)
LINK_HOST = r"(?i)^(?:https?:)?//([^/?#\\]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A verdict on a host, its subdomains and all paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, else null. Rules become one expression."""
    found = None
    for rule in sorted(set(rules), key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    none = F.lit(None).cast("struct<rule: string, verdict: string>")
    return none if found is None else found.otherwise(none)


def located(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id``, ``host``, ``path`` and what the rules say (``ruled``, null where none fits) of every page."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    return split.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts, ``source`` and ``target``, from the anchors of the ``html``.

    Links inside comments, scripts and styles don't count, nor relative ones, which stay on their host.
    """
    hosts = F.transform(
        F.regexp_extract_all("html", F.lit(LINKS), F.lit(1)),
        lambda link: F.translate(F.regexp_extract(link, LINK_HOST, 1), _UPPER, _LOWER),
    )
    source = host_and_path(F.col("url"))[0]
    linked = pages.select(source.alias("source"), F.array_distinct(hosts).alias("_targets")).where("source != ''")
    pairs = linked.select("source", F.explode("_targets").alias("target")).where("target != '' AND target != source")
    return pairs.distinct()


def seeded(placed: DataFrame, links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``host``, ``n_pages``, ``trust`` and ``distrust`` at the start, of all hosts that have pages or links.

    A host without pages of its own counts as one page at ``/``.
    """
    is_allowed, is_blocked = (F.sum(F.when(F.col("ruled.verdict") == v, 1).otherwise(0)) for v in ("allow", "block"))
    own = placed.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n_pages"), is_allowed.alias("_allowed"), is_blocked.alias("_blocked")
    )
    ends = links.select(F.explode(F.array("source", "target")).alias("host")).distinct().join(own, "host", "left_anti")
    said = longest_rule(F.col("host"), F.lit("/"), rules)["verdict"]
    counted = [F.when(said == v, 1).otherwise(0).cast("bigint").alias(f"_{v}ed") for v in ("allow", "block")]
    rest = ends.select("host", F.lit(0).cast("bigint").alias("n_pages"), *counted)
    shares = [F.expr(f"{UNIT} * {c} div greatest(n_pages, 1)").alias(n) for c, n in (("_allowed", "trust"), ("_blocked", "distrust"))]
    return own.union(rest).select("host", "n_pages", *shares)


def propagated(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` after all rounds, of every host that received any."""
    forward = links.select(F.lit("trust").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    backward = links.select(F.lit("distrust").alias("kind"), F.col("target").alias("a"), F.col("source").alias("b"))
    arcs = stages.written(forward.union(backward), "arcs")
    degrees = stages.written(arcs.groupBy("kind", "a").agg(F.count("*").alias("degree")), "degrees")
    total = degrees.agg(F.sum("degree")).first()[0] or 0
    # At most 2 * HOT hosts can hold so many of the arcs, which are counted once per direction.
    hubs = F.broadcast(degrees.where(F.col("degree") * 2 * HOT > total).select("kind", "a", F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    arcs = arcs.join(hubs, ["kind", "a"], "left")
    arcs = stages.written(arcs.select("kind", "a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt")), "arcs")
    degrees = degrees.join(hubs, ["kind", "a"], "left").select("kind", "a", "degree", salts.alias("_salts"))

    start = [
        seeds.where(F.col(k) > 0).select(F.lit(k).alias("kind"), F.col("host").alias("a"), F.col(k).alias("mass"))
        for k in ("trust", "distrust")
    ]
    front = stages.written(start[0].union(start[1]), "front")
    every = front
    for _ in range(ROUNDS if total else 0):
        part = F.expr(f"mass * {PASSED_PERCENT} div (100 * degree)").alias("part")
        sent = front.join(degrees, ["kind", "a"]).select("kind", "a", "_salts", part).where("part > 0")
        sent = sent.select("kind", "a", "part", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"))
        got = arcs.join(sent, ["kind", "a", "salt"]).groupBy("kind", "b").agg(F.sum("part").alias("mass"))
        front = stages.written(got.select("kind", F.col("b").alias("a"), "mass"), "front")
        if front.isEmpty():
            break
        every = every.union(front)
    of = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k) for k in ("trust", "distrust")]
    return every.groupBy(F.col("a").alias("host")).agg(*of)


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``) of every page.

    A null url, or one without ``://``, has neither host nor path and is allowed. Null html has no links. Rules of equal
    length go by their text. A null ``page_id`` stays null; repeated rows are judged each and weigh each in the shares of
    their host; an empty table gives no rows. Pages of any length are read whole. Other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    placed = located(pages, rules)
    links = stages.written(host_links(pages), "host_links")
    seeds = stages.written(seeded(placed, links, rules), "hosts")
    scores = propagated(seeds, links)
    blocked = scores.where((F.col("distrust") >= BLOCKED) & (F.col("distrust") > F.col("trust"))).select("host")
    blocked = stages.written(blocked, "blocked_hosts")

    n_pages = seeds.agg(F.sum("n_pages")).first()[0] or 0
    # At most HOT hosts can hold so many of the pages.
    hot = F.broadcast(seeds.where(F.col("n_pages") * HOT > n_pages).select("host", F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    spread = placed.join(hot, "host", "left").withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), salts).cast("int"))
    each = F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
    blocked = blocked.join(hot, "host", "left").select("host", each, F.lit("block").alias("_linked"))
    verdict = F.coalesce("ruled.verdict", "_linked", F.lit("allow"))
    return spread.join(blocked, ["host", "_salt"], "left").select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict")
    )
