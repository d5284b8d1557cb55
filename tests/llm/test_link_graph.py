"""Verdicts from rules and links."""

import random
from collections import defaultdict

import duckdb
import pytest

from wavequery.llm import catalogue, link_graph
from wavequery.llm.structure_queries import RULES

SCHEMA = "page_id bigint, url string, html string, host string, verdict string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other", "other") for r in rows], SCHEMA).repartition(3)


def verdicts(spark, rows):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in link_graph.judged(frame(spark, rows), RULES).collect()}


def test_rules_and_odd_urls(spark):
    rows = [
        (1, "http://a.Example.NET/en/1?x=/de/", None),
        (2, "http://example.net/de/1", ""),
        (3, "https://b.example.com/de/#top", None),
        (4, "https://notexample.com/de/", None),
        (5, "http://org/fr/", None),
        (6, "http://net", None),
        (7, None, '<a href="http://x.net/">'),
        (8, "mailto:a@b.net/", None),
        (9, "", None),
        (10, "x://h?a://b.net/", None),
        (None, "http://net/?", None),
        (11, "http://ÄB.com/p", None),
    ]
    assert verdicts(spark, rows) == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.net", "/de/1", "net/", "block"),
        3: ("b.example.com", "/de/", "example.com/de/", "block"),
        4: ("notexample.com", "/de/", None, "allow"),
        5: ("org", "/fr/", "org/fr/", "allow"),
        6: ("net", "", None, "block"),  # half of the pages of its host are
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("h", "", None, "allow"),
        None: ("net", "/", "net/", "block"),
        11: ("Äb.com", "/p", None, "allow"),
    }
    assert link_graph.judged(frame(spark, rows).limit(0), RULES).count() == 0
    twice = link_graph.judged(frame(spark, [rows[1], rows[1]]), RULES)
    assert twice.columns == ["page_id", "host", "path", "rule", "verdict"] and twice.count() == 2


HTML = """<!-- <a href="http://comment.com/"> --><script>"<a href='http://script.com/'>"</script><a
 class="x" HREF = 'HTTPS://One.com/p?q=1&amp;r'>1</a><A href=//two.com:80>2</A><a href="/own">3</a><a data-href="http://no.com/">
<abbr href="http://no.com/"><a href="http://h.com/self"><a href="ftp://no.com/"><a href="http://one.com#again"><!-- <a href=//open.com/>"""


def test_links_of_a_page(spark):
    rows = [(1, "http://h.com/", HTML), (2, "http://h.com/", HTML), (3, None, HTML), (4, "http://e.com", None)]
    got = {tuple(r) for r in link_graph.host_links(frame(spark, rows)).collect()}
    assert got == {("h.com", "one.com"), ("h.com", "two.com:80")}


@pytest.mark.parametrize("unit", ["<a ", "<!--", "<script>", "<a href", "<a href=", '<a x="', "<a href=//h.com>", "<", "</script"])
def test_hostile_pages_take_linear_time(spark, unit):
    rows = [(1, "http://x.com/", unit * (1_000_000 // len(unit)))]
    assert link_graph.host_links(frame(spark, rows)).count() <= 1


def anchors(*hosts):
    return "".join(f'<a href="http://{h}/p">x</a>' for h in hosts)


def test_distrust_goes_against_links_and_trust_along_them(spark):
    rows = [
        (1, "http://spam.com/", anchors("bad.net")),  # links to a blocked host that has no pages
        (2, "http://far.com/", anchors("spam.com")),
        (3, "http://shop.com/", anchors("bad2.net", "a.com", "b.com")),  # shares the distrust with read.com
        (4, "http://news.org/fr/x", anchors("read.com")),
        (5, "http://read.com/", anchors("bad2.net")),
        (6, "http://mix.example.com/fr/", None),
        (7, "http://mix.example.com/en/", None),
        (8, "http://mix.example.com/en/", None),
        (9, "http://all.example.com/de/1", None),
        (10, "http://all.example.com/de/2", None),
        (11, "http://all.example.com/en/3", None),
        (12, "http://bad.net/", anchors("liked.com")),
        (13, "http://liked.com/", None),
        (14, "http://mix.example.com/de/", None),
    ]
    got = {k: v[3] for k, v in verdicts(spark, rows).items()}
    assert [k for k, v in got.items() if v == "block"] == [k for k in got if k in (1, 2, 9, 10, 11, 12, 14)]


def plain(seeds, links, rounds=link_graph.ROUNDS):
    """Trust and distrust of all hosts, round by round over dictionaries."""
    total = {"trust": defaultdict(int), "distrust": defaultdict(int)}
    for kind, arcs in (("trust", links), ("distrust", [(b, a) for a, b in links])):
        to = defaultdict(list)
        for a, b in arcs:
            to[a].append(b)
        front = {h: s[kind] for h, s in seeds.items() if s[kind]}
        for _ in range(rounds + 1):
            ahead = defaultdict(int)
            for h, mass in front.items():
                total[kind][h] += mass
                for b in to[h]:
                    ahead[b] += mass * 85 // (100 * len(to[h]))
            front = {h: m for h, m in ahead.items() if m}
    return total


def test_propagation_with_a_hub_equals_plain_rounds(spark, monkeypatch):
    rnd = random.Random(2)
    hosts = [f"h{i}.com" for i in range(60)]
    links = {(a, b) for a in hosts for b in rnd.sample(hosts, 3) if a != b} | {("h0.com", b) for b in hosts[1:]}
    links |= {(a, "h1.com") for a in hosts if a != "h1.com"}
    seeds = {h: {"trust": rnd.choice([0, 0, 1_000_000, 333_333]), "distrust": rnd.choice([0, 0, 0, 1_000_000])} for h in hosts}
    monkeypatch.setattr(link_graph, "HOT", 10)  # so that h0 and h1 are salted and the others not
    got = link_graph.propagated(
        spark.createDataFrame([(h, s["trust"], s["distrust"]) for h, s in seeds.items()], "host string, trust bigint, distrust bigint"),
        spark.createDataFrame(sorted(links), "source string, target string").repartition(3),
    )
    want = plain(seeds, links)
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert found == {h: (want["trust"][h], want["distrust"][h]) for h in hosts if want["trust"][h] or want["distrust"][h]}


def test_query_equals_its_sql_where_hosts_are_linked(spark, tmp_path):
    rnd = random.Random(4)
    hosts = [f"{a}{i}.{b}" for i in range(12) for a in ("", "blog.") for b in ("example.com", "example.net", "example.org", "x.org")]
    hosts[:6] = ["hot.example.com"] * 6
    rows = []
    for i in range(400):
        host = rnd.choice(hosts[: rnd.choice([6, len(hosts)])])
        html = anchors(*rnd.sample(hosts, rnd.randrange(5)), f"only{rnd.randrange(30)}.net") if i % 9 else None
        rows.append((i, f"https://{host}/{rnd.choice(['en', 'de', 'fr'])}/{i}{rnd.choice(['', '?a=1', '#b'])}" if i % 50 else None, html))
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()["op11_link_graph"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(catalogue.oracles()["op11_link_graph"])
    assert [d[0] for d in found.description] == got.columns
    want = sorted(map(str, found.fetchall()))
    assert sorted(map(str, map(tuple, got.collect()))) == want
    unruled = [w for w in want if "None" in w]
    assert any("'block'" in w for w in unruled) and any("'allow'" in w for w in unruled)
