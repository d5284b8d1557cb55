"""Operators that score or extract single texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavequery.llm import html_text, multiset_hash, toxicity

PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<div class="ad">Buy now</div>%s<footer>&copy; x</footer></body>"""
WANT = "Title & more\n\nFirst paragraph with a link inside.\n\nSecond paragraph, on two lines."
ARTICLE = """<h1>Title &amp; more</h1><p><b>First   paragraph with <a href=x>a link</a> inside.<p>Second&nbsp;paragraph,<br>on two lines.</p>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div id=content>%s</div>", "<main><div>%s</div></main>"])
def test_main_text(wrap):
    comments = '<section class="comments"><p>I do not agree with any of this at all, really not.</p></section>'
    assert html_text.extract(PAGE % (wrap % (ARTICLE + comments))) == WANT


LONG = "".join(f"<p>{w} paragraph of the article, with a good many plain words in it to read.</p>" for w in ("First", "Second", "Third"))
WRAPPERS = [
    '<div style="overflow:hidden">%s</div>',
    '<div title="hidden gem" data-hidden="false">%s</div>',
    '<div class="content-sidebar-wrap">%s</div>',
    '<div id="with-sidebar"><article>%s</article></div>',
    '<form action="/x"><div class="content-sidebar-wrap">%s</div></form>',
]


@pytest.mark.parametrize("wrap", WRAPPERS)
def test_main_text_in_wrappers_named_like_what_is_set_aside(wrap):
    assert html_text.extract(PAGE % (wrap % LONG)).count("paragraph of the article") == 3
    assert "Buy now" not in html_text.extract(PAGE % (wrap % LONG))


def test_long_comments_are_no_wrapper():
    comments = '<div class="comments">' + "<p>I do not agree with any of this at all, really not.</p>" * 9 + "</div>"
    for page in (f"<article>{LONG}{comments}</article>", f'<form><article>{LONG}</article>{comments}</form>', f"<article>{LONG}</article>{comments}"):
        got = html_text.extract(PAGE % page)
        assert got.count("paragraph of the article") == 3 and "agree" not in got
    assert html_text.extract(PAGE % f"<article>{LONG}<div hidden>{LONG}</div></article>").count("paragraph") == 3


SCRIPTS = [
    "for(i=0;i<n;i++){x()}",
    'document.write("<!-- no end");',
    "if(a<b){s=\"it's\"}",
    "t='<p title=\"';",
]


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("end", ["</script>", "</SCRIPT >", "</script\n>"])
def test_scripts_do_not_swallow_the_text_behind_them(script, end):
    page = f"<body><article>{LONG}<script>{script}{end}{LONG}<style>a<b{{}}</style>{LONG}</article></body>"
    got = html_text.extract(page)
    assert got.count("paragraph of the article") == 9 and "<" not in got and script[:8] not in got
    assert html_text.extract(f"<p>a</p><script>{script}") == "a"


def test_all_parts_of_article_and_main_are_found():
    other = LONG.replace("the article", "another one")
    loose = "Loose text beside it, which is no element of its own but as long as one of the paragraphs."
    links = "<ul>" + "".join(f"<li><a href=/{i}>More {i} to see</a></li>" for i in range(8)) + "</ul>"
    short = "<article><p>A second article, of one paragraph, with as many plain words as any of the others.</p></article>"
    for page, want in [
        (f"<article>{LONG}</article><article>{other}</article>", ["another one"] * 3),
        (f"<article>{LONG}{LONG}</article><div><p>{loose}</p></div>{short}", ["second article"]),
        (f"<article><header><h2>Short head</h2></header><div>{LONG}</div></article>", ["Short head"]),
        (f"<main>{loose}<article>{LONG}{LONG}</article><p>Behind it in main stands one more paragraph, with as many plain words as any other has.</p></main>", ["Loose text", "Behind it"]),
        (f"<article>{LONG}{links}</article>", []),
    ]:
        got = html_text.extract(PAGE % page)
        assert got.count("paragraph of the article") == LONG.count("<p>") * page.count(LONG)
        assert all(got.count(w) == want.count(w) for w in want)
        assert "More 1" not in got and "Buy now" not in got
    assert html_text.extract("<html><body>Loose text<p>b</p></body></html>") == "Loose text\n\nb"


def test_page_edge_cases(spark):
    pages = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p>a</p><p>b", 1), (3, "u", "<div>" * 2000 + "deep", 1), (3, "u", "<a href='x>b", 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, text int")
    got = sorted((r.page_id or -1, r.text) for r in html_text.main_texts(df).collect())
    assert got == [(-1, "a\n\nb"), (1, ""), (2, ""), (3, "b"), (3, "deep")]
    assert html_text.main_texts(df.limit(0)).count() == 0


def labelled(spark, n=600):
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.15
        words = [f"w{rnd.randrange(500)}" for _ in range(60)] + [f"vile{rnd.randrange(9)}x" for _ in range(4 * toxic)]
        rnd.shuffle(words)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(None, None, "en", "s", 1), (n, "", "en", "s", 1)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels, "doc_id", "left").withColumn("out", toxicity.held_out())
    rows = rows.collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.out and r.toxic is not None]
    assert sum((r.score >= 0.3) == (r.toxic == 1) for r in out) >= 0.97 * len(out)


def test_toxicity_never_learns_from_held_out_labels(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.biases, b.biases)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def lanes(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in multiset_hash.sums(rows, ["doc_id"]).collect()}


def test_fingerprints_ignore_order_and_add_up(spark):
    got = lanes(spark, ["a. b\nc d\ne", "e\na. b\nc d", "a. b\nc d", "e", "a. b\nc d\nx", ""])
    assert got[0].wide == got[1].wide and got[0].signs == got[1].signs and got[0].wide != got[4].wide
    assert [(x + y) % 2**32 for x, y in zip(got[2].wide, got[3].wide)] == got[0].wide
    assert [x + y for x, y in zip(got[2].signs, got[3].signs)] == got[0].signs
    assert set(got[5].wide) == {0}


def test_paragraphs_come_and_go_in_all_lanes(spark):
    rnd = random.Random(6)
    made = lambda: "\n".join(". ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 6)))
    pairs = [(made(), made()) for _ in range(12)] + [("", made()), (made(), "")]
    texts = [t for a, b in pairs for t in (a, b, f"{b}\n{a}")]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sums = multiset_hash.sums(rows, ["doc_id"]).select("doc_id", multiset_hash.fingerprint("wide", "signs").alias("f"))
    prints = {r.doc_id: r.f for r in sums.collect()}
    triples = [(prints[3 * i], prints[3 * i + 1], prints[3 * i + 2]) for i in range(len(pairs))] + [(None, prints[0], None)]
    a, b, both = F.col("a"), F.col("b"), F.col("both")
    got = spark.createDataFrame(triples, "a string, b string, both string").select(
        multiset_hash.combined_fingerprint(a, b).eqNullSafe(both).alias("added"),
        multiset_hash.combined_fingerprint(both, b, minus=True).eqNullSafe(a).alias("removed"),
    )
    assert all(r.added and r.removed for r in got.collect())


def test_likeness_of_edited_and_next_texts(spark):
    rnd = random.Random(1)
    rows = [(i * 7, ". ".join(f"s{rnd.randrange(10**9)} x" for _ in range(40))) for i in range(60)] + [(None, None), (900, ""), (900, "")]
    got = multiset_hash.compared(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    full = [r for r in got if r.n_chars]
    assert np.mean([r.near_edited for r in full]) > 0.4 > 0.2 > np.mean([r.near_next for r in full])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert multiset_hash.compared(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = multiset_hash.compared(spark.createDataFrame([(1, "a. b")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "substring_dedup", "packing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.count() > 0
