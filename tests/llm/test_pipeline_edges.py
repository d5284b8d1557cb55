"""Odd rows through the stages of the pipeline."""

import random

import pytest

import corpus_pipeline

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, part int, runs string, component_id bigint"
)


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


def near(text, every):
    return " ".join(f"x{i}" if i % every == every // 2 else w for i, w in enumerate(text.split()))


LONG = words(1, 400)
ROWS = [
    (1, LONG), (1, LONG), (2, LONG), (3, near(LONG, 60)), (4, words(2, 300)), (4, words(3, 300)), (5, None), (6, ""), (6, ""), (None, LONG), (None, LONG),
    (None, None), (7, words(4, 60_000)), (8, " \n\t "),
]


def frame(spark, rows=ROWS):
    data = [(i, t, "en", "s", len(t or ""), 0.9, False, 1, "r", 7) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def rows_of(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_near_dedup_keeps_one_row_of_each_id(spark, sf_dir):
    got = rows_of(corpus_pipeline.near_dedup_stage(spark, frame(spark), sf_dir))
    want = [(1, LONG), (4, min(words(2, 300), words(3, 300))), (5, None), (6, ""), (None, LONG), (None, LONG), (None, None), (7, ROWS[12][1]), (8, " \n\t ")]
    assert got == sorted(want, key=str)


def test_near_dedup_links_from_eighty_percent(spark, sf_dir):
    text = words(9, 900)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    a, b = shingles(text), shingles(near(text, 48))
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    got = rows_of(corpus_pipeline.near_dedup_stage(spark, frame(spark, [(1, text), (2, near(text, 48)), (3, near(text, 20))]), sf_dir))
    assert [r[0] for r in got] == [1, 3]


def test_quality_toxicity_and_substrings(spark, sf_dir):
    assert rows_of(corpus_pipeline.toxicity_stage(spark, frame(spark), sf_dir)) == sorted(ROWS, key=str)  # no labels
    fine = [r for r in ROWS if r[1] and len(r[1].split()) >= 50]
    assert rows_of(corpus_pipeline.quality_stage(spark, frame(spark), sf_dir)) == sorted(fine, key=str)
    left = rows_of(corpus_pipeline.substring_stage(spark, frame(spark), sf_dir))
    assert len(left) == len(ROWS)
    kept = {(i, len((t or "").split())) for i, t in left}
    assert {(1, 400), (2, 0), (None, 400), (4, 300), (5, 0), (6, 0), (7, 60_000)} <= kept


def test_packing_of_odd_rows(spark, sf_dir):
    pieces = corpus_pipeline.packing_stage(spark, frame(spark), sf_dir).collect()
    ends = [p for p in pieces if p.doc_tokens == 1]
    assert sorted((p.doc_id for p in ends), key=str) == sorted([5, 6, 6, None], key=str)
    assert sum(p.length for p in pieces if p.start == 0 and p.doc_id == 1) > 0
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)


def test_empty_tables(spark, sf_dir):
    docs = frame(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
