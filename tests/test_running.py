import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequery.operators import running as rn
from wavequery.operators import selection
from wavequery.operators.ranking import seeded_unit


def frame(seed=1, n=500):
    rng = np.random.default_rng(seed)
    # One key holds most rows.
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)),
            "t": rng.permutation(n).astype("int64"),
            "v": rng.integers(-5, 9, n).astype("int64"),
        }
    )


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_matches_pandas(spark, by, descending):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    binned = rn.with_range_bucket(df, "t", rn.range_edges(df, "t", 7))
    got = rn.running(
        binned, "t", {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "n": ("count", "v")},
        by=by, descending=descending, totals=True,
    ).toPandas().sort_values("t")
    ordered = pdf.sort_values("t", ascending=not descending)
    group = ordered.groupby(by) if by else ordered.assign(_g=0).groupby("_g")
    want = ordered.assign(
        s=group["v"].cumsum(), hi=group["v"].cummax(), lo=group["v"].cummin(), n=group.cumcount() + 1,
        s_total=group["v"].transform("sum"),
    ).sort_values("t")
    for c in ("s", "hi", "lo", "n", "s_total"):
        assert got[c].tolist() == want[c].tolist(), c


def test_exclusive(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "t long, v long")
    binned = rn.with_range_bucket(df, "t", [5.0, 12.0])
    got = {r["t"]: r["s"] for r in rn.running(binned, "t", {"s": ("sum", "v")}, exclusive=True).collect()}
    assert got == {i: sum(range(i)) for i in range(20)}


def test_result_does_not_depend_on_buckets_or_partitions(spark):
    df = spark.createDataFrame(frame(2))
    seen = set()
    for parts, buckets in ((1, 1), (4, 3), (16, 40)):
        d = df.repartition(parts)
        out = rn.running(rn.with_range_bucket(d, "t", rn.range_edges(d, "t", buckets)), "t", {"s": ("sum", "v")})
        seen.add(tuple(r["s"] for r in out.orderBy("t").collect()))
    assert len(seen) == 1


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.95, 0.999, 1.0])
def test_exact_quantiles(spark, q):
    values = np.round(np.random.default_rng(3).normal(size=401), 2)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    assert rn.exact_quantiles(df, "v", {"q": q}).first()["q"] == pytest.approx(np.quantile(values, q))


def test_hot_value_is_one_edge(spark):
    df = spark.createDataFrame([(7.0,)] * 300 + [(float(i),) for i in range(30)], "v double")
    edges = rn.range_edges(df, "v", 16)
    assert edges == sorted(set(edges))


@pytest.mark.parametrize("n", [1, 7, 500, 999, 1000, 1001])
def test_nth_smallest(spark, n, monkeypatch):
    monkeypatch.setattr(selection, "FANOUT", 4)
    monkeypatch.setattr(selection, "SORT_LIMIT", 10)
    df = spark.range(1000).withColumn("u", seeded_unit("id", 9))
    order = sorted((r["u"], r["id"]) for r in df.collect())
    assert selection.nth_smallest(df, "u", "id", n) == (order[n - 1] if n <= 1000 else None)
    assert df.where(selection.first_n(df, "u", "id", n)).count() == min(n, 1000)


def test_seeded_unit_matches_hashlib(spark):
    import hashlib

    got = spark.range(5).select(seeded_unit("id", 42).alias("u")).collect()
    for i, row in enumerate(got):
        head = hashlib.sha1(f"{i}|42".encode()).digest()[:8]
        assert row["u"] == int.from_bytes(head, "big") / 2**64


@pytest.mark.parametrize("descending", [False, True])
def test_fanout_gives_the_same_carry(spark, descending):
    pdf = frame(5, 300)
    pdf["c"] = pdf["t"] // 7
    df = spark.createDataFrame(pdf)
    spec = {"s": ("sum", "v"), "hi": ("max", "v")}
    plain = rn.running(df, "t", spec, by=["k"], bucket="c", descending=descending, totals=True)
    deep = rn.running(df, "t", spec, by=["k"], bucket="c", descending=descending, totals=True, fanout=4)
    assert plain.orderBy("t").collect() == deep.select(*plain.columns).orderBy("t").collect()


def test_null_order_and_null_key_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, "a"), (2.0, 1, None), (1.0, 1, "a")], "x double, v long, k string")
    binned = rn.with_range_bucket(df, "x", [1.5])
    assert rn.running(binned, "x", {"s": ("sum", "v")}, by=["k"]).count() == 3
    assert {r["x"]: r["s"] for r in rn.running(binned, "x", {"s": ("sum", "v")}).collect()} == {None: 1, 1.0: 2, 2.0: 3}


@pytest.mark.parametrize("limit", [100, 2])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_checked_both_ways(spark, limit, how):
    from wavequery.operators.joins import join_checked

    rows = spark.range(20).withColumn("k", F.col("id") % 5)
    small = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, s string")
    got = join_checked(rows, small, ["k"], how, limit)
    assert sorted((r["id"], r["s"] or "") for r in got.collect()) == sorted(
        (r["id"], r["s"] or "") for r in rows.join(small, "k", how).collect()
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) or limit == 2
