"""Split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequery.operators import splits as sp
from wavequery.plans import stand_ins as si
from wavequery.plans.registry import query
from wavequery.plans.split_sql import HASH_SPLIT_CASE, UNIT_SQL, hash_subset

TEST, VAL, SEED = 0.18, 0.18, 42


def unit_sql(key: str, seed: int = SEED) -> str:
    return UNIT_SQL.format(text=f"CAST({key} AS VARCHAR) || '|{seed}'")


@query("hash_split", f"WITH {si.EVENT_SCORES_SQL} SELECT event_id, {HASH_SPLIT_CASE} AS subset FROM event_scores")
def hash_split(spark, sf_dir):
    return hash_subset(si.event_scores(spark, sf_dir)).select("event_id", "subset")


def group_sql(val_expr: str) -> str:
    return f"""WITH g AS (SELECT DISTINCT o_custkey FROM orders),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY {unit_sql('o_custkey')}, o_custkey) AS rk, count(*) OVER () AS n FROM g),
c AS (SELECT *, ceil({TEST}::DOUBLE * n) AS n_test FROM r),
s AS (SELECT o_custkey, CASE WHEN rk <= n_test THEN 'test'
                             WHEN rk <= n_test + ceil({val_expr} * (n - n_test)) THEN 'val' ELSE 'train' END AS subset FROM c)
SELECT o_orderkey, o_custkey, subset FROM orders JOIN s USING (o_custkey)"""


@query("group_split", group_sql(f"({VAL}::DOUBLE / (1.0::DOUBLE - {TEST}::DOUBLE))"))
def group_split(spark, sf_dir):
    orders = si.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sp.group_split(orders, "o_custkey", TEST, VAL, SEED).select("o_orderkey", "o_custkey", "subset")


@query("group_split_rest", group_sql(f"{VAL}::DOUBLE"))
def group_split_rest(spark, sf_dir):
    orders = si.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sp.group_split(orders, "o_custkey", TEST, VAL, SEED, val_of="rest").select("o_orderkey", "o_custkey", "subset")


RANDOM_SQL = f"""r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {unit_sql('o_orderkey')}, o_orderkey) AS rk,
                             count(*) OVER () AS n FROM orders),
c AS (SELECT *, round_even({TEST}::DOUBLE * n, 0) AS n_test FROM r),
rs AS (SELECT o_orderkey, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + round_even({VAL}::DOUBLE * (n - n_test), 0) THEN 'val'
                          ELSE 'train' END AS subset FROM c)"""


@query("random_split", f"WITH {RANDOM_SQL} SELECT o_orderkey, subset FROM rs")
def random_split(spark, sf_dir):
    orders = si.table(spark, sf_dir, "orders").select("o_orderkey")
    return sp.random_split(orders, "o_orderkey", TEST, VAL, SEED)


@query(
    "split_minimums",
    f"""WITH base AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'train' ELSE 'test' END AS subset FROM orders),
n AS (SELECT count(*) FILTER (subset = 'train') AS tr, count(*) FILTER (subset = 'test') AS te FROM base),
goal AS (SELECT CAST(floor((tr + te) * 0.1::DOUBLE) AS BIGINT) AS v FROM n),
m1 AS (SELECT o_orderkey, row_number() OVER (ORDER BY {unit_sql('o_orderkey', SEED)}, o_orderkey) AS rk FROM base WHERE subset = 'test')
SELECT b.o_orderkey, CASE WHEN m1.rk <= goal.v THEN 'val' ELSE b.subset END AS subset
FROM base b LEFT JOIN m1 ON m1.o_orderkey = b.o_orderkey CROSS JOIN goal""",
)
def split_minimums(spark, sf_dir):
    orders = si.table(spark, sf_dir, "orders")
    subset = F.when(F.col("o_orderpriority") == "1-URGENT", "train").otherwise("test")
    base = orders.select("o_orderkey", subset.alias("subset"))
    tenth = int(orders.count() * 0.1)
    return sp.enforce_minimums(base, "o_orderkey", {"train": tenth, "val": tenth, "test": tenth}, seed=SEED)


ORDER_LABELS_SQL = "base AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 450000 THEN 1 ELSE 0 END AS label FROM orders)"


def order_labels(spark, sf_dir):
    rare = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450_000)
    return si.table(spark, sf_dir, "orders").select("o_orderkey", F.when(rare, 1).otherwise(0).alias("label"))


@query(
    "downsample",
    f"""WITH {ORDER_LABELS_SQL}, n AS (SELECT count(*) FILTER (label = 1) AS p FROM base),
r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {unit_sql('o_orderkey')}, o_orderkey) AS rk FROM base)
SELECT o_orderkey, label FROM r CROSS JOIN n
WHERE (label = 1 AND rk <= least(p, 50)) OR (label = 0 AND rk <= least(p, 50) * 20)""",
)
def downsample(spark, sf_dir):
    return sp.downsample(order_labels(spark, sf_dir), "o_orderkey", max_pos=50, neg_per_pos=20, seed=SEED)


@query(
    "stratified_sample",
    f"""WITH {ORDER_LABELS_SQL}, n AS (SELECT count(*) FILTER (label = 1) AS p FROM base),
r AS (SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {unit_sql('o_orderkey')}, o_orderkey) AS rk FROM base),
t AS (SELECT o_orderkey, label, CASE WHEN label = 1 THEN 'pos' WHEN rk <= least(p * 10, greatest(5000 - p, 0)) THEN 'neg'
                                     WHEN rk <= greatest(5000 - p, 0) THEN 'top_up' END AS tier FROM r CROSS JOIN n)
SELECT o_orderkey, label, tier FROM t WHERE tier IS NOT NULL""",
)
def stratified_sample(spark, sf_dir):
    return sp.stratified_sample(order_labels(spark, sf_dir), "o_orderkey", neg_per_pos=10, cap=5_000, seed=SEED)


@query(
    "freeze_split",
    f"""WITH {RANDOM_SQL},
base AS (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem),
kept AS (SELECT o_orderkey, subset AS split FROM rs JOIN orders USING (o_orderkey) WHERE o_orderstatus <> 'F')
SELECT b.o_orderkey, b.l_partkey, coalesce(k.split, 'train') AS split FROM base b LEFT JOIN kept k ON k.o_orderkey = b.o_orderkey""",
)
def freeze_split(spark, sf_dir):
    base = si.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct()
    open_orders = si.table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey")
    sidecar = random_split(spark, sf_dir).withColumnRenamed("subset", "split").join(open_orders, "o_orderkey", "left_semi")
    return sp.split_restore(base, sidecar, ["o_orderkey"])
