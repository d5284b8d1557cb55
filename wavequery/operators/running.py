"""Running aggregates over a global or per-key order without a single-task window.

``Window.orderBy`` alone moves a whole key to one task. The operators here cut the
order into buckets first, so that every task holds one bucket, and add the
aggregate of the earlier buckets as a carry:

* bucket totals (a map-side combined aggregate, one row per bucket),
* a running aggregate over that small table,
* the running aggregate inside each bucket, combined with the carry.

Bucket edges that come from data are read once on the driver as literals. They
stay the same if a lost executor makes Spark recompute a stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
KEY = "_by"

_REDUCE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def default_buckets(df: DataFrame) -> int:
    """Two order buckets per shuffle partition."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def range_edges(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Row-balanced bucket edges of a numeric column (at most ``buckets - 1`` doubles)."""
    buckets = buckets or default_buckets(df)
    if buckets < 2:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    edges = df.approxQuantile(column, probabilities, 0.5 / buckets)
    return sorted(set(edges))


def with_range_bucket(df: DataFrame, column: str, edges: Sequence[float], out: str = BUCKET) -> DataFrame:
    """Add the index of the range ``[edge[i-1], edge[i])`` that holds ``column``."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    binned = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")],
        inputCol="_as_double",
        outputCol="_range",
        handleInvalid="keep",
    ).transform(df.withColumn("_as_double", F.col(column).cast("double")))
    # Rows without a value sort first, so they go before the first range.
    return binned.withColumn(out, F.coalesce(F.col("_range").cast("int"), F.lit(-1))).drop("_range", "_as_double")


def with_hash_bucket(df: DataFrame, unit: str, buckets: int | None = None, out: str = BUCKET) -> DataFrame:
    """Bucket a value that is uniform on [0, 1): equal-width ranges are balanced already."""
    buckets = buckets or default_buckets(df)
    return df.withColumn(out, F.least(F.floor(F.col(unit) * buckets), F.lit(buckets - 1)).cast("int"))


def running(
    df: DataFrame,
    order: str | Sequence[str],
    values: Mapping[str, tuple[str, Column | str]],
    by: Sequence[str] = (),
    bucket: str = BUCKET,
    descending: bool = False,
    exclusive: bool = False,
    totals: bool = False,
    fanout: int | None = None,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``count`` along ``order``.

    ``bucket`` must grow with the first order column inside each ``by`` key.
    ``exclusive`` leaves the current row out. ``totals`` also adds ``<name>_total``,
    the aggregate over the whole ``by`` key. ``fanout`` is for keys with very many
    buckets, such as the chunks of one long file: the carry is then itself computed
    over groups of that many buckets.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    # Keys travel as one struct: structs with null fields are equal, so a null key meets its carry.
    keyed = df.withColumn(KEY, F.struct(*by)) if by else df
    key = [KEY] if by else []
    names = list(values)
    inputs = {n: F.col(c) if isinstance(c, str) else c for n, (_, c) in values.items()}
    reduce_fn = {n: _REDUCE[fn] for n, (fn, _) in values.items()}
    combine = {n: "sum" if fn in ("sum", "count") else fn for n, (fn, _) in values.items()}

    per_bucket = keyed.groupBy(*key, bucket).agg(*[reduce_fn[n](inputs[n]).alias(f"_in_{n}") for n in names])

    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    if fanout:
        grouped = per_bucket.withColumn("_group", F.floor(F.col(bucket) / fanout))
        carry = running(
            grouped, bucket, {f"_carry_{n}": (combine[n], f"_in_{n}") for n in names}, key, "_group", descending, True, totals
        )
        renamed = [F.col(f"_carry_{n}_total").alias(f"{n}_total") for n in names] if totals else []
        carry = carry.select(*key, bucket, *[f"_carry_{n}" for n in names], *renamed)
    else:
        before = Window.partitionBy(*key).orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*key)
        carry_columns = [_REDUCE[combine[n]](f"_in_{n}").over(before).alias(f"_carry_{n}") for n in names]
        if totals:
            carry_columns += [_REDUCE[combine[n]](f"_in_{n}").over(whole).alias(f"{n}_total") for n in names]
        carry = per_bucket.select(*key, bucket, *carry_columns)
    if not by:
        # One row per bucket and the bucket count is a literal: safe to broadcast.
        carry = F.broadcast(carry)

    last = -1 if exclusive else Window.currentRow
    inside = (
        Window.partitionBy(*key, bucket)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, last)
    )
    local = keyed.select("*", *[reduce_fn[n](inputs[n]).over(inside).alias(f"_local_{n}") for n in names])
    # A left join: it neither drops null keys nor adds a filter that would keep the
    # shuffle of the rows from being shared with that of the bucket totals.
    joined = local.join(carry, [*key, bucket], "left")

    def merged(n: str) -> Column:
        mine, earlier = F.col(f"_local_{n}"), F.col(f"_carry_{n}")
        if combine[n] == "sum":
            return F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        if combine[n] == "max":
            return F.when(earlier.isNull() | (mine > earlier), F.coalesce(mine, earlier)).otherwise(earlier)
        return F.when(earlier.isNull() | (mine < earlier), F.coalesce(mine, earlier)).otherwise(earlier)

    keep = [F.col(KEY)[c].alias(c) if c in by else F.col(c) for c in df.columns]
    keep += [merged(n).alias(n) for n in names]
    if totals:
        keep += [F.col(f"{n}_total") for n in names]
    return joined.select(*keep)


def exact_quantiles(df: DataFrame, column: str, probabilities: Mapping[str, float], edges=None) -> DataFrame:
    """One row of exact, linearly interpolated quantiles, computed over distributed ranks."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    edges = range_edges(df, column) if edges is None else edges
    ranked = running(with_range_bucket(counts, "_v", edges), "_v", {"_cum": ("sum", "_n")}, totals=True)
    picks = []
    for name, q in probabilities.items():
        position = F.lit(float(q)) * (F.col("_cum_total") - 1)
        lower = F.min(F.when(F.col("_cum") > F.floor(position), F.col("_v")))
        upper = F.min(F.when(F.col("_cum") > F.ceil(position), F.col("_v")))
        fraction = F.max(position - F.floor(position))
        picks.append((lower + fraction * (upper - lower)).alias(name))
    return ranked.agg(*picks)
