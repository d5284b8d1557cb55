"""Train / validation / test splits and samples.

All random choices order rows by a seeded hash, so a result does not depend on
partitions, and ranks are counted over hash ranges instead of in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.operators.joins import join_checked
from wavequery.operators.ranking import hash_ranked, hash_unit, seeded_unit
from wavequery.operators.selection import first_n

SUBSETS = ("train", "val", "test")


def hash_split(rows: DataFrame, keys: Sequence[str], val: float, test: float, out: str = "subset") -> DataFrame:
    """Stable split from sha1 of the key columns joined by a pipe."""
    unit = hash_unit(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    subset = F.when(unit < val, "val").when(unit < val + test, "test").otherwise("train")
    return rows.withColumn(out, subset)


def _cut(rank, n_test, n_val):
    return F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")


def group_split(
    rows: DataFrame,
    group: str | Sequence[str],
    test: float,
    val: float,
    seed: int = 42,
    val_of: str = "total",
    out: str = "subset",
) -> DataFrame:
    """Whole groups go to one subset; test takes ``ceil(test * groups)`` groups.

    ``group`` may list columns, of which the first that is not null counts, such as an event hint, else the
    file, else the row's key. Rows without any form one group. ``val_of`` says whether ``val`` is a share of all groups or of the rest after test.
    """
    if val_of not in ("total", "rest"):
        raise ValueError("val_of must be 'total' or 'rest'")
    names = [group] if isinstance(group, str) else list(group)
    placed = rows.withColumn("_group_key", F.coalesce(*[F.col(c).cast("string") for c in names], F.lit("")))
    groups = placed.select("_group_key").distinct().withColumn("_u", seeded_unit("_group_key", seed))
    ranked = hash_ranked(groups, "_u", ["_group_key"], out="_rank")
    share = val / max(1e-12, 1.0 - test) if val_of == "total" else val
    n_groups = F.col("_rank_total")
    n_test = F.ceil(F.lit(test) * n_groups)
    n_val = F.ceil(F.lit(share) * (n_groups - n_test))
    subsets = ranked.select("_group_key", _cut(F.col("_rank"), n_test, n_val).alias(out))
    return join_checked(placed, subsets, ["_group_key"]).drop("_group_key")


def random_split(rows: DataFrame, key: str, test: float, val: float, seed: int = 42, out: str = "subset") -> DataFrame:
    """Split by row: ``round(test * n)`` rows to test, ``round(val * rest)`` rows to val.

    ``key`` identifies a row. Only the two cut points are computed; rows stay in place.
    """
    keyed = rows.withColumn("_u", seeded_unit(key, seed))
    n = rows.count()
    n_test = round(test * n)
    n_val = round(val * (n - n_test))
    in_test = first_n(keyed, "_u", key, n_test)
    in_val = first_n(keyed, "_u", key, n_test + n_val)
    return keyed.withColumn(out, F.when(in_test, "test").when(in_val, "val").otherwise("train")).drop("_u")


def minimum_moves(counts: dict[str, int], minimum: dict[str, int]) -> list[tuple[str, str, int]]:
    """Moves ``(source, target, rows)`` that bring every subset to its minimum, as far as rows allow.

    What subsets have beyond their minimum is handed out once, the largest surplus to the largest need. If
    that leaves a needy subset empty, it gets one row of the largest subset.
    """
    held = {s: counts.get(s, 0) for s in SUBSETS}
    spare = sorted((held[s] - minimum[s], s) for s in SUBSETS if held[s] > minimum[s])
    needs = sorted((minimum[s] - held[s], s) for s in SUBSETS if held[s] < minimum[s])
    moves = []

    def move(source: str, target: str, rows: int) -> None:
        moves.append((source, target, rows))
        held[source] -= rows
        held[target] += rows

    while spare and needs:
        (over, source), (short, target) = spare.pop(), needs.pop()
        move(source, target, min(over, short))
        spare += [(over - short, source)] if over > short else []
        needs += [(short - over, target)] if short > over else []
    for _, target in needs:
        largest = max(held, key=held.get)
        if not held[target] and held[largest] > 1:
            move(largest, target, 1)
    return moves


def enforce_minimums(
    rows: DataFrame, key: str, minimum: dict[str, int], subset: str = "subset", seed: int = 42
) -> DataFrame:
    """Reassign rows so that every subset has its minimum, as far as rows allow.

    Only three counts and one cut point per move reach the driver. Moved rows are the
    first of the source subset by seeded hash.
    """
    counts = {r[subset]: r["count"] for r in rows.groupBy(subset).count().collect()}
    keyed = rows
    for step, (source, target, k) in enumerate(minimum_moves(counts, minimum)):
        keyed = keyed.withColumn("_u", seeded_unit(key, seed + step))
        in_source = F.col(subset) == source
        moved = in_source & first_n(keyed.where(in_source), "_u", key, k)
        keyed = keyed.withColumn(subset, F.when(moved, target).otherwise(F.col(subset))).drop("_u")
    return keyed


def _class_counts(rows: DataFrame, label: str) -> tuple[int, int]:
    counts = {int(r[label]): r["count"] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    return counts.get(1, 0), counts.get(0, 0)


def downsample(
    rows: DataFrame,
    key: str,
    label: str = "label",
    *,
    max_pos: int | None,
    neg_per_pos: int | None,
    seed: int = 42,
) -> DataFrame:
    """At most ``max_pos`` positives and ``neg_per_pos`` negatives per kept positive.

    None sets no limit. Without positives the rows are returned as they are.
    """
    n_pos, n_neg = _class_counts(rows, label)
    if not n_pos:
        return rows
    keyed = rows.withColumn("_u", seeded_unit(key, seed))
    positive, negative = F.col(label) == 1, F.col(label) == 0
    kept = n_pos if max_pos is None else min(n_pos, max_pos)
    wanted = n_neg if neg_per_pos is None else min(n_neg, kept * neg_per_pos)
    keep_pos = positive if kept == n_pos else positive & first_n(keyed.where(positive), "_u", key, kept)
    keep_neg = negative if wanted == n_neg else negative & first_n(keyed.where(negative), "_u", key, wanted)
    return keyed.where(keep_pos | keep_neg).drop("_u")


def stratified_sample(
    rows: DataFrame,
    key: str,
    label: str = "label",
    *,
    neg_per_pos: int,
    cap: int,
    seed: int = 42,
) -> DataFrame:
    """All positives, ``neg_per_pos`` negatives per positive up to ``cap``, topped up from the rest.

    Adds ``tier``: ``pos``, ``neg`` or ``top_up``. Without positives the first ``cap`` rows.
    """
    n_pos, n_neg = _class_counts(rows, label)
    keyed = rows.withColumn("_u", seeded_unit(key, seed))
    positive, negative = F.col(label) == 1, F.col(label) == 0
    room = min(n_neg, max(cap - n_pos, 0))
    sampled = min(room, neg_per_pos * n_pos)
    below = keyed.where(negative)
    in_sample = negative if sampled == n_neg else negative & first_n(below, "_u", key, sampled)
    in_room = negative if room == n_neg else negative & first_n(below, "_u", key, room)
    tier = F.when(positive, "pos").when(in_sample, "neg").when(in_room, "top_up")
    return keyed.withColumn("tier", tier).where("tier is not null").drop("_u")


def split_restore(
    base: DataFrame,
    sidecar: DataFrame,
    keys: Sequence[str],
    out: str = "split",
    default: str = "train",
    order: Sequence[str] = ("test", "val", "train"),
) -> DataFrame:
    """Attach the saved split by key; rows without one go to ``default``.

    A key that was saved with several splits gets the one that comes first in ``order``, so that what was ever tested is not
    trained on; other names come last, by name.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(out))
    ranked = F.struct(F.when(place == 0, len(order) + 1).otherwise(place).alias("place"), F.col(out).alias("name"))
    saved = sidecar.where(F.col(out).isNotNull()).groupBy(*keys).agg(F.min(ranked)["name"].alias(out))
    return base.drop("split", "subset").join(saved, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(default)))


def ensure_split(
    rows: DataFrame, group: str, key: str, test: float, val: float, seed: int = 42, subset: str = "subset"
) -> DataFrame:
    """Keep a split whose three subsets all have rows; else split by group, else by row.

    ``key`` identifies a row. Too few groups for three subsets lead to the split by row.
    """

    def complete(df: DataFrame) -> bool:
        present = {r[subset] for r in df.select(subset).distinct().limit(len(SUBSETS) + 1).collect()}
        return set(SUBSETS) <= present

    if subset in rows.columns:
        if complete(rows):
            return rows
        rows = rows.drop(subset)
    grouped = group_split(rows, group, test, val, seed, out=subset)
    return grouped if complete(grouped) else random_split(rows, key, test, val, seed, subset)
