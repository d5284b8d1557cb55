"""Joins on time: interval overlap, band, nearest, one-to-one matching, time slides.

No operator here plans a nested loop over two tables, and none keeps a whole key
or a whole time bucket in one task: joins are equalities on a time cell, ordered
work goes through :mod:`wavequery.operators.running`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.operators.joins import join_checked
from wavequery.operators.running import range_edges, running, with_range_bucket
from wavequery.session import cut_lineage

# A time bucket is hot when it holds more than this share of its table, so at
# most 1 / HOT_SHARE buckets can be hot and their list is small by construction.
HOT_SHARE = 1.0 / 512
HOT_MIN_ROWS = 10_000
SALTS = 16

# Most time cells a catalogue time may be copied to.
MAX_REACH = 64

# Times of one sorted array, and pairs that a task holds at once.
CHUNK_TIMES = 16_384
PAIRS_AT_ONCE = 1_000_000

# Row-balanced bins of the scores of a side; pairs of bins are counted without a look at their pairs.
SCORE_BINS = 128

# Slides that share the arrays of one job, and pairs of chunks with their slides that a task works on.
JOB_SLIDES = 20
TASK_JOBS = 4

# Target rows of one task of the one-to-one matching.
MATCH_ROWS = 100_000


# --- interval overlap ---------------------------------------------------------


def interval_label(
    windows: DataFrame,
    catalog: DataFrame,
    pre_us: int,
    pos_us: int,
    length_range_us: tuple[int, int] | None = None,
    start: str = "start_us",
    end: str = "end_us",
    tc: str = "tc_us",
    label: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """Label 1 when some catalogue time has ``end >= tc - pre`` and ``start <= tc + pos``.

    The catalogue is reduced to time cells no longer than the shortest padded
    window. A padded window ``[start - pos, end + pre]`` then leaves its first cell,
    so it holds a catalogue time exactly if the latest time of the first cell or
    the earliest time of the later cells lies inside. That is one lookup on a
    unique cell: windows are not copied and the result needs no de-duplication.

    Windows of very different lengths would need many cells per catalogue time; those are
    labelled by the next catalogue time after their start instead.

    ``by`` adds equality keys, such as an event hint, for the restricted variant.
    """
    length = F.col(end) - F.col(start)
    stated = length_range_us
    if stated is None:
        row = windows.agg(F.min(length).alias("lo"), F.max(length).alias("hi")).first()
        if row["lo"] is None:
            return windows.withColumn(label, F.lit(0))
        length_range_us = (row["lo"], row["hi"])
    shortest = length_range_us[0] + pre_us + pos_us
    longest = length_range_us[1] + pre_us + pos_us
    if shortest <= 0:
        raise ValueError("windows with their margins must have a positive length")
    reach = -(-longest // shortest)
    by = list(by)
    if reach > MAX_REACH:
        return _label_by_next(windows, catalog, pre_us, pos_us, start, end, tc, label, by)

    cells = (
        catalog.select(*by, F.col(tc).alias("_tc"), F.floor(F.col(tc) / shortest).cast("long").alias("_home"))
        .groupBy(*by, "_home")
        .agg(F.min("_tc").alias("_first"), F.max("_tc").alias("_last"))
        .withColumn("_cell", F.explode(F.sequence(F.col("_home") - reach, F.col("_home"))))
        .groupBy(*by, "_cell")
        .agg(
            F.max(F.when(F.col("_cell") == F.col("_home"), F.col("_last"))).alias("_latest_here"),
            F.min(F.when(F.col("_cell") < F.col("_home"), F.col("_first"))).alias("_earliest_later"),
        )
    )
    lower, upper = F.col(start) - pos_us, F.col(end) + pre_us
    hit = F.coalesce(F.col("_latest_here") >= lower, F.lit(False)) | F.coalesce(
        F.col("_earliest_later") <= upper, F.lit(False)
    )
    placed = windows.withColumn("_cell", F.floor(lower / shortest).cast("long"))
    looked_up = join_checked(placed, cells, [*by, "_cell"], "left")
    if stated is not None:
        # The cells are right only for windows of the stated lengths.
        wrong = F.raise_error(F.concat(F.lit("window length outside length_range_us: "), length.cast("string")))
        hit = F.when((length < stated[0]) | (length > stated[1]), wrong).otherwise(hit)
    return looked_up.withColumn(label, hit.cast("int")).drop("_cell", "_latest_here", "_earliest_later")


def _label_by_next(windows, catalog, pre_us, pos_us, start, end, tc, label, by) -> DataFrame:
    """Label from the first catalogue time at or after ``start - pos``, found on one ordered line."""
    placed = windows.withColumn("_lower", F.col(start) - pos_us)
    lowers = placed.select(*by, F.col("_lower").alias("x"), F.lit(0).alias("kind")).distinct()
    times = catalog.select(*by, F.col(tc).alias("x"), F.lit(1).alias("kind")).distinct()
    line = lowers.unionByName(times)
    line = with_range_bucket(line, "x", range_edges(line, "x"))
    mark = F.when(F.col("kind") == 1, F.col("x"))
    line = running(line, ["x", "kind"], {"_next": ("min", mark)}, by=by, descending=True)
    nearest = line.where("kind = 0").select(*by, F.col("x").alias("_lower"), "_next")
    hit = F.coalesce(F.col("_next") <= F.col(end) + pre_us, F.lit(False))
    return placed.join(nearest, [*by, "_lower"], "left").withColumn(label, hit.cast("int")).drop("_lower", "_next")


def range_probe(ranges: DataFrame, catalog: DataFrame, cell_us: int, lo: str, hi: str, tc: str = "tc_us") -> DataFrame:
    """Every (range, catalogue time) with ``lo <= tc <= hi``, both ends included.

    A range is copied once per time cell it touches, a catalogue time is in one cell.
    Cells with an outsize share of the rows are split on both sides.
    """
    spread = ranges.withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col(lo) / cell_us).cast("long"), F.floor(F.col(hi) / cell_us).cast("long"))),
    )
    keyed = catalog.withColumn("_cell", F.floor(F.col(tc) / cell_us).cast("long"))
    return _salted_cell_join(spread, keyed).where(F.col(tc).between(F.col(lo), F.col(hi)))


def _salted_cell_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on ``_cell``. Hot cells are split on both sides: a row gets one of ``SALTS`` own
    salts and is copied to every salt of the other side, so each pair meets exactly once
    while no task holds the whole cell."""
    per_cell = left.select("_cell").unionByName(right.select("_cell")).groupBy("_cell").count()
    total = per_cell.agg(F.sum("count")).scalar()
    # At most 1 / HOT_SHARE cells pass this test whatever the table size.
    hot = per_cell.where((F.col("count") > total * HOT_SHARE) & (F.col("count") > HOT_MIN_ROWS))
    hot = F.broadcast(hot.select("_cell", F.lit(SALTS).alias("_salts")))

    def salted(rows: DataFrame, own: str, other: str) -> DataFrame:
        salts = F.coalesce(F.col("_salts"), F.lit(1))
        return (
            rows.join(hot, "_cell", "left")
            .withColumn(own, F.pmod(F.xxhash64(*rows.columns), salts).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), salts - 1)))
            .drop("_salts")
        )

    keys = ["_cell", "_ls", "_rs"]
    return salted(left, "_ls", "_rs").join(salted(right, "_rs", "_ls"), keys).drop(*keys)


# --- band join ----------------------------------------------------------------


def band_join(left: DataFrame, right: DataFrame, dt_us: int, left_time: str, right_time: str) -> DataFrame:
    """All pairs with ``|left_time - right_time| <= dt``.

    The left row looks into three cells of width ``dt``; hot cells are split.
    """
    width = max(int(dt_us), 1)
    right = right.withColumn("_cell", F.floor(F.col(right_time) / width).cast("long"))
    home = F.floor(F.col(left_time) / width).cast("long")
    probe = left.withColumn("_cell", F.explode(F.sequence(home - 1, home + 1)))
    near = F.abs(F.col(left_time) - F.col(right_time)) <= dt_us
    return _salted_cell_join(probe, right).where(near)


def every_slide(slides: DataFrame):
    """All slides as one array column, for an explode; a slide table has a row per slide, whatever the data."""
    return F.explode(slides.agg(F.sort_array(F.collect_list(F.struct("slide_id", "shift_us")))).scalar())


def _time_chunks(rows: DataFrame, values: Sequence[str], edges: Sequence[float], side: str) -> DataFrame:
    """Rows ``(t, values...)`` as sorted arrays of at most about ``CHUNK_TIMES`` rows: chunk id, range, first and last time.

    A range that one time fills beyond that is dealt to several chunks.
    """
    placed = with_range_bucket(rows, "t", edges)
    sizes = placed.groupBy("_bucket").agg(F.ceil(F.count("*") / CHUNK_TIMES).cast("int").alias("_parts")).where("_parts > 1")
    placed = placed.join(sizes, "_bucket", "left")
    part = F.pmod(F.xxhash64("t", *values), F.coalesce("_parts", F.lit(1))).cast("int")
    chunks = placed.withColumn("_part", part).groupBy("_bucket", "_part").agg(
        F.min("t").alias(f"{side}_lo"), F.max("t").alias(f"{side}_hi"), F.sort_array(F.collect_list(F.struct("t", *values))).alias("_c")
    )
    arrays = [F.col(f"_c.{c}").alias(f"{side}_{c}") for c in ("t", *values)]
    ids = [F.col(c).alias(f"{side}{c}") for c in ("_bucket", "_part")]
    return chunks.select(*ids, f"{side}_lo", f"{side}_hi", *arrays)


def _chunk_pairs(left: DataFrame, right: DataFrame, dt_us: int, slides: DataFrame, values: Sequence[str]) -> DataFrame:
    """Chunks of both sides that meet under some slide, with at most ``JOB_SLIDES`` of those slides.

    Every pair of rows is in one pair of chunks. A row is much work and few bytes, so rows are dealt out by their number.
    """
    n = left.count() + right.count()
    both = left.select("t").unionByName(right.select("t"))
    edges = range_edges(both, "t", max(1, -(-n // CHUNK_TIMES)))
    # Chunks are stored once: their few outer numbers choose the partners, then their arrays travel.
    a = cut_lineage(_time_chunks(left, values, edges, "l"))
    b = cut_lineage(_time_chunks(right, values, edges, "r"))
    ids = ["l_bucket", "l_part"]
    wanted = a.select(*ids, "l_lo", "l_hi", every_slide(slides).alias("s"))
    wanted = wanted.select(*ids, "s", (F.col("l_lo") - F.col("s.shift_us") - dt_us).alias("lo"), (F.col("l_hi") - F.col("s.shift_us") + dt_us).alias("hi"))
    wanted = with_range_bucket(with_range_bucket(wanted, "lo", edges, "_first"), "hi", edges, "_last")
    near = wanted.select(*ids, "s", "lo", "hi", F.explode(F.sequence("_first", "_last")).alias("r_bucket"))
    near = near.join(b.select("r_bucket", "r_part", "r_lo", "r_hi"), "r_bucket").where("r_lo <= hi AND r_hi >= lo")
    met = near.groupBy(*ids, "r_bucket", "r_part").agg(F.sort_array(F.collect_list("s")).alias("slides"))
    groups = F.explode(F.sequence(F.lit(1), F.size("slides"), F.lit(JOB_SLIDES))).alias("_at")
    met = met.select(*ids, "r_bucket", "r_part", "slides", groups).withColumn("slides", F.slice("slides", F.col("_at"), F.lit(JOB_SLIDES))).drop("_at")
    met = cut_lineage(met)
    jobs = met.join(a.drop("l_lo", "l_hi"), ids).join(b.drop("r_lo", "r_hi"), ["r_bucket", "r_part"])
    return jobs.repartition(max(1, -(-met.count() // TASK_JOBS)))


def _in_reach(l_t: np.ndarray, r_t: np.ndarray, shift: int, dt_us: int) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last place in ``r_t`` of what a left time meets."""
    at = l_t - shift
    return np.searchsorted(r_t, at - dt_us, "left"), np.searchsorted(r_t, at + dt_us, "right")


def _listed(first: np.ndarray, behind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every place of the ranges ``[first, behind)`` with the number of its range, about ``PAIRS_AT_ONCE`` at a time."""
    ends = np.cumsum(behind - first)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PAIRS_AT_ONCE)) + 1).tolist(), len(first)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        sizes = behind[lo:hi] - first[lo:hi]
        total = int(sizes.sum())
        if total:
            yield np.repeat(np.arange(lo, hi), sizes), np.arange(total) + np.repeat(first[lo:hi] - (np.cumsum(sizes) - sizes), sizes)


def _column(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False) for v in batch.column(name)]


def count_pairs_by_slide(
    left: DataFrame, right: DataFrame, dt_us: int, slides: DataFrame, time: str = "t_us"
) -> DataFrame:
    """Number of pairs with ``|t_left - (t_right + shift)| <= dt`` for each slide, 0 for a slide without any.

    Pairs are never built: distinct times stand in sorted arrays with running counts, and a left time finds the ends of its
    partners by binary search. ``slides`` is the small table ``(slide_id, shift_us)``.
    """

    def counted(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("t")).agg(F.count("*").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pairs = [], []
            columns = [_column(batch, c) for c in ("l_t", "l_n", "r_t", "r_n")]
            for l_t, l_n, r_t, r_n, met in zip(*columns, batch.column("slides").to_pylist(), strict=True):
                upto = np.concatenate([[0], np.cumsum(r_n)])
                for s in met:
                    first, behind = _in_reach(l_t, r_t, s["shift_us"], dt_us)
                    ids.append(s["slide_id"])
                    pairs.append(int((l_n * (upto[behind] - upto[first])).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs, pa.int64())], ["slide_id", "pairs"])

    met = _chunk_pairs(counted(left), counted(right), dt_us, slides, ["n"])
    parts = met.select("l_t", "l_n", "r_t", "r_n", "slides").mapInArrow(run, "slide_id long, pairs long")
    found = parts.groupBy("slide_id").agg(F.sum("pairs").alias("_found"))
    every = slides.select("slide_id").join(found, "slide_id", "left")
    return every.select("slide_id", F.coalesce("_found", F.lit(0).cast("long")).alias("pairs"))


def background_scores(
    left: DataFrame,
    right: DataFrame,
    dt_us: int,
    slides: DataFrame,
    between: Sequence[tuple[float, float]] | None = None,
    cells: int = 4096,
    top: float = 1.0,
    digits: int = 6,
) -> DataFrame:
    """Numbers of slid pairs by their joint score ``hypot``, rounded to ``digits``: ``(s, n)``.

    Both sides have ``t`` and ``score``, and may have ``n``, the number of rows with them; else equal rows are counted first.
    Without ``between``, ``s`` is the cell of the score on ``[0, top]``; with it, ``s`` is the score itself, for scores in one of
    the half-open ranges only. Pairs exist only inside a task, a bounded number at a time.
    """

    # A score moves by rounding to its digits, and by the last bits of its square.
    margins = [(max(a - 10.0**-digits - 1e-9 * abs(a), 0.0) ** 2, (b + 10.0**-digits + 1e-9 * abs(b)) ** 2) for a, b in between or ()]

    def parts_of(l_t, l_s, l_n, r_t, r_s, r_n, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Joint scores and numbers of the pairs of a slide, ``PAIRS_AT_ONCE`` at a time."""
        first, behind = _in_reach(l_t, r_t, shift, dt_us)
        l_square, r_square = l_s * l_s, r_s * r_s
        for of, at in _listed(first, behind):
            if between is not None:
                # Squares leave out what is not near a range; what is gets its exact score.
                square = l_square[of] + r_square[at]
                near = np.logical_or.reduce([(square >= a) & (square <= b) for a, b in margins])
                at, of = at[near], of[near]
            yield np.round(np.hypot(l_s[of], r_s[at]), digits), l_n[of] * r_n[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_column(batch, c) for c in ("l_t", "l_score", "l_n", "r_t", "r_score", "r_n")]
            for *sides, met in zip(*columns, batch.column("slides").to_pylist(), strict=True):
                per_cell, found = np.zeros(cells + 1, np.int64), []
                for s in met:
                    for joint, n in parts_of(*sides, s["shift_us"]):
                        if between is None:
                            at = np.floor(joint / top * cells).astype(np.int64)
                            per_cell += np.bincount(at, n, cells + 1).astype(np.int64)
                            continue
                        inside = np.logical_or.reduce([(joint >= a) & (joint < b) for a, b in between])
                        values, at = np.unique(joint[inside], return_inverse=True)
                        found.append((values, np.bincount(at, n[inside], len(values)).astype(np.int64)))
                if between is None:
                    values = np.flatnonzero(per_cell)
                    values, counts = values.astype(np.float64), per_cell[values]
                else:
                    values, counts = (np.concatenate(x) for x in zip((np.zeros(0), np.zeros(0, np.int64)), *found, strict=True))
                    values, at = np.unique(values, return_inverse=True)
                    counts = np.bincount(at, counts, len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.array(counts, pa.int64())], ["s", "n"])

    left, right = (side if "n" in side.columns else side.groupBy("t", "score").agg(F.count("*").alias("n")) for side in (left, right))
    met = _chunk_pairs(left, right, dt_us, slides, ["score", "n"])
    columns = ["l_t", "l_score", "l_n", "r_t", "r_score", "r_n", "slides"]
    parts = met.select(*columns).mapInArrow(run, "s double, n long")
    return parts.groupBy("s").agg(F.sum("n").alias("n"))


# --- nearest ------------------------------------------------------------------


def nearest_match(left: DataFrame, right: DataFrame, time: str = "t_us", buckets: int | None = None) -> DataFrame:
    """For each distinct left time the distance to the nearest right time.

    Adds ``prev_us``, ``next_us`` (nearest right time on each side) and ``dist_us``.
    """
    flagged = left.select(F.col(time).alias("t_us"), F.lit(0).alias("r"), F.lit(1).alias("l")).unionByName(
        right.select(F.col(time).alias("t_us"), F.lit(1).alias("r"), F.lit(0).alias("l"))
    )
    line = flagged.groupBy("t_us").agg(F.max("r").alias("r"), F.sum("l").alias("n_left"))
    line = with_range_bucket(line, "t_us", range_edges(flagged, "t_us", buckets))
    mark = F.when(F.col("r") == 1, F.col("t_us"))
    line = running(line, "t_us", {"prev_us": ("max", mark)})
    line = running(line, "t_us", {"next_us": ("min", mark)}, descending=True)
    distance = F.least(F.col("t_us") - F.col("prev_us"), F.col("next_us") - F.col("t_us"))
    return line.where("n_left > 0").select("t_us", "n_left", "prev_us", "next_us", distance.alias("dist_us"))


# --- one-to-one matching ------------------------------------------------------

def greedy_matches(
    left: DataFrame,
    right: DataFrame,
    dt_us: int,
    time: str = "t_us",
    by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One-to-one matching of two time lists, oldest unmatched first.

    Returns ``(by..., left_us, right_us, n)``: ``n`` matches between a left and a right time. Equal times are counted before
    they are moved.

    The unmatched rows at any time are the latest ones of one side, so the state is one number: positive for left rows, negative
    for right rows. A time limits it to the rows of the last ``dt`` and adds its own, so the state after a whole range of
    times is ``min(max(x + shift, low), high)`` of the state before it. Each range is reduced to these three numbers, one scan
    over the ranges gives every range its state, and the ranges then find their matches on their own, whatever the density.
    Rows are named by their rank in a match; a last pass over the ranks gives the times.
    """
    by = list(by)
    counts = (
        left.select(*by, F.col(time).alias("t_us"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        .unionByName(
            right.select(*by, F.col(time).alias("t_us"), F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
        )
        .groupBy(*by, "t_us")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    # Counted times are stored once: every pass reads the same rows. Keys travel as one struct, so null keys meet too.
    counts = cut_lineage(counts.select(F.struct(*by, F.lit(0).alias("_")).alias("key"), "t_us", "a", "b"))
    if not buckets:
        largest = counts.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        buckets = max(1, -(-largest // MATCH_ROWS))
    states = cut_lineage(_with_reach(counts, dt_us, range_edges(counts, "t_us", buckets)))
    parts = states.groupBy("key", "bucket").applyInArrow(
        _range_effect, _keyed(states, "bucket int, shift long, low long, high long")
    )
    starts = parts.groupBy("key").applyInArrow(_range_starts, _keyed(parts, "bucket int, start long"))
    started = states.join(starts, ["key", "bucket"])
    ranks = started.groupBy("key", "bucket").applyInArrow(
        _rank_matches, _keyed(started, "side int, t_us long, rank long, n long")
    )
    named = _times_of_ranks(states, ranks)
    return named.select(*[F.col(f"key.{c}").alias(c) for c in by], "left_us", "right_us", "n")


def _with_reach(counts: DataFrame, dt_us: int, edges: Sequence[float]) -> DataFrame:
    """Rows of each side before a time (``ra``, ``rb``), and those of them in its reach (``la``, ``lb``), with its range."""
    zero = F.lit(0).cast("long")
    rows = counts.select("key", F.col("t_us").alias("x"), F.lit(1).alias("kind"), "a", "b", "t_us")
    # A probe stands before the rows of its own time: it counts what is out of reach.
    probes = counts.select("key", (F.col("t_us") - dt_us).alias("x"), F.lit(0).alias("kind"), zero.alias("a"), zero.alias("b"), "t_us")
    line = with_range_bucket(rows.unionByName(probes), "x", edges, "bucket")
    line = running(line, ["x", "kind"], {"ra": ("sum", "a"), "rb": ("sum", "b")}, by=["key"], bucket="bucket", exclusive=True)
    gone = line.where("kind = 0").select("key", "t_us", F.col("ra").alias("_oa"), F.col("rb").alias("_ob"))
    here = line.where("kind = 1").join(gone, ["key", "t_us"])
    return here.select(
        "key", "bucket", "t_us", "a", "b", "ra", "rb", (F.col("ra") - F.col("_oa")).alias("la"), (F.col("rb") - F.col("_ob")).alias("lb")
    )


_FAR = 1 << 60


def _keyed(rows: DataFrame, fields: str) -> T.StructType:
    """A schema that begins with the key of ``rows``."""
    return T.StructType([rows.schema["key"], *T.StructType.fromDDL(fields)])


def _with_key(rows: pa.Table, **columns: tuple[list, pa.DataType]) -> pa.Table:
    """Columns of results, each row with the key of the group."""
    n = len(next(iter(columns.values()))[0])
    key = rows.column("key").combine_chunks().take(pa.array(np.zeros(n, np.int64)))
    return pa.table({"key": key, **{name: pa.array(values, kind) for name, (values, kind) in columns.items()}})


def _effect(*steps: list[int]) -> tuple[int, int, int]:
    """``shift, low, high`` of the steps ``(a, b, la, lb)`` in time order."""
    shift, low, high = 0, -_FAR, _FAR
    for a, b, most, least in zip(*steps, strict=True):
        low = min(max(low, -least), most) + a - b
        high = min(max(high, -least), most) + a - b
        shift += a - b
    return shift, low, high


def _range_effect(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("t_us")
    shift, low, high = _effect(*(rows[c].to_pylist() for c in ("a", "b", "la", "lb")))
    bucket = [rows["bucket"][0].as_py()]
    return _with_key(rows, bucket=(bucket, pa.int32()), **{n: ([v], pa.int64()) for n, v in (("shift", shift), ("low", low), ("high", high))})


def _range_starts(parts: pa.Table) -> pa.Table:
    """The state before each range; one row per range."""
    parts = parts.sort_by("bucket")
    state, starts = 0, []
    for shift, low, high in zip(*(parts[c].to_pylist() for c in ("shift", "low", "high")), strict=True):
        starts.append(state)
        state = min(max(state + shift, low), high)
    return _with_key(parts, bucket=(parts["bucket"].to_pylist(), pa.int32()), start=(starts, pa.int64()))


def _rank_matches(rows: pa.Table) -> pa.Table:
    """Matches of a range: the time of the later row, and the ranks of the earlier ones on the other side.

    ``side`` 1 has a left time and ranks of right rows, 2 the other way round; ranks ``[rank, rank + n)`` count from 0.
    """
    rows = rows.sort_by("t_us")
    state, found = rows["start"][0].as_py(), []
    columns = (rows[c].to_pylist() for c in ("t_us", "a", "b", "ra", "rb", "la", "lb"))
    for t, a, b, before_a, before_b, most, least in zip(*columns, strict=True):
        state = min(max(state, -least), most)
        if state < 0 and a:
            found.append((1, t, before_b + state, min(a, -state)))
        state += a
        if state > 0 and b:
            found.append((2, t, before_a + a - state, min(b, state)))
        state -= b
    side, time, rank, n = zip(*found, strict=True) if found else ([], [], [], [])
    kinds = {"side": (side, pa.int32()), "t_us": (time, pa.int64()), "rank": (rank, pa.int64()), "n": (n, pa.int64())}
    return _with_key(rows, **kinds)


def _times_of_ranks(states: DataFrame, ranks: DataFrame) -> DataFrame:
    """Both times of every match: rows and matches share one line of ranks, cut where either begins or ends."""
    none = F.lit(None).cast("long")
    rights = states.where("b > 0").select("key", F.lit(1).alias("side"), F.col("rb").alias("x"), F.col("t_us").alias("row"))
    lefts = states.where("a > 0").select("key", F.lit(2).alias("side"), F.col("ra").alias("x"), F.col("t_us").alias("row"))
    rows = rights.unionByName(lefts).select("*", none.alias("met"), F.lit(False).alias("cut"))
    begins = ranks.select("key", "side", F.col("rank").alias("x"), none.alias("row"), F.col("t_us").alias("met"), F.lit(True).alias("cut"))
    ends = ranks.select("key", "side", (F.col("rank") + F.col("n")).alias("x"), none.alias("row"), none.alias("met"), F.lit(True).alias("cut"))
    line = rows.unionByName(begins).unionByName(ends).groupBy("key", "side", "x").agg(
        F.max("row").alias("row"), F.max("met").alias("met"), F.max("cut").alias("cut")
    )
    # Ranks are dense, so equal stretches of them hold alike many rows.
    line = line.withColumn("bucket", F.floor(F.col("x") / MATCH_ROWS))
    last = F.when(F.col("cut"), F.struct("x", "met"))
    by = ["key", "side"]
    line = running(line, "x", {"_row": ("max", "row"), "_last": ("max", last)}, by=by, bucket="bucket")
    line = running(line, "x", {"_next": ("min", "x")}, by=by, bucket="bucket", descending=True, exclusive=True)
    met = F.col("_last.met")
    pairs = line.where(met.isNotNull())
    left_us = F.when(F.col("side") == 1, met).otherwise(F.col("_row"))
    right_us = F.when(F.col("side") == 1, F.col("_row")).otherwise(met)
    return pairs.select("key", left_us.alias("left_us"), right_us.alias("right_us"), (F.col("_next") - F.col("x")).alias("n"))


def _matched(state: int, *steps: list[int]) -> int:
    """Number of matches of the steps ``(a, b, la, lb)`` in time order, from a state on."""
    found = 0
    for a, b, most, least in zip(*steps, strict=True):
        state = min(max(state, -least), most)
        if state < 0 and a:
            found += min(a, -state)
        state += a
        if state > 0 and b:
            found += min(b, state)
        state -= b
    return found


def _slid_steps(rows: pa.Table, dt_us: int) -> Iterator[tuple[int, list[list[int]]]]:
    """For each slide of a job the steps ``(a, b, la, lb)`` at the times of its range, of left and slid right times."""

    def side(name: str) -> tuple[np.ndarray, np.ndarray]:
        chunks = rows.filter(pc.equal(rows["side"], name)).combine_chunks()
        t, n = (chunks[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "n"))
        order = np.argsort(t)
        return t[order], n[order]

    (l_t, l_n), (r_t, r_n) = side("l"), side("r")
    lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
    for s in rows["slides"][0].as_py():
        ends = (lo - dt_us, hi)
        l_at, r_at = slice(*np.searchsorted(l_t, ends)), slice(*np.searchsorted(r_t, np.array(ends) - s["shift_us"]))
        lt, rt = l_t[l_at], r_t[r_at] + s["shift_us"]
        times = np.union1d(lt, rt)
        counts = []
        for t, n in ((lt, l_n[l_at]), (rt, r_n[r_at])):
            c = np.zeros(len(times), np.int64)
            c[np.searchsorted(times, t)] = n
            counts.append(c)
        # What is in reach of a time came before it, by dt at most.
        gone = np.searchsorted(times, times - dt_us)
        upto = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        reach = [u[:-1] - u[gone] for u in upto]
        first = np.searchsorted(times, lo)
        yield s["slide_id"], [c[first:].tolist() for c in (*counts, *reach)]


def count_matches_by_slide(
    left: DataFrame, right: DataFrame, dt_us: int, slides: DataFrame, time: str = "t_us", rows_per_range: int = MATCH_ROWS
) -> DataFrame:
    """Number of one-to-one matches for each slide, 0 for a slide without any: ``greedy_matches`` without slid copies of the rows.

    Distinct times travel as sorted arrays with counts, once per range of times and group of slides; they are slid inside the
    task. A first pass reduces a range of a slide to its three numbers, a scan over the ranges gives the states, and a second
    pass counts the matches from there.
    """
    spark = left.sparkSession

    def counted(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("t")).agg(F.count("*").alias("n")))

    l, r = counted(left), counted(right)
    both = l.select("t").unionByName(r.select("t"))
    edges = range_edges(both, "t", max(1, -(-both.count() // rows_per_range)))
    ends = l.agg(F.min("t"), F.max("t")).first()
    none = slides.select("slide_id", F.lit(0).cast("long").alias("pairs"))
    if ends[0] is None:
        return none
    # Slid times that no left time can meet are in no range.
    bounds = [ends[0] - dt_us, *sorted({math.ceil(e) for e in edges if ends[0] - dt_us < e <= ends[1]}), ends[1] + dt_us + 1]
    ranges = spark.createDataFrame(list(zip(range(len(bounds)), bounds, bounds[1:])), "bucket int, lo long, hi long")
    every = slides.agg(F.sort_array(F.collect_list(F.struct("shift_us", "slide_id")))).scalar()
    starts_of_groups = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(JOB_SLIDES))
    jobs = ranges.withColumn("_every", every).withColumn("_at", F.explode(starts_of_groups))
    jobs = jobs.select("*", F.slice("_every", F.col("_at"), F.lit(JOB_SLIDES)).alias("slides")).drop("_every").where(F.size("slides") > 0)
    jobs = jobs.withColumns({"_l_lo": F.col("lo") - dt_us, "_r_lo": F.col("lo") - dt_us - F.element_at("slides", -1)["shift_us"], "_r_hi": F.col("hi") - F.element_at("slides", 1)["shift_us"]})
    for column in ("_l_lo", "hi", "_r_lo", "_r_hi"):
        jobs = with_range_bucket(jobs, column, edges, f"_b{column}")

    parts = []
    for name, rows, first, last in (("l", l, "_b_l_lo", "_bhi"), ("r", r, "_b_r_lo", "_b_r_hi")):
        chunks = cut_lineage(_time_chunks(rows, ["n"], edges, name))
        wanted = jobs.select("bucket", "_at", "lo", "hi", "slides", F.explode(F.sequence(first, last)).alias(f"{name}_bucket"))
        parts.append(
            wanted.join(chunks, f"{name}_bucket").select(
                "bucket", "_at", "lo", "hi", "slides", F.lit(name).alias("side"), F.col(f"{name}_t").alias("t"), F.col(f"{name}_n").alias("n")
            )
        )
    rows = parts[0].unionByName(parts[1])

    def effects(rows: pa.Table) -> pa.Table:
        found = [(slide, *_effect(*steps)) for slide, steps in _slid_steps(rows, dt_us)]
        ids, shift, low, high = zip(*found, strict=True)
        key = pa.StructArray.from_arrays([pa.array(ids, pa.int64())], ["slide_id"])
        bucket = pa.array([rows["bucket"][0].as_py()] * len(ids), pa.int32())
        return pa.table({"key": key, "bucket": bucket, **{n: pa.array(v, pa.int64()) for n, v in (("shift", shift), ("low", low), ("high", high))}})

    def matches(rows: pa.Table) -> pa.Table:
        start = dict(rows["starts"][0].as_py())
        found = [(slide, _matched(start[slide], *steps)) for slide, steps in _slid_steps(rows, dt_us)]
        ids, pairs = zip(*found, strict=True)
        return pa.table({"slide_id": pa.array(ids, pa.int64()), "pairs": pa.array(pairs, pa.int64())})

    by = ["bucket", "_at"]
    effect = rows.groupBy(*by).applyInArrow(effects, "key struct<slide_id:long>, bucket int, shift long, low long, high long")
    effect = cut_lineage(effect)
    starts = effect.groupBy("key").applyInArrow(_range_starts, _keyed(effect, "bucket int, start long"))
    starts = starts.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("key.slide_id", "start"))).alias("starts"))
    found = rows.join(starts, "bucket").groupBy(*by).applyInArrow(matches, "slide_id long, pairs long")
    found = found.unionByName(none)
    return found.groupBy("slide_id").agg(F.sum("pairs").alias("pairs"))


def match_in_order(times, left_n, right_n, dt, side=0, queue=()):
    """Match counted rows in time order; ``queue`` holds unmatched ``[time, count]`` of one side.

    ``side`` is 1 while the queue holds left rows, 2 while it holds right rows.
    """
    queue, head, pairs = [list(q) for q in queue], 0, []
    for t, a, b in zip(times, left_n, right_n):
        while head < len(queue) and queue[head][0] < t - dt:
            head += 1
        for mine, n in ((1, a), (2, b)):
            while n and head < len(queue) and side != mine:
                waiting = queue[head]
                k = min(n, waiting[1])
                pairs.append((t, waiting[0], k) if mine == 1 else (waiting[0], t, k))
                waiting[1] -= k
                n -= k
                if not waiting[1]:
                    head += 1
            if n:
                if head == len(queue):
                    queue, head = [], 0
                side = mine
                queue.append([t, n])
    rest = queue[head:]
    return pairs, (side if rest else 0), rest


# --- background ---------------------------------------------------------------


def slid(right: DataFrame, slides: DataFrame, time: str = "t_us") -> DataFrame:
    """One shifted copy of the right table per slide."""
    return (
        right.withColumn("_slide", every_slide(slides))
        .withColumn(time, F.col(time) + F.col("_slide.shift_us"))
        .withColumn("slide_id", F.col("_slide.slide_id"))
        .drop("_slide")
    )


def observation_span(left: DataFrame, right: DataFrame, time: str = "t_us") -> DataFrame:
    """One row: overlap of the two observation spans in seconds."""
    ends = (
        left.select(F.lit("a").alias("side"), F.col(time).alias("t"))
        .unionByName(right.select(F.lit("b").alias("side"), F.col(time).alias("t")))
        .groupBy("side")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    )
    span = F.greatest(F.min("hi") - F.max("lo"), F.lit(0)) / F.lit(1e6)
    return ends.agg(F.when(F.count("*") == 2, span).alias("tobs_s"))


def false_alarm_rate(background: DataFrame, span: DataFrame, pairs: str = "pairs") -> DataFrame:
    """Mean and spread of the background counts and the rate per second and per day."""
    n = F.col(pairs).cast("double")
    seconds = span.select("tobs_s").scalar()
    stats = background.agg(
        F.count("*").alias("slides"),
        F.avg(n).alias("bg_mean"),
        F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("bg_std"),
    ).withColumn("tobs_s", seconds)
    per_second = F.when(F.col("tobs_s") > 0, F.col("bg_mean") / F.col("tobs_s"))
    return stats.withColumn("far_per_sec", per_second).withColumn("far_per_day", per_second * 86_400.0)


def _picks(counts: DataFrame, targets: Sequence[float]) -> DataFrame:
    """The value at element ``ceil((1 - far) * n) - 1`` of counted values ``(s, n)``, for each target."""
    ranked = running(with_range_bucket(counts, "s", range_edges(counts, "s")), "s", {"_cum": ("sum", "n")}, totals=True)

    def pick(far: float):
        n = F.col("_cum_total")
        index = F.greatest(F.lit(0), F.least(F.ceil(F.lit(1.0 - far) * n) - 1, n - 1))
        first = F.min(F.when(F.col("_cum") > index, F.struct("s", (index - F.col("_cum") + F.col("n")).alias("rest"))))
        return F.struct(
            F.lit(float(far)).alias("far"), F.max("_cum_total").alias("bg_count"), first["s"].alias("s"), first["rest"].alias("rest")
        )

    return ranked.agg(F.array(*[pick(f) for f in targets]).alias("t")).select(F.inline("t"))


def background_thresholds(scores: DataFrame, targets: Sequence[float], score: str = "score") -> DataFrame:
    """Element ``ceil((1 - far) * n) - 1`` of the ascending background for each target."""
    counts = cut_lineage(scores.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n")))
    return _picks(counts, targets).select("far", "bg_count", F.col("s").alias("threshold"))


def _score_bins(side: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of row-balanced bins of the score's magnitude, and the smallest and largest magnitude in each bin."""
    sizes = side.select(F.abs("score").alias("x"))
    edges = [e for e in range_edges(sizes, "x", SCORE_BINS) if math.isfinite(e)]
    spans = with_range_bucket(sizes, "x", edges).groupBy("_bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    low, high = np.full(len(edges) + 1, np.nan), np.full(len(edges) + 1, np.nan)
    for r in spans.collect():  # one row per bin
        low[r["_bucket"]], high[r["_bucket"]] = r["lo"], r["hi"]
    if np.isinf(high).any():
        raise ValueError("a score is infinite")
    return np.array(edges), low, high


PAIR_COLUMNS = ["l_t", "l_score", "l_n", "r_t", "r_score", "r_n", "slides"]


def _binned_jobs(batches: Iterator[pa.RecordBatch], dt_us: int, l_edges: np.ndarray, r_edges: np.ndarray):
    """The pairs of chunks of the batches: both sides, bins of their scores, and per slide the ends of what a left row meets."""
    for batch in batches:
        columns = [_column(batch, c) for c in PAIR_COLUMNS[:-1]]
        for l_t, l_s, l_n, r_t, r_s, r_n, met in zip(*columns, batch.column("slides").to_pylist(), strict=True):
            a, b = (np.searchsorted(e, np.abs(v), "right") for e, v in ((l_edges, l_s), (r_edges, r_s)))
            yield (l_s, l_n, a), (r_s, r_n, b), [_in_reach(l_t, r_t, s["shift_us"], dt_us) for s in met]


def _box_counts(met: DataFrame, dt_us: int, l_edges, r_edges, kinds: Sequence[np.ndarray]) -> DataFrame:
    """Numbers of slid pairs by a cell of their pair of bins, for each of ``kinds``: ``(kind, cell, n)``.

    A kind holds the cell of every pair of bins. Pairs are not listed: the ends of what left rows meet give the number of left
    rows of each bin that meet a right row.
    """
    shape = len(l_edges) + 1, len(r_edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for (_, l_n, a), (_, r_n, b), reach in _binned_jobs(batches, dt_us, l_edges, r_edges):
            # Left rows stand by bin, each with all its slides, so that counting stays in one row of the matrix.
            order = np.argsort(a, kind="stable")
            present, row = np.unique(a[order], return_inverse=True)
            width, size = len(r_n) + 1, len(present) * (len(r_n) + 1)
            first, behind = (np.stack(ends, axis=1)[order] for ends in zip(*reach, strict=True))
            busy = behind > first
            at, weight = (np.broadcast_to(v[:, None], busy.shape)[busy] for v in (row * width, l_n[order].astype(np.float64)))
            meets = np.bincount(at + first[busy], weight, size)
            meets -= np.bincount(at + behind[busy], weight, size)
            meets = meets.reshape(len(present), width).cumsum(axis=1)[:, :-1]
            by_bin = np.zeros((len(r_n), shape[1]))
            by_bin[np.arange(len(r_n)), b] = r_n
            total[present] += meets @ by_bin
        for kind, cells in enumerate(kinds):
            n = np.bincount(cells.ravel(), total.ravel()).astype(np.int64)
            at = np.flatnonzero(n)
            columns = [pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "cell", "n"])

    parts = met.select(*PAIR_COLUMNS).mapInArrow(run, "kind int, cell long, n long")
    return parts.groupBy("kind", "cell").agg(F.sum("n").alias("n"))


def _open_counts(
    met: DataFrame, dt_us: int, l_edges, r_edges, brackets: Sequence[tuple[np.ndarray, float, float]], cells: int, chosen=None, digits: int = 6
) -> DataFrame:
    """Numbers of slid pairs inside the open pairs of bins of each bracket ``(open, low, high)``.

    Without ``chosen`` by cell of ``[low, high)``, where -1 is what lies below: ``(k, cell, n)``. With one cell of each bracket by
    the joint score inside it: ``(k, s, n)``. Rows of the right side stand by bin, then time, so that only pairs of open bins
    are listed, a bounded number at a time.
    """
    lists = []
    for mask, _, _ in brackets:
        per_left = mask.sum(axis=1)
        lists.append((per_left, np.cumsum(per_left) - per_left, np.nonzero(mask)[1]))

    def listed(job) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Bracket, joint scores and numbers of the pairs of a job in open bins."""
        (l_s, l_n, a), (r_s, r_n, b), reach = job
        order = np.argsort(b, kind="stable")
        by_score, by_n = r_s[order], r_n[order]
        before = np.zeros((len(r_n) + 1, len(r_edges) + 1), np.int32)
        before[np.arange(1, len(r_n) + 1), b] = 1
        np.cumsum(before, axis=0, out=before)
        starts = np.searchsorted(b[order], np.arange(len(r_edges) + 1))
        for first, behind in reach:
            busy = np.flatnonzero(behind > first)
            for k, (per_left, offset, bins) in enumerate(lists):
                n_bins = per_left[a[busy]]
                i = np.repeat(busy, n_bins)
                within = np.arange(len(i)) - np.repeat(np.cumsum(n_bins) - n_bins, n_bins)
                c = bins[offset[a[i]] + within]
                lo, hi = before[first[i], c], before[behind[i], c]
                some = hi > lo
                i, c, lo, hi = i[some], c[some], lo[some], hi[some]
                for of, at in _listed(starts[c] + lo, starts[c] + hi):
                    yield k, np.round(np.hypot(l_s[i[of]], by_score[at]), digits), l_n[i[of]] * by_n[at]

    def cell_of(k: int, s: np.ndarray) -> np.ndarray:
        _, low, high = brackets[k]
        return np.where(s < low, -1, np.where(s < high, np.minimum(np.floor((s - low) / (high - low) * cells), cells - 1), cells)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(brackets), cells + 2))
        for job in _binned_jobs(batches, dt_us, l_edges, r_edges):
            found = [[] for _ in brackets]
            for k, s, n in listed(job):
                cell = cell_of(k, s)
                if chosen is None:
                    total[k] += np.bincount(cell + 1, n, cells + 2)
                    continue
                inside = cell == chosen[k]
                found[k].append((s[inside], n[inside]))
            for k, parts in enumerate(found):
                if parts:
                    s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    values, at = np.unique(s, return_inverse=True)
                    yield row(k, values, np.bincount(at, n, len(values)))
        if chosen is None:
            for k in range(len(brackets)):
                at = np.flatnonzero(total[k, :-1])
                yield row(k, at - 1, total[k, at])

    name, kind = ("cell", pa.int64()) if chosen is None else ("s", pa.float64())

    def row(k: int, values, n) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(values), k), pa.int32()), pa.array(values, kind), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["k", name, "n"])

    parts = met.select(*PAIR_COLUMNS).mapInArrow(run, f"k int, {name} {'long' if chosen is None else 'double'}, n long")
    return parts.groupBy("k", name).agg(F.sum("n").alias("n"))


def slide_thresholds(
    left: DataFrame, right: DataFrame, dt_us: int, slides: DataFrame, targets: Sequence[float], cells: int = 4096
) -> DataFrame:
    """Element ``ceil((1 - far) * n) - 1`` of the ascending joint scores of all slid pairs for each target, without a list of the pairs.

    Three passes. The first counts pairs per pair of score bins, by searches in sorted times, whatever the density: that bounds
    each threshold from both sides. The second lists only pairs of bins between the bounds and counts them in cells, the
    third counts the scores in one cell. Both sides have ``t`` and ``score``; equal rows are one row with a number.
    """
    left, right = (cut_lineage(side.select("t", "score").dropna().groupBy("t", "score").agg(F.count("*").alias("n"))) for side in (left, right))
    none = left.sparkSession.createDataFrame([], "far double, bg_count long, threshold double")
    (l_edges, l_low, l_high), (r_edges, r_low, r_high) = _score_bins(left), _score_bins(right)
    low, high = np.hypot(l_low[:, None], r_low), np.hypot(l_high[:, None], r_high)
    used = ~np.isnan(low)
    if not used.any():
        return none
    # Rounding, and the last bits of a score.
    low, high = (np.where(used, v + sign * (2e-6 + 1e-12 * v), 0.0) for v, sign in ((low, -1), (high, 1)))
    corners = np.sort(np.concatenate([low[used], high[used]]))
    grid = np.unique(corners[:: max(1, len(corners) // (2 * cells))])
    low_cell, high_cell = (np.where(used, np.searchsorted(grid, v, "right") - 1, 0) for v in (low, high))
    ends = np.append(grid[1:], max(corners[-1], grid[-1]) + 1.0)

    met = _chunk_pairs(left, right, dt_us, slides, ["score", "n"])
    numbers = np.zeros((2, len(grid)), np.int64)
    for r in _box_counts(met, dt_us, l_edges, r_edges, [low_cell, high_cell]).collect():  # at most two rows per cell
        numbers[r["kind"], r["cell"]] = r["n"]
    upto = numbers.cumsum(axis=1)
    total = int(upto[0, -1])
    if not total:
        return none
    brackets, rests = [], []
    for far in targets:
        index = max(0, min(math.ceil((1.0 - far) * total) - 1, total - 1))
        # So many pairs may lie below a cell, and so many must.
        first, last = (int(np.searchsorted(u, index, "right")) for u in upto)
        brackets.append((used & (high_cell >= first) & (low_cell <= last), float(grid[first]), float(ends[last])))
        rests.append(index - (int(upto[1, first - 1]) if first else 0))
    counts = np.zeros((len(brackets), cells + 1), np.int64)
    for r in _open_counts(met, dt_us, l_edges, r_edges, brackets, cells).collect():  # at most a row per cell and target
        counts[r["k"], r["cell"] + 1] = r["n"]
    chosen = [int(np.searchsorted(c.cumsum(), rest, "right")) - 1 for c, rest in zip(counts, rests, strict=True)]
    rests = [rest - int(c[: cell + 1].sum()) for rest, c, cell in zip(rests, counts, chosen, strict=True)]
    # Pairs of bins that hold values of the chosen cell, or of its neighbours by the last bits.
    near = []
    for (opened, a, b), cell in zip(brackets, chosen, strict=True):
        width = (b - a) / cells
        near.append((opened & (low <= a + (cell + 2) * width) & (high >= a + (cell - 1) * width), a, b))
    inside = cut_lineage(_open_counts(met, dt_us, l_edges, r_edges, near, cells, chosen))
    line = running(with_range_bucket(inside, "s", range_edges(inside, "s")), "s", {"_cum": ("sum", "n")}, by=["k"])
    rest_of = F.array(*[F.lit(r).cast("long") for r in rests])
    picked = line.where(F.col("_cum") > F.get(rest_of, F.col("k"))).groupBy("k").agg(F.min("s").alias("threshold"))
    far_of = F.get(F.array(*[F.lit(float(f)) for f in targets]), F.col("k"))
    return picked.select(far_of.alias("far"), F.lit(total).cast("long").alias("bg_count"), "threshold")


def range_summary(ranges: DataFrame, catalog: DataFrame, key: str, lo: str, hi: str, tc: str = "tc_us") -> DataFrame:
    """Count, first and last catalogue time inside each range, without listing the pairs.

    The distinct ends of the ranges and the catalogue times share one ordered line; the
    number of times up to each end gives the count, the neighbours give the first and
    last time. Results return to the ranges by their ends.
    """
    times = catalog.groupBy(F.col(tc).alias("x")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(1))
    none = F.lit(0).cast("long").alias("n")
    low = ranges.select(F.col(lo).alias("x"), none, F.lit(0).alias("kind")).distinct()
    high = ranges.select(F.col(hi).alias("x"), none, F.lit(2).alias("kind")).distinct()
    line = times.unionByName(low).unionByName(high)
    line = with_range_bucket(line, "x", range_edges(line, "x"))
    mark = F.when(F.col("kind") == 1, F.col("x"))
    line = running(line, ["x", "kind"], {"upto": ("sum", "n"), "prev": ("max", mark)})
    line = running(line, ["x", "kind"], {"next": ("min", mark)}, descending=True)
    at_low = line.where("kind = 0").select(F.col("x").alias(lo), F.col("upto").alias("_before"), F.col("next").alias("first_tc"))
    at_high = line.where("kind = 2").select(F.col("x").alias(hi), F.col("upto").alias("_upto"), F.col("prev").alias("last_tc"))
    found = ranges.join(at_low, lo).join(at_high, hi).withColumn("n_tc", F.col("_upto") - F.col("_before"))
    return found.where("n_tc > 0").select(key, "n_tc", "first_tc", "last_tc")
