"""Windows against template banks: similarity, correlation, pooling, preselection.

Windows are a distributed table of any size; they are streamed through numpy in
Arrow batches. Templates are sent to the tasks in blocks whose size in bytes is
checked, so a bank of any size is handled with one pass per block. A task scores
tiles of some windows against a block, so its memory depends on neither number.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.functions.arrays import rolled
from wavequery.operators.running import range_edges

EPS = 1e-12
BLOCK_BYTES = 8 * 1024**2
# Values of one matrix of a tile: 8 MB of doubles.
TILE_CELLS = 1024**2
# Rows of pairs that leave a task at once: with their Arrow copies they take more than the matrix they come from.
PAIR_ROWS = 128 * 1024
# Lags that are compared by matrix products, as a multiple of the logarithm of the transform that compares more.
DIRECT_LAGS = 16
# Windows and templates of one product; its matrix stays in the cache.
PRODUCT_SHAPE = (64, 1024)


def template_bank(
    spark: SparkSession,
    n: int,
    m1: tuple[float, float] = (3.0, 80.0),
    m2: tuple[float, float] = (3.0, 80.0),
    spin1: float = 0.0,
    spin2: float = 0.0,
    subsample: int = 1,
) -> DataFrame:
    """Parameter bank on a square grid, row by row, exactly ``n`` cells; ``used`` marks every ``subsample``-th."""
    side = max(1, math.ceil(math.sqrt(n)))

    def linspace(bounds: tuple[float, float], i: Column) -> Column:
        return F.lit(float(bounds[0])) + i * ((bounds[1] - bounds[0]) / max(side - 1, 1))

    cells = spark.range(n).withColumnRenamed("id", "pos")
    return cells.select(
        "pos",
        linspace(m1, F.floor(F.col("pos") / side)).alias("m1"),
        linspace(m2, F.col("pos") % side).alias("m2"),
        F.lit(float(spin1)).alias("s1"),
        F.lit(float(spin2)).alias("s2"),
        (F.col("pos") % subsample == 0).cast("int").alias("used"),
    )


def bank_blocks(
    templates: DataFrame, block_bytes: int = BLOCK_BYTES, extra: tuple[str, ...] = ()
) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """Ids, matrix and ``extra`` columns of the bank, block by block in id order; a block stays below ``block_bytes``."""
    longest, n = templates.agg(F.max(F.size("wave")), F.count("*")).first()
    if longest is None:
        return
    per_block = max(1, block_bytes // (8 * longest))
    # Ranges of ids come from quantiles, half a block each, so that only the rows of a block reach the driver at a time.
    edges = range_edges(templates, "template_id", -(-2 * n // per_block)) if n > per_block else []
    key = F.col("template_id").cast("double")
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = templates if low is None else templates.where(key >= low)
        part = part if high is None else part.where(key < high)
        block = part.select("template_id", "wave", *extra).toPandas().sort_values("template_id", kind="stable")
        if not block.empty:
            yield block["template_id"].to_numpy(), fitted(block["wave"], longest), block[list(extra)]


def template_blocks(templates: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the bank, block by block in id order."""
    for ids, bank, _ in bank_blocks(templates, block_bytes):
        yield ids, bank


def right_aligned(m: np.ndarray, length: int) -> np.ndarray:
    """Rows of ``length``: what is longer keeps its end, what is shorter gets zeros in front."""
    if m.shape[1] >= length:
        return m[:, m.shape[1] - length :]
    return np.concatenate([np.zeros((len(m), length - m.shape[1])), m], axis=1)


def fitted(waves: pd.Series, length: int) -> np.ndarray:
    """Series as right-aligned rows of ``length``.

    A missing series and samples that are null, NaN or infinite count as 0, so the score of a window without any is 0.
    """
    out = np.zeros((len(waves), length))
    sizes = waves.map(lambda w: 0 if w is None else len(w)).to_numpy(dtype=np.int64)
    for size in np.unique(sizes[sizes > 0]):
        where = np.flatnonzero(sizes == size)
        out[where] = right_aligned(np.array([np.asarray(waves.iloc[i], dtype=np.float64) for i in where]), length)
    return np.nan_to_num(out, copy=False, nan=0.0, posinf=0.0, neginf=0.0)


def _window_batches(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch, fitted(batch["wave"], length)


def _tiles(n: int, columns: int) -> Iterator[slice]:
    """Slices of ``n`` rows; a matrix of a slice and ``columns`` has at most ``TILE_CELLS`` values, but at least one row."""
    step = max(1, TILE_CELLS // max(columns, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def _over_blocks(
    windows: DataFrame, templates: DataFrame, schema: str, score_task, block_bytes: int, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, int] | None:
    """Union over template blocks of ``score_task(ids, bank, batches)`` on the windows, and the number of blocks."""
    out, blocks = None, 0
    for ids, bank in template_blocks(templates, block_bytes):
        shared = windows.sparkSession.sparkContext.broadcast((ids, bank))
        scored = windows.select("window_id", "wave", *keep).mapInPandas(lambda b, shared=shared: score_task(*shared.value, b), schema)
        out = scored if out is None else out.unionByName(scored)
        blocks += 1
    return None if out is None else (out, blocks)


def _per_block(
    windows: DataFrame,
    templates: DataFrame,
    schema: str,
    score_batch,
    block_bytes: int,
    merge=lambda found: found,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Union over template blocks of ``score_batch(ids, bank, batch, waves)`` on tiles of windows, which also hold ``keep``.

    ``merge`` combines the rows of a window from several blocks. It is skipped for a
    single block, where each window has one row and need not be moved. ``score_batch`` gives one frame or several.
    """

    def run(ids, bank, batches):
        for batch, waves in _window_batches(batches, bank.shape[1]):
            for tile in _tiles(len(batch), max(bank.shape)):
                found = score_batch(ids, bank, batch.iloc[tile], waves[tile])
                yield from [found] if isinstance(found, pd.DataFrame) else found

    scored = _over_blocks(windows, templates, schema, run, block_bytes, keep)
    if scored is None:
        return windows.sparkSession.createDataFrame([], schema)
    out, blocks = scored
    return merge(out) if blocks > 1 else out


def cosine_matrix(waves: np.ndarray, bank: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(waves, axis=1)[:, None] * np.linalg.norm(bank, axis=1)[None, :]
    return waves @ bank.T / (norms + 1e-8)


def cosine_summaries(windows: DataFrame, templates: DataFrame, above: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per window the number of templates, best cosine, mean magnitude and number of cosines over ``above``, without a row per pair."""

    def score(ids, bank, batch, waves):
        s = cosine_matrix(waves, bank)
        parts = {"n": len(ids), "best": s.max(axis=1), "total": np.abs(s).sum(axis=1), "above": (s > above).sum(axis=1)}
        return pd.DataFrame({"window_id": batch["window_id"], **parts})

    schema = "window_id long, n long, best double, total double, above long"
    parts = _per_block(windows, templates, schema, score, block_bytes)
    return parts.groupBy("window_id").agg(
        F.sum("n").alias("n"), F.max("best").alias("best"), (F.sum("total") / F.sum("n")).alias("mean_abs"), F.sum("above").alias("above")
    )


def _long(ids, batch, matrix, names=("score",)) -> Iterator[pd.DataFrame]:
    """A row per pair, in frames of at most about ``PAIR_ROWS`` rows."""
    matrices = matrix if isinstance(matrix, tuple) else (matrix,)
    windows = batch["window_id"].to_numpy()
    step = max(1, PAIR_ROWS // max(len(ids), 1))
    for part in (slice(at, at + step) for at in range(0, len(windows), step)):
        frame = {"window_id": np.repeat(windows[part], len(ids)), "template_id": np.tile(ids, len(windows[part]))}
        yield pd.DataFrame({**frame, **{name: m[part].ravel() for name, m in zip(names, matrices)}})


def cosine_scores(windows: DataFrame, templates: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Cosine of every window and template: ``(window_id, template_id, score)``."""
    return _per_block(
        windows,
        templates,
        "window_id long, template_id long, score double",
        lambda ids, bank, batch, waves: _long(ids, batch, cosine_matrix(waves, bank)),
        block_bytes,
    )


# --- correlation ----------------------------------------------------------------


def lag_grid(length: int, max_shift: int, step: int, include_zero: bool = False) -> np.ndarray:
    """Lags ``-max_shift, -max_shift + step, ...`` that fit the series; zero on request."""
    reach = min(max_shift, length - 1)
    lags = np.arange(-reach, reach + 1, max(1, step))
    if include_zero and 0 not in lags:
        lags = np.sort(np.append(lags, 0))
    return lags


def correlations(waves: np.ndarray, bank: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Normalized correlation at each lag, shape (windows, templates, lags).

    Lag ``k`` compares ``x[i + k]`` with ``h[i]``, zeros outside, divided by both full norms.
    """
    length = waves.shape[1]
    size = 1 << int(np.ceil(np.log2(2 * length)))
    spectrum = np.fft.rfft(waves, size)
    bank_spectrum = np.conj(np.fft.rfft(bank, size))
    norms = np.linalg.norm(waves, axis=1)[:, None] * np.linalg.norm(bank, axis=1)[None, :] + EPS
    out = np.empty((len(waves), len(bank), len(lags)))
    for k in range(len(bank)):
        out[:, k, :] = np.fft.irfft(spectrum * bank_spectrum[k], size)[:, lags]
    return out / norms[:, :, None]


def _standardized(m: np.ndarray) -> np.ndarray:
    m = m - m.mean(axis=1, keepdims=True)
    return m / (m.std(axis=1, keepdims=True) + EPS)


def overlap_correlations(waves: np.ndarray, bank: np.ndarray, max_shift: int) -> np.ndarray:
    """Correlation of standardized series at all lags, divided by the overlap length.

    Lag ``k`` compares ``x[i]`` with ``h[i + k]``: a template that is the window moved to
    the right by ``k`` peaks at ``k``.
    """
    length = waves.shape[1]
    lags = np.arange(-max_shift, max_shift + 1)
    size = 1 << int(np.ceil(np.log2(2 * length)))
    spectrum = np.conj(np.fft.rfft(_standardized(waves), size))
    bank_spectrum = np.fft.rfft(_standardized(bank), size)
    out = np.empty((len(waves), len(bank), len(lags)))
    for k in range(len(bank)):
        out[:, k, :] = np.fft.irfft(spectrum * bank_spectrum[k], size)[:, lags]
    return out / (length - np.abs(lags))


def best_lags(correlate: Callable[[np.ndarray], np.ndarray], bank: np.ndarray, n: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest of ``correlate(part of the bank)`` over the lags and its place, for ``n`` windows and every template; the first wins a tie."""
    top, at = np.empty((n, len(bank))), np.empty((n, len(bank)), np.int64)
    for part in _tiles(len(bank), n * lags):
        c = correlate(bank[part])
        at[:, part] = c.argmax(axis=2)
        top[:, part] = np.take_along_axis(c, at[:, part, None], axis=2)[:, :, 0]
    return top, at


def _best_products(waves: np.ndarray, bank: np.ndarray, lags: np.ndarray, weights: np.ndarray, places: bool = True):
    """Largest ``weights[j] * sum(x[i + lags[j]] * h[i])`` and its ``j`` for every window and template; the first wins a tie.

    A lag is one matrix product of the overlapping samples, so lags cost no transform and no array of all lags. Without
    ``places`` the second result is None.
    """
    n, length = waves.shape
    top, at = np.empty((n, len(bank))), np.zeros((n, len(bank)), np.int64) if places else None
    rows, columns = PRODUCT_SHAPE
    for i in range(0, n, rows):
        for c in range(0, len(bank), columns):
            part = slice(i, i + rows), slice(c, c + columns)
            x, h, best = waves[part[0]], bank[part[1]].T, top[part]
            for j, (lag, weight) in enumerate(zip(lags.tolist(), weights.tolist(), strict=True)):
                width = max(length - abs(lag), 0)
                value = x[:, max(lag, 0) : max(lag, 0) + width] @ h[max(-lag, 0) : max(-lag, 0) + width]
                if weight != 1.0:
                    value *= weight
                if j == 0:
                    best[:] = value
                elif places:
                    larger = value > best
                    np.copyto(best, value, where=larger)
                    np.copyto(at[part], j, where=larger)
                else:
                    np.maximum(best, value, out=best)
    return top, at


def _few(lags: np.ndarray, length: int) -> bool:
    """Whether products at each lag are less work than a transform."""
    return len(lags) <= DIRECT_LAGS * np.log2(2 * length) and np.abs(lags).max() < length


def best_correlations(waves: np.ndarray, bank: np.ndarray, lags: np.ndarray, places: bool = True):
    """Largest of ``correlations`` and, if wanted, its place in ``lags`` for every window and template."""
    if not _few(lags, waves.shape[1]):
        return best_lags(lambda part: correlations(waves, part, lags), bank, len(waves), len(lags))
    top, at = _best_products(waves, bank, lags, np.ones(len(lags)), places)
    top /= np.linalg.norm(waves, axis=1)[:, None] * np.linalg.norm(bank, axis=1)[None, :] + EPS
    return top, at


def best_overlap_correlations(waves: np.ndarray, bank: np.ndarray, max_shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest of ``overlap_correlations`` and its place in the lags for every window and template."""
    length, lags = waves.shape[1], np.arange(-max_shift, max_shift + 1)
    if not _few(lags, length):
        return best_lags(lambda part: overlap_correlations(waves, part, max_shift), bank, len(waves), len(lags))
    # Lags count the other way round here.
    return _best_products(_standardized(waves), _standardized(bank), -lags, 1.0 / (length - np.abs(lags)))


def ncc_scores(
    windows: DataFrame,
    templates: DataFrame,
    max_shift: int,
    lag_step: int = 4,
    include_zero: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Largest normalized correlation over the lag grid for every window and template.

    Adds ``lag``, the lag of the largest value; the first lag wins a tie.
    """

    def score(ids, bank, batch, waves):
        lags = lag_grid(waves.shape[1], max_shift, lag_step, include_zero)
        top, best = best_correlations(waves, bank, lags)
        return _long(ids, batch, (top, lags[best]), ("score", "lag"))

    return _per_block(windows, templates, "window_id long, template_id long, score double, lag long", score, block_bytes)


def ncc_overlap(windows: DataFrame, templates: DataFrame, max_shift: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Largest overlap-normalized correlation and its lag for every window and template."""

    def score(ids, bank, batch, waves):
        top, best = best_overlap_correlations(waves, bank, max_shift)
        return _long(ids, batch, (top, best - max_shift), ("score", "lag"))

    return _per_block(windows, templates, "window_id long, template_id long, score double, lag long", score, block_bytes)


def best_match(
    windows: DataFrame,
    templates: DataFrame,
    max_shift: int,
    lag_step: int = 4,
    include_zero: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Best template, lag and least-squares amplitude of each standardized window.

    Each block of templates reports its best row per window; the best of the blocks is
    kept. The lower template id wins a tie.
    """

    def score(ids, bank, batch, waves):
        x = _standardized(waves)
        lags = lag_grid(x.shape[1], max_shift, lag_step, include_zero)
        top, best = best_correlations(x, bank, lags)
        which = top.argmax(axis=1)
        rows = np.arange(len(x))
        at = best[rows, which]
        scale = np.empty(len(x))
        for i, (k, lag) in enumerate(zip(which, lags[at])):
            aligned = np.zeros(x.shape[1])
            if lag >= 0:
                aligned[lag:] = bank[k][: x.shape[1] - lag]
            else:
                aligned[:lag] = bank[k][-lag:]
            scale[i] = x[i] @ aligned / (aligned @ aligned + EPS)
        return pd.DataFrame(
            {
                "window_id": batch["window_id"],
                "template_id": ids[which],
                "score": top[rows, which],
                "lag": lags[at],
                "scale": scale,
            }
        )

    def merge(found):
        best = F.max_by(F.struct("template_id", "score", "lag", "scale"), F.struct("score", -F.col("template_id")))
        return found.groupBy("window_id").agg(best.alias("b")).select("window_id", "b.*")

    schema = "window_id long, template_id long, score double, lag long, scale double"
    return _per_block(windows, templates, schema, score, block_bytes, merge)


def pooled_scores(
    windows: DataFrame,
    templates: DataFrame,
    k: int,
    max_shift: int | None = None,
    lag_step: int = 4,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Mean of the ``k`` best template scores of each window (``k = 1`` is the maximum).

    Scores are correlations over the lag grid, or cosines when ``max_shift`` is None. A
    block reports only its ``k`` best scores per window. Columns named in ``keep``, such as the ``reason`` of a window
    without samples, go with the row; such a window scores 0.
    """

    def score(ids, bank, batch, waves):
        if max_shift is None:
            s = cosine_matrix(waves, bank)
        else:
            lags = lag_grid(waves.shape[1], max_shift, lag_step)
            s, _ = best_correlations(waves, bank, lags, places=False)
        top = min(k, s.shape[1])
        best = np.sort(np.partition(s, s.shape[1] - top, axis=1)[:, -top:], axis=1)[:, ::-1]
        return pd.DataFrame({"window_id": batch["window_id"], **{c: batch[c] for c in keep}, "best": list(best)})

    def merge(found):
        return found.groupBy("window_id", *keep).agg(F.flatten(F.collect_list("best")).alias("best"))

    kept = "".join(f"{c} {windows.schema[c].dataType.simpleString()}, " for c in keep)
    merged = _per_block(windows, templates, f"window_id long, {kept}best array<double>", score, block_bytes, merge, keep)
    top = F.slice(F.sort_array("best", asc=False), 1, k)
    total = F.aggregate(top, F.lit(0.0), lambda a, v: a + v)
    return merged.select("window_id", *keep, (total / F.size(top)).alias("score"), F.size(top).alias("pooled"))


def preselect(
    probe: DataFrame, templates: DataFrame, k: int, min_probe: int = 8, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The ``k`` templates with the largest mean magnitude of cosine to the probe windows.

    Every task is reduced to one partial sum per template before the shuffle. With fewer than ``min_probe`` windows
    the whole bank is kept.
    """

    def sums(ids, bank, batches):
        h = bank / (np.linalg.norm(bank, axis=1, keepdims=True) + 1e-8)
        total, n = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for _, waves in _window_batches(batches, bank.shape[1]):
            w = waves / (np.linalg.norm(waves, axis=1, keepdims=True) + 1e-8)
            for tile in _tiles(len(w), len(ids)):
                s = np.abs(w[tile] @ h.T)
                ok = np.isfinite(s)
                total += np.where(ok, s, 0.0).sum(axis=0)
                n += ok.sum(axis=0)
        yield pd.DataFrame({"template_id": ids, "total": total, "n": n})

    parts = _over_blocks(probe, templates, "template_id long, total double, n long", sums, block_bytes)
    if parts is None:
        parts = probe.sparkSession.createDataFrame([], "template_id long, total double, n long")
    else:
        parts = parts[0]
    means = parts.groupBy("template_id").agg((F.sum("total") / F.sum("n")).alias("score"))
    enough = len(probe.select("window_id").limit(min_probe).take(min_probe)) >= min_probe
    return means.orderBy(F.desc("score"), "template_id").limit(k) if enough else means


# --- parameter sweep --------------------------------------------------------------


def sweep_grid(
    m1_ranges: Sequence[tuple[float, float]],
    m2_ranges: Sequence[tuple[float, float]],
    sizes: Sequence[int],
    subsamples: Sequence[int],
    topks: Sequence[int],
) -> list[dict]:
    """Every combination of mass ranges, bank size, subsampling and pooling, numbered in that order."""
    names = ("m1", "m2", "templates_n", "subsample", "topk")
    cells = itertools.product(m1_ranges, m2_ranges, sizes, subsamples, topks)
    return [{"config_id": i, **dict(zip(names, cell, strict=True))} for i, cell in enumerate(cells)]


def pending_configs(configs: list[dict], logged: DataFrame) -> list[dict]:
    """The configurations whose ``config_id`` is not in the log of experiments; the log has at most one row per configuration."""
    done = {r[0] for r in logged.select("config_id").distinct().collect()}
    return [c for c in configs if c["config_id"] not in done]


def _of_any_bank(templates: DataFrame, most: dict[tuple, int]) -> DataFrame:
    """Templates that some bank may hold: by mass ranges, the first so many by id. The others never leave the executors."""
    found = None
    for i, (ranges, n) in enumerate(most.items()):
        first = templates.where(_within(ranges)).select("template_id").orderBy("template_id").limit(n)
        last = first.agg(F.lit(i).alias("i"), F.max("template_id").alias("last"))
        found = last if found is None else found.unionByName(last)
    ends = {r["i"]: r["last"] for r in found.collect()}  # one row per pair of mass ranges
    used = F.lit(False)
    for i, ranges in enumerate(most):
        if ends[i] is not None:
            used = used | (_within(ranges) & (F.col("template_id") <= ends[i]))
    return templates.where(used)


def _within(ranges: tuple) -> Column:
    held = F.lit(True)
    for name, bounds in zip(("m1", "m2"), ranges, strict=True):
        if bounds is not None:
            held = held & F.coalesce(F.col(name).between(*bounds), F.lit(False))
    return held


def sweep_scores(
    windows: DataFrame,
    templates: DataFrame,
    configs: list[dict],
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pooled cosine score of every window under every configuration, from one score matrix per block.

    A configuration has ``config_id``, ``templates_n`` (the first so many templates, by id), ``subsample`` (every n-th of
    them) and ``topk``; with ``m1`` and ``m2`` the templates are those in both ranges, ends included. Banks
    that only differ in pooling share one list of best scores per window. A window without templates in a bank has no row.
    Templates that no bank holds are left out before any is sent.
    """
    if not configs:
        return windows.sparkSession.createDataFrame([], "config_id long, window_id long, score double")
    selections: dict[tuple, list[tuple[int, int]]] = {}
    for c in configs:
        key = (c.get("m1"), c.get("m2"), c["templates_n"], c["subsample"])
        selections.setdefault(key, []).append((c["config_id"], c["topk"]))
    keys = list(selections)
    depth = [max(k for _, k in selections[key]) for key in keys]
    masses = tuple(m for m in ("m1", "m2") if any(m in c for c in configs))
    most: dict[tuple, int] = {}
    for key in keys:
        most[key[:2]] = max(most.get(key[:2], 0), key[2])
    seen: dict[tuple, int] = {}
    out, blocks = None, 0
    for ids, bank, attributes in bank_blocks(_of_any_bank(templates, most), block_bytes, masses):
        chosen = []
        for ranges in most:
            held = np.ones(len(ids), bool)
            for name, bounds in zip(("m1", "m2"), ranges, strict=True):
                if bounds is not None:
                    held &= attributes[name].between(*bounds).to_numpy()
            place = seen.get(ranges, 0) + np.cumsum(held) - 1
            seen[ranges] = seen.get(ranges, 0) + int(held.sum())
            for i, key in enumerate(keys):
                if key[:2] == ranges:
                    chosen.append((i, np.flatnonzero(held & (place < key[2]) & (place % key[3] == 0)), depth[i]))
        # Templates that no bank takes, because of its step, are left out.
        used = np.unique(np.concatenate([at for _, at, _ in chosen]))
        if not len(used):
            continue
        chosen = [(i, np.searchsorted(used, at), most) for i, at, most in chosen if len(at)]
        shared = windows.sparkSession.sparkContext.broadcast((bank[used], chosen))
        blocks += 1

        def run(batches, shared=shared):
            bank, chosen = shared.value
            for batch, waves in _window_batches(batches, bank.shape[1]):
                for tile in _tiles(len(batch), max(bank.shape)):
                    s, found = cosine_matrix(waves[tile], bank), []
                    for i, at, most in chosen:
                        top = min(most, len(at))
                        best = np.partition(s[:, at], len(at) - top, axis=1)[:, -top:]
                        found.append(pd.DataFrame({"selection": i, "window_id": batch["window_id"].iloc[tile], "best": list(best)}))
                    yield pd.concat(found)

        part = windows.select("window_id", "wave").mapInPandas(run, "selection int, window_id long, best array<double>")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return windows.sparkSession.createDataFrame([], "config_id long, window_id long, score double")
    if blocks > 1:
        out = out.groupBy("selection", "window_id").agg(F.flatten(F.collect_list("best")).alias("best"))
    uses = F.array(*[F.array(*[F.struct(F.lit(c).cast("long").alias("id"), F.lit(k).alias("k")) for c, k in selections[key]]) for key in keys])
    rows = out.select("window_id", F.sort_array("best", asc=False).alias("best"), F.explode(F.get(uses, F.col("selection"))).alias("use"))
    top = F.slice("best", F.lit(1), F.col("use.k"))
    score = F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / F.size(top)
    return rows.select(F.col("use.id").alias("config_id"), "window_id", score.alias("score"))


# --- injections -------------------------------------------------------------------


def injected_score(amplitude: float, max_shift: int, lag_step: int):
    """A function of (window, template) columns: correlation after adding the scaled template."""

    @F.pandas_udf(T.DoubleType())
    def score(waves: pd.Series, bank: pd.Series) -> pd.Series:
        out = np.full(len(waves), np.nan)
        lengths = waves.map(len).to_numpy()
        for length in np.unique(lengths):
            where = np.flatnonzero(lengths == length)
            x = np.array([np.asarray(waves.iloc[i], dtype=np.float64) for i in where])
            h = np.array([np.asarray(bank.iloc[i], dtype=np.float64) for i in where])
            mixed = x + amplitude * h - x.mean(axis=1, keepdims=True)
            mixed = mixed / (x.std(axis=1, keepdims=True) + EPS)
            size = 1 << int(np.ceil(np.log2(2 * length)))
            c = np.fft.irfft(np.fft.rfft(mixed, size) * np.conj(np.fft.rfft(h, size)), size)
            c = c[:, lag_grid(length, max_shift, lag_step)]
            norms = np.linalg.norm(mixed, axis=1) * np.linalg.norm(h, axis=1) + EPS
            out[where] = c.max(axis=1) / norms
        return pd.Series(out)

    return score


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unit(digest: Column, part: int) -> Column:
    """Part 0, 1, 2 or 3 of a digest as a fraction of 2^32."""
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def _energy(values: Column) -> Column:
    return _mean(F.transform(values, lambda v: v * v))


def augmented(max_shift: int = 0, noise: float = 0.0, dropout: float = 0.0, snr: float | None = None, seed: int = 42):
    """A function of (key, wave) columns: roll, noise, dropout and standardization.

    Random numbers are counted, not drawn: sample ``i`` of a row has the digest of seed, key and ``i``, which gives two normal
    values (Box and Muller's pair) and one uniform. So a row gets the same result wherever it runs, from column expressions
    alone. ``snr`` adds noise whose RMS is that of the wave divided by ``snr``. A null wave stays null, an empty one stays empty.
    """

    def augment(key: Column | str, wave: Column | str) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        wave = (F.col(wave) if isinstance(wave, str) else wave).cast("array<double>")
        name = F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit("|"))

        def changed(x: Column, digests: Column) -> Column:
            radius = lambda d: F.sqrt(F.lit(-2.0) * F.log(_unit(d, 0) + 2.0**-33))
            angle = lambda d: F.lit(2.0 * math.pi) * _unit(d, 1)
            if noise:
                x = F.zip_with(x, digests, lambda v, d: v + F.lit(noise) * radius(d) * F.cos(angle(d)))
            if snr:
                normal = F.transform(digests, lambda d: radius(d) * F.sin(angle(d)))
                x = _bound(
                    x,
                    lambda x: _bound(
                        normal,
                        lambda g: _bound(
                            F.sqrt(_energy(x) + EPS) / snr / (F.sqrt(_energy(g)) + EPS),
                            lambda scale: F.zip_with(x, g, lambda v, w: v + w * scale),
                        ),
                    ),
                )
            if dropout:
                x = F.zip_with(x, digests, lambda v, d: F.when(_unit(d, 2) < dropout, 0.0).otherwise(v))
            centred = _bound(x, lambda x: _bound(_mean(x), lambda m: F.transform(x, lambda v: v - m)))
            return _bound(centred, lambda x: _bound(F.sqrt(_energy(x)) + EPS, lambda s: F.transform(x, lambda v: v / s)))

        start = wave
        if max_shift:
            shift = F.floor(_unit(F.md5(F.concat(name, F.lit("shift"))), 0) * (2 * max_shift + 1)).cast("int") - max_shift
            start = _bound(wave, lambda w: rolled(w, shift))
        numbered = F.transform(F.sequence(F.lit(0), F.size(wave) - 1), lambda i: F.md5(F.concat(name, i.cast("string"))))
        done = _bound(numbered, lambda digests: changed(start, digests))
        return F.when(F.size(wave) > 0, done).otherwise(wave)

    return augment
