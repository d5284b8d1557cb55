"""Periodic runs of words, by string synchronising sets.

A run is a maximal stretch of words with smallest period ``q`` and at least two periods. Periods below ``3 * FIRST`` are
compared directly. Longer ones lie in one dyadic scale ``t``, ``3 * t <= q < 6 * t``:

* The contexts of a scale are the windows of ``t`` words. A position is selected if the hash of its context is the
  least among the ``t + 1`` starts of some window of ``2 * t`` words. That depends on those words alone, so the two
  copies of a window that lie one period apart select the same positions.
* Contexts that themselves have a period of at most ``t / 3`` are not selected; the runs found so far tell which they are. Equal
  contexts are therefore more than ``t / 3`` words apart, so a position has a bounded number of partners below ``6 * t``.
* Pairs of equal contexts propose their distance as period; the longest common extensions to both sides confirm it.
* What this leaves out are runs whose first period is highly periodic as a whole. Their two copies lie in two long runs of
  one shorter period that touch each other; each such pair proposes the distances that fit the phase of both.

Everything is done for all texts of a block at once. Substrings are compared by prefix hashes modulo two primes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavequery.llm import words

FIRST = 4  # the smallest scale
SHORTEST = 12  # words of a run that is returned
LONG_POWER = 9  # periods of a run whose neighbour may continue it in a longer period
BLOCK_BYTES = 3_000_000  # of texts that are searched at once

_PRIMES = ((2147483647, 1103515245), (2147483629, 1597334677))  # modulus, base
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


class Substrings:
    """Fingerprints of all substrings of a sequence of codes."""

    def __init__(self, sequence: np.ndarray):
        self.size = len(sequence)
        self._parts = []
        for prime, base in _PRIMES:
            modulus = np.uint64(prime)
            power = np.ones(self.size + 1, np.uint64)
            done = 1
            while done <= self.size:
                until = min(2 * done, self.size + 1)
                power[done:until] = power[: until - done] * np.uint64(pow(base, done, prime)) % modulus
                done = until
            prefix = np.zeros(self.size + 1, np.uint64)
            np.cumsum(sequence % modulus * power[:-1] % modulus, out=prefix[1:])
            self._parts.append((modulus, power, prefix % modulus))

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The fingerprint of ``[start, start + length)``, the same wherever these words stand."""
        found = np.uint64(0)
        for modulus, power, prefix in self._parts:
            part = (prefix[start + length] + modulus - prefix[start]) % modulus * power[self.size - start] % modulus
            found = (found << np.uint64(31)) | part
        return found

    def windows(self, until: int, length: int) -> np.ndarray:
        """The fingerprints of all windows of ``length`` words that start before ``until - length + 1``."""
        n = until - length + 1
        found = np.uint64(0)
        for modulus, power, prefix in self._parts:
            falling = power[self.size - n + 1 : self.size + 1][::-1]
            part = (prefix[length : until + 1] + modulus - prefix[:n]) % modulus * falling % modulus
            found = (found << np.uint64(31)) | part
        return found

    def extended(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``left`` and ``right`` on (``back``: before them) are equal, up to ``limit``."""
        total = np.zeros(len(left), np.int64)
        stride = 1 << max(int(limit.max(initial=0)), 1).bit_length()
        while stride:
            fits = np.flatnonzero(limit - total >= stride)
            if len(fits):
                gone = total[fits] + stride if back else -total[fits]
                same = self.at(left[fits] - gone, stride) == self.at(right[fits] - gone, stride)
                total[fits[same]] += stride
            stride //= 2
        return total


class _Found:
    """Runs by start, end and smallest period, without repeats."""

    def __init__(self):
        self.rows = np.empty((0, 3), np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Take new runs; returns those that were not known."""
        fresh = np.stack([start, end, period], axis=1)
        both = np.concatenate([self.rows, fresh])
        new = np.repeat([False, True], [len(self.rows), len(fresh)])
        order = np.lexsort((new, both[:, 2], both[:, 1], both[:, 0]))
        both, new = both[order], new[order]
        # A stretch that has several periods is a run of the smallest alone.
        opens = np.ones(len(both), bool)
        opens[1:] = (both[1:, :2] != both[:-1, :2]).any(axis=1)
        self.rows = both[opens]
        return self.rows[new[opens]]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    steps = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours; ``width`` is one more than a power of two."""
    held = 1
    while held < width - 1:
        values = np.minimum(values[:-held], values[held:])
        held *= 2
    return np.minimum(values[:-1], values[1:])


class _Search:
    def __init__(self, sequence: np.ndarray, sizes: np.ndarray):
        """``sizes``: words of each text, falling."""
        self.sequence, self.sizes = sequence, sizes
        self.ends = np.cumsum(sizes)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.hashes = Substrings(sequence)
        self.found = _Found()

    def short_periods(self) -> None:
        starts, ends, periods = [], [], []
        for q in range(1, 3 * FIRST):
            if len(self.sequence) <= q:
                break
            same = (self.sequence[q:] == self.sequence[:-q]) & (self.row[q:] == self.row[:-q])
            begin, stop = _stretches(same)
            length = stop - begin + q
            # Shorter runs are kept where a scale needs them to tell highly periodic contexts.
            held = (length >= 2 * q) & ((length >= SHORTEST) | (length >= max(FIRST, 3 * q)))
            starts.append(begin[held])
            ends.append(stop[held] + q)
            periods.append(np.full(int(held.sum()), q))
        if starts:
            self.continued(self.found.add(*map(np.concatenate, (starts, ends, periods))))

    def confirmed(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """The runs among the proposals that words from ``at`` on have a ``period``; returns those that are new."""
        row = self.row[at]
        first = self.ends[row] - self.sizes[row]
        after = self.hashes.extended(at, at + period, self.ends[row] - at - period)
        before = self.hashes.extended(at, at + period, at - first, back=True)
        held = before + after >= period
        at, period, before, after = at[held], period[held], before[held], after[held]
        return self.found.add(at - before, at + period + after, period)

    def continued(self, fresh: np.ndarray) -> None:
        """Longer periods of neighbouring highly periodic runs, for the periods of the ``fresh`` ones."""
        while len(fresh):
            fresh = fresh[fresh[:, 1] - fresh[:, 0] >= LONG_POWER * fresh[:, 2]]
            known = self.found.rows
            known = known[(known[:, 1] - known[:, 0] >= LONG_POWER * known[:, 2]) & np.isin(known[:, 2], fresh[:, 2])]
            known = known[np.lexsort((known[:, 0], known[:, 2]))]
            a, b = known[:-1], known[1:]
            touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (self.row[a[:, 0]] == self.row[b[:, 0]])
            a, b = a[touch], b[touch]
            stop, period = a[:, 1], a[:, 2]
            inside = stop + period <= self.ends[self.row[b[:, 0]]]
            a, b, stop, period = a[inside], b[inside], stop[inside], period[inside]
            if not len(a):
                return
            # The one distance between one and two periods that fits the phase of both.
            pair = np.repeat(np.arange(len(a)), period)
            shift = np.arange(len(pair)) - np.repeat(np.cumsum(period) - period, period) + period[pair]
            fits = self.hashes.at(stop[pair] - shift, period[pair]) == self.hashes.at(stop[pair], period[pair])
            pair, shift = pair[fits], shift[fits]
            longest = np.minimum(a[pair, 1] - a[pair, 0], b[pair, 1] - b[pair, 0])
            steps = np.maximum((longest - shift) // period[pair] + 1, 0)
            which = np.repeat(np.arange(len(pair)), steps)
            distance = shift[which] + period[pair[which]] * (np.arange(len(which)) - np.repeat(np.cumsum(steps) - steps, steps))
            which, distance = which[distance >= 3 * FIRST], distance[distance >= 3 * FIRST]
            fresh = self.confirmed(stop[pair[which]] - distance, distance)

    def scale(self, t: int) -> None:
        """Runs with periods from ``3 * t`` to ``6 * t - 1``."""
        texts = int(np.searchsorted(-self.sizes, -6 * t, "right"))
        until = int(self.ends[texts - 1])
        context = words.mixed(self.hashes.windows(until, t))
        context = np.minimum(context, _NEVER - np.uint64(1))
        ends = np.repeat(self.ends[:texts], self.sizes[:texts])[: len(context)]
        places = np.arange(len(context))
        context[places + t > ends] = _NEVER
        runs = self.found.rows
        runs = runs[(runs[:, 1] <= until) & (3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
        if len(runs):
            steps = np.zeros(len(context) + 1, np.int64)
            np.add.at(steps, runs[:, 0], 1)
            np.add.at(steps, runs[:, 1] - t + 1, -1)
            context[np.cumsum(steps)[:-1] > 0] = _NEVER
        least = _least(context, t + 1)
        least[places[: len(least)] + 2 * t > ends[: len(least)]] = 0
        # A start is selected if it is the least of some window around it: if the greatest of those minimums is its own.
        padded = np.concatenate([np.zeros(t, np.uint64), least, np.zeros(len(context) - len(least), np.uint64)])
        greatest = ~_least(~padded, t + 1)
        chosen = np.flatnonzero((greatest == context) & (context != _NEVER))
        value, row = context[chosen], self.row[chosen]
        order = np.lexsort((chosen, value, row))
        chosen, value, row = chosen[order], value[order], row[order]
        left, right = [], []
        live = np.arange(len(chosen))
        ahead = 0
        while len(live):
            ahead += 1
            live = live[live + ahead < len(chosen)]
            other = live + ahead
            near = (value[other] == value[live]) & (row[other] == row[live]) & (chosen[other] - chosen[live] < 6 * t)
            live = live[near]
            far = live[chosen[live + ahead] - chosen[live] >= 3 * t]
            left.append(chosen[far])
            right.append(chosen[far + ahead])
        at = np.concatenate([np.empty(0, np.int64), *left])
        if len(at):
            self.continued(self.confirmed(at, np.concatenate(right) - at))


def found_runs(sequence: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start in its text, length and period of all runs, by text, start and period.

    ``sequence`` holds the codes of all texts, ``sizes`` the number of words of each.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    if (np.diff(sizes) <= 0).all():
        ordered = sequence
    else:
        ordered = np.concatenate([np.empty(0, np.uint64), *[sequence[starts[i] : starts[i] + sizes[i]] for i in order]])
    search = _Search(ordered, sizes[order])
    if len(ordered):
        search.short_periods()
        t = FIRST
        while 6 * t <= sizes[order[0]]:
            search.scale(t)
            t *= 2
    runs = search.found.rows
    runs = runs[runs[:, 1] - runs[:, 0] >= SHORTEST]
    place = search.row[runs[:, 0]]
    text, start = order[place], runs[:, 0] - (search.ends[place] - search.sizes[place])
    by = np.lexsort((runs[:, 2], start, text))
    return text[by], start[by], (runs[:, 1] - runs[:, 0])[by], runs[by, 2]


def _detect(batches: Iterator[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = words.texts(batch)
        at = 0
        while at < len(held):  # bounded blocks, at least one text each
            until, size = at, 0
            while until < len(held) and (until == at or size + len(held[until]) <= BLOCK_BYTES):
                size += len(held[until])
                until += 1
            codes = [words.codes(d) for d in held[at:until]]
            sizes = np.array([len(c) for c in codes], np.int64)
            text, start, length, period = found_runs(np.concatenate(codes), sizes)
            steps = np.zeros(int(sizes.sum()) + 1, np.int64)
            first = np.cumsum(sizes) - sizes
            np.add.at(steps, first[text] + start + period, 1)
            np.add.at(steps, first[text] + start + length, -1)
            kept = np.cumsum(steps)[:-1] == 0
            offsets = np.searchsorted(text, np.arange(until - at + 1))
            collapsed = []
            for i, data in enumerate(held[at:until]):
                parts = data.split()
                if offsets[i] < offsets[i + 1]:
                    parts = [parts[k] for k in np.flatnonzero(kept[first[i] : first[i] + sizes[i]]).tolist()]
                collapsed.append(b" ".join(parts))
            values = pa.StructArray.from_arrays(
                [pa.array(c, pa.int64()) for c in (start, length, period)],
                fields=[pa.field(n, pa.int64(), False) for n in ("start", "length", "period")],
            )
            arrays = [batch.column(c).slice(at, until - at) for c in carried]
            arrays += [
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, "n_words", "runs", "collapsed"])
            at = until


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``keep``, ``n_words``, ``runs`` (start, length, period) and ``collapsed`` text of every row.

    ``collapsed`` leaves out what a run repeats: its words after the first period, joined again by one space. Runs stand by
    start, then period. Null text counts as empty: no words, no runs, an empty text. A null ``doc_id`` stays null;
    repeated rows are searched each; an empty table gives no rows. Texts of any length are searched whole, in memory
    linear in the longest text. Other columns are ignored unless named in ``keep``, which cannot name the result columns.
    """
    needed = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    carried = [f for f in needed.schema if f.name == "doc_id" or f.name in keep]
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    names = [f.name for f in carried]
    return needed.mapInArrow(lambda batches: _detect(batches, names), T.StructType([*carried, *added]))
