"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wavequery.llm import catalogue, periods, words

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 7), (5, "x"), (5, "x"), (6, "z " * 12)]


def plain_runs(text):
    found = {}
    for q in range(1, len(text) // 2 + 1):
        at = 0
        while at + q < len(text):
            if text[at] != text[at + q]:
                at += 1
                continue
            start = at
            while at + q < len(text) and text[at] == text[at + q]:
                at += 1
            if at + q - start >= max(12, 2 * q):
                found.setdefault((start, at + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(text, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(text) if i not in gone]


def made(rnd):
    kind, letters = rnd.randrange(7), rnd.choice(["ab", "abcd"])
    n = rnd.randrange(1, 220)
    if kind == 0:
        return [rnd.choice(letters) for _ in range(n)]
    if kind == 1:  # Fibonacci words hold runs of many periods
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    if kind == 2:
        unit = [rnd.choice(letters) for _ in range(rnd.randrange(1, 50))]
        return list("xyz") + unit * rnd.randrange(1, 6) + unit[: rnd.randrange(len(unit) + 1)] + list("zyx")
    if kind == 3:  # long runs that touch out of phase
        p = rnd.choice(["ab", "aab", "abc", "abaab"])
        return list(p * rnd.randrange(1, 40) + p[: rnd.randrange(len(p))] + (p * rnd.randrange(1, 40))[rnd.randrange(len(p)) :])
    if kind == 4:
        unit = "a" * rnd.randrange(1, 50) + "b" * rnd.randrange(0, 30) + "ab" * rnd.randrange(0, 30)
        return list(unit * rnd.randrange(1, 5))
    if kind == 5:  # the halves of a Thue-Morse word have equal sums
        t = ["a"]
        while len(t) < n:
            t = t + ["b" if x == "a" else "a" for x in t]
        return t[:n]
    unit = list((rnd.choice(["ab", "aab"]) * 30)[: rnd.randrange(20, 60)])
    return (unit * rnd.randrange(2, 4) + list("c" * rnd.randrange(2))) * rnd.randrange(1, 3)


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_a_plain_search(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        texts = [made(rnd) for _ in range(rnd.randrange(1, 7))] + [[]]
        codes = [words.codes(" ".join(t).encode()) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        got = [[] for _ in texts]
        for text, *run in zip(*(c.tolist() for c in periods.found_runs(np.concatenate(codes), sizes)), strict=True):
            got[text].append(tuple(run))
        assert got == [plain_runs(t) for t in texts]


def test_long_texts_of_every_kind():
    rnd = np.random.default_rng(3)
    unit = rnd.integers(0, 1 << 40, 100_000)
    one = words.mixed(np.concatenate([unit, unit, unit[:777], [1 << 50]]).astype(np.uint64))
    text, start, length, period = periods.found_runs(one, np.array([len(one)]))
    assert (text.tolist(), start.tolist(), length.tolist(), period.tolist()) == ([0], [0], [200_777], [100_000])
    same = np.full(300_000, 7, np.uint64)
    assert [c.tolist() for c in periods.found_runs(same, np.array([300_000]))] == [[0], [0], [300_000], [1]]


def test_edge_rows(spark):
    schema = "doc_id bigint, text string, runs string, n_words int, kind string"
    frame = spark.createDataFrame([(i, t, "r", 9, "k") for i, t in ODD], schema).repartition(3)
    rows = periods.periodic_runs(frame, keep=("kind",)).collect()
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.kind) for r in rows), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (0, 14, [(0, 14, 2)], "a b"), (5, 1, [], "x"), (5, 1, [], "x")]
    want.append((6, 12, [(0, 12, 1)], "z"))
    assert got == sorted(((*w, "k") for w in want), key=str)
    assert periods.periodic_runs(frame.limit(0)).count() == 0


def test_query_equals_a_plain_search_over_planted_periods(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, None if i % 17 == 0 else " \n".join(made(rnd))) for i in range(160)] + [(None, "a " * 30), (3, "b c " * 9)]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = max(((length, -s, -q) for s, length, q in runs), default=None)
        first = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
        digests = (
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(collapsed(w, runs)).encode()).hexdigest(),
        )
        want.append((doc_id, len(runs), *first, *digests))
    got = catalogue.queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
