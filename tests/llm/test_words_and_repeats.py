"""Operators on word sequences against brute force."""

import random

import numpy as np
import pytest

from wavequery.llm import minhash, quality, stages, substring_dedup, words

ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "no id at all here"), (5, "one"), (5, "one")]
SCHEMA = "doc_id bigint, text string, n_words string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(3)


def text(rnd, n, letters="abcdefgh"):
    return "".join(rnd.choice(letters) + rnd.choice([" ", " ", "\n"]) for _ in range(n))


def test_rolling_hash_equals_for_equal_windows():
    sequence = words.codes(b"a b c a b c d")
    found = words.rolling(sequence, 3)
    assert len(found) == 5 and found[0] == found[3] and len(set(found.tolist())) == 4
    assert len(words.rolling(sequence, 8)) == 0


def test_longest_repeats_match_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        docs = [[rnd.randrange(3) for _ in range(rnd.randrange(25))] for _ in range(rnd.randrange(1, 4))]
        sequence, row, _ = words.joined([np.array([x * 7919 + 13 for x in d], np.uint64) for d in docs])
        want = [
            max([0] + [n for n in range(1, len(d) - p + 1) if any(d[o : o + n] == d[p : p + n] for o in range(len(d) - n + 1) if o != p)])
            for d in docs
            for p in range(len(d))
        ]
        assert quality.repeats(sequence, row).tolist() == want


def test_quality_edge_cases(spark):
    rows = {(r.doc_id, r.n_words, r.kept) for r in quality.judged(quality.measure(frame(spark, ODD))).collect()}
    assert rows == {(1, 0, False), (2, 0, False), (3, 0, False), (None, 5, False), (5, 1, False)}
    assert quality.measure(frame(spark, []).limit(0)).count() == 0


def test_quality_verdicts(spark):
    fresh = " ".join(f"w{i}" for i in range(300))
    twice = " ".join(f"w{i}" for i in range(120)) + " " + fresh
    line = "\n".join(["the same line again and again"] * 40)
    got = {r.doc_id: r for r in quality.judged(quality.measure(frame(spark, [(1, fresh), (2, twice), (3, line)]))).collect()}
    assert got[1].kept and got[1].longest_repeat == 0
    assert got[2].longest_repeat == 120 and not got[2].kept and got[2].n_covered_words == 240
    assert got[3].base_failed and got[3].n_dup_lines == 39


def test_covered_share_alone_rejects(spark):
    fresh = " ".join(f"w{i}" for i in range(400))
    passage = " ".join(f"p{i}" for i in range(90))
    half = passage + " " + " ".join(f"w{i}" for i in range(220)) + " " + passage
    once = " ".join(f"p{i}" for i in range(12)) + " " + fresh + " " + " ".join(f"p{i}" for i in range(12))
    got = {r.doc_id: r for r in quality.judged(quality.measure(frame(spark, [(1, half), (2, once)]))).collect()}
    assert (got[1].n_words, got[1].n_covered_words, got[1].longest_repeat) == (400, 180, 90)
    assert not got[1].base_failed and not got[1].kept
    assert got[2].n_covered_words == 24 and got[2].kept


def brute_removal(rows, width):
    first, out = {}, {}
    split = {i: (t or "").split() for i, t in rows}
    for i in sorted(split):
        for s in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][s : s + width]), (i, s))
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (i, s):
                gone[s : s + width] = [True] * width
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    shared = [text(rnd, 12) for _ in range(4)]
    rows = [(i * 3, text(rnd, rnd.randrange(30), "abc") + rnd.choice(shared) * rnd.randrange(3) + text(rnd, 9)) for i in range(60)]
    got = substring_dedup.remove_repeats(frame(spark, rows), 5).collect()
    want = brute_removal(rows, 5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text.split()) for r in got} == want
    for r in got:
        assert sum(s.end - s.begin for s in r.removed) == r.n_removed


def test_removal_across_many_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, text(rnd, 40, "ab")) for i in range(40)]
    assert len(rows) == 40
    got = substring_dedup.remove_repeats(frame(spark, rows).repartition(9), 8).collect()
    want = brute_removal(rows, 8)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {i: w[:2] for i, w in want.items()}


def test_removal_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [*ODD, (7, long), (7, long), (None, long), (8, long)]
    got = sorted(
        [(r.doc_id or -1, r.text, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()],
        key=str,
    )
    want = [(-1, "no id at all here", 0), (-1, long, 0), (1, None, 0), (2, "", 0), (3, "   \n\t ", 0), (5, "one", 0), (5, "one", 0)]
    want += [(7, long, 0), (7, long, 0), (8, "", 30)]
    assert got == sorted(want, key=str)
    assert substring_dedup.remove_repeats(frame(spark, ODD).limit(0)).count() == 0


def brute_components(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    label = {k: low if v in (label[a], label[b]) else v for k, v in label.items()}
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for family in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([6, 20, 60, 300]))]
        for _ in range(rnd.randrange(1, 12)):
            copy = base[:]
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(99)}"
            rows.append((len(rows) * 2 + 1, " ".join(copy)))
    rnd.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.linked(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicate_edge_cases(spark):
    got = sorted([(r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.linked(frame(spark, ODD)).collect()])
    assert got == [(-1, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True)]
    assert minhash.linked(frame(spark, ODD).limit(0)).count() == 0


def test_estimate_follows_similarity():
    rnd = np.random.default_rng(3)
    for share in (0.5, 0.85):
        errors = []
        for _ in range(40):
            both = rnd.integers(0, 2**63, 1000).astype(np.uint64)
            own = rnd.integers(0, 2**63, (2, round(1000 * (1 / share - 1) / 2))).astype(np.uint64)
            a, b = (minhash.sketch(np.concatenate([both, o])) for o in own)
            n = np.array([1000 + own.shape[1]])
            errors.append(minhash.estimate(a[None], b[None], n, n)[0][0] - share)
        assert abs(np.mean(errors)) < 0.03


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in stages.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
