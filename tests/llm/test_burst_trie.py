"""Prefix tries of conversations against a plain trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from wavequery.llm import burst_trie, catalogue, stages
from wavequery.llm.structure_queries import recombined

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, box int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def plain_trie(convs):
    """``convs``: turns by id. One tuple per node, as ``NODE_COLUMNS``."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], sha(ends[n]),
        )
        for n, m in members.items()
    )


def nodes_of(df):
    assert df.columns == burst_trie.NODE_COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def ordered(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held[c].append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t for *_, t in sorted(v)] for c, v in held.items()}


def made(rnd, n):
    rows, shared = [], [[(rnd.choice("ua"), "é" * rnd.randrange(4)) for _ in range(9)] for _ in range(3)]
    for c in range(n):
        turns = list(rnd.choice(shared)[: rnd.randrange(1, 10)])
        turns += [(rnd.choice("ua"), rnd.choice(["x", "yy", ""])) for _ in range(rnd.randrange(3))]
        rows += [(c, i * 2, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("limit", [1, 3, 20, 4096])
def test_bursting_at_any_limit_gives_the_same_trie(spark, limit):
    rows = made(random.Random(1), 120)
    convs = stages.written(burst_trie.sequences(frame(spark, rows)), "convs")
    assert nodes_of(burst_trie.trie(convs, limit)) == plain_trie(ordered(rows))


def test_containers_burst_by_bytes_and_cold_ones_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(burst_trie, "HOT", 2)
    monkeypatch.setattr(burst_trie, "ID_SPAN", 7)
    rows = made(random.Random(2), 90)
    got = nodes_of(burst_trie.trie(burst_trie.sequences(frame(spark, rows)), limit_bytes=100))
    assert got == plain_trie(ordered(rows))


def test_one_long_conversation_copied_and_cut(spark):
    turns = [("u", f"turn {i}") for i in range(300)]
    rows = [(c, i, *t) for c in range(30) for i, t in enumerate(turns[: 300 - 9 * (c % 10)])]
    want = plain_trie(ordered(rows))
    assert nodes_of(burst_trie.trie(burst_trie.sequences(frame(spark, rows)), 4)) == want
    assert nodes_of(burst_trie.trie(burst_trie.sequences(frame(spark, rows)))) == want


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (None, 1, "u", "lost"),
        (2, None, "", ""), (3, 5, "ua", ""), (4, 5, "u", "a"), (2**40, 0, None, "\0x"), (5, -1, "u", None), (5, 7, "", "z" * 100_000),
    ]
    got = nodes_of(burst_trie.trie(burst_trie.sequences(frame(spark, rows))))
    assert got == plain_trie(ordered(rows))
    assert nodes_of(burst_trie.trie(burst_trie.sequences(frame(spark, rows)), 1)) == got
    assert burst_trie.trie(burst_trie.sequences(frame(spark, rows).limit(0))).count() == 0


def with_odd_bases(rnd):
    rows = [(c, i, r, t) for c, i, r, t in made(rnd, 260) if c not in (100, 101)]
    rows += [(c, 0, "u", "alone") for c in (700, 705, 733, 7_000_012)] + [(900, i, "u", f"t{i}") for i in range(3)]
    return rows + [(c, 0, None, None) for c in range(901, 960)]


def test_query_equals_plain_tries_and_its_sql(spark, tmp_path, monkeypatch):
    rows = with_odd_bases(random.Random(3))
    held = ordered(rows)
    want = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = held.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes_of(catalogue.queries()["op12_burst_trie"](spark, str(tmp_path))) == plain_trie(want)
    assert nodes_of(burst_trie.trie(recombined(burst_trie.sequences(frame(spark, rows))), 5)) == plain_trie(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = con.execute(catalogue.oracles()["op12_burst_trie"]).fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == plain_trie(want)
