"""Token operators against the tokenizers library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavequery.llm import bpe, byte_tokens, packing, sharding, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbé  \n\tÀß19'sS’😀́　 \x1cΣς.,#한"


def odd_texts(n=300):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(50))) for _ in range(n)]
    return [*texts, "", "  ", "a" * 3000, " <|endoftext|>a<|startoftext|> b", "don't CAN'T we'LL", "internationalization"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id bigint, text string, start int").repartition(3)


EDGE = [(1, None), (2, ""), (None, "hello there"), (4, "same"), (4, "same")]


def test_word_bpe_equals_library(spark):
    library = Tokenizer.from_file(WORDS)
    rows = list(enumerate(odd_texts()))
    for r in bpe.encoded(frame(spark, rows)).collect():
        ids = library.encode(rows[r.doc_id][1], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_heap_and_scan_merge_alike():
    one, rnd = bpe.load(WORDS), random.Random(4)
    for _ in range(300):
        parts = [one.inner[rnd.randrange(97, 110)] for _ in range(rnd.randrange(1, 40))]
        assert one.scanned(parts[:]) == one.heaped(parts[:])


def test_byte_ids_equal_library():
    library = Tokenizer.from_file(BYTES)
    for text in [*odd_texts(), " " * 20000 + "a"]:
        assert byte_tokens.encode(text, BYTES).tolist() == library.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts, window):
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc_id, pieces in docs.items():
        ids = np.append(byte_tokens.encode(texts[doc_id] or "", BYTES), np.uint32(0)).astype("<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in windows.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0


def test_packing_holds_every_id_once_without_padding(spark):
    rnd = random.Random(8)
    texts = {i: " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(90))) for i in range(200)} | {998: None, 999: "x " * 900}
    check_pieces(packing.packed(frame(spark, list(texts.items())), BYTES, 64).collect(), texts, 64)


def test_packing_edge_cases(spark):
    assert packing.packed(frame(spark, EDGE), BYTES).groupBy("doc_id").count().count() == 4
    assert packing.packed(frame(spark, EDGE).limit(0), BYTES).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_most_tails_are_in_windows_that_the_rule_filled(seed):
    """A stream of 1,250 documents, as in one of 8 partitions of the largest test table."""
    rnd, packer, placed, total = random.Random(seed), packing.Packer(most_open=packing.MOST_OPEN), 0, 0
    for n in range(1250):
        size = rnd.randrange(1, 1024) if rnd.random() < 0.7 else rnd.randrange(1, 90)
        total += size
        full = packer.place(((n, size), 0, np.full(size, n, np.uint32)))
        for window in full:
            assert sum(len(ids) for _, _, ids in window) == packing.WINDOW
            placed += packing.WINDOW
        assert packer.count == sum(map(len, packer.open)) == packer.level.sum() <= packing.MOST_OPEN
    poured = list(packer.pour())
    assert placed + sum(len(ids) for window in poured for _, _, ids in window) == total
    assert placed >= 0.95 * total  # the aim is 90 % at least


def test_cuts_follow_the_rule_too():
    packer, rnd, cuts = packing.Packer(64, 5), random.Random(3), 0
    for n in range(400):
        before, count = packer.level.copy(), packer.count
        size = rnd.randrange(1, 64)
        full = packer.place(("d", n, np.zeros(size, np.uint32)))
        if count < 5 or len(full) != 1:
            continue

        def cost(h):
            level = before.copy()
            level[h] -= h > 0
            at = h + size if h + size <= 64 else h + size - 64
            level[at] += at < 64
            return int((level[1:64] ** 2).sum())

        cuts += 1
        assert int((packer.level[1:64] ** 2).sum()) <= min(cost(h) for h in range(1, 64) if before[h])
    assert cuts > 100


def test_packer_takes_the_level_of_least_squares():
    packer, rnd = packing.Packer(16), random.Random(2)
    for n in range(300):
        before = packer.level.copy()
        size = rnd.randrange(1, 16)
        packer.place(("d", n, np.zeros(size, np.uint32)))

        def cost(level):
            return int((level[1:16] ** 2).sum())

        best = []
        for h in [0, *[h for h in range(1, 17 - size) if before[h]]]:
            level = before.copy()
            level[h] -= h > 0
            level[h + size] += h + size < 16
            best.append(cost(level))
        assert cost(packer.level) == min(best)


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_counts_across_blocks(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(token_counts, "SCAN_BLOCKS", 3)
    rows = [(i, "word " * (i % 5)) for i in range(12)] + [(50, None)]
    blocks = token_counts.flat_blocks(frame(spark, rows), BYTES, block_bytes).drop("began").persist()
    got = sorted(r.n_tokens for r in token_counts.stitched(token_counts.scanned(blocks, 50256)).collect())
    assert got == sorted(len(byte_tokens.encode(t or "", BYTES)) for _, t in rows)


def test_counts_by_document(spark):
    rows = [*[(i, t) for i, t in enumerate(odd_texts(50))], (900, None), (None, "x")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_counts.counted(frame(spark, rows), BYTES).collect())
    want = [(-1 if i is None else i, len(byte_tokens.encode(t or "", BYTES, special=False))) for i, t in rows]
    assert got == sorted(want)
    assert token_counts.counted(frame(spark, rows).limit(0), BYTES).count() == 0


def test_flat_files_with_an_open_end(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], "<u2").tofile(tmp_path / "a.bin")
    np.array([9, 1, 2, 3], "<u2").tofile(tmp_path / "b.bin")
    found = token_counts.stitched(token_counts.scanned(token_counts.read_flat(spark, str(tmp_path), 4), 9)).collect()
    got = {(r.file[-5:], r.ordinal): (r.n_tokens, r.closed) for r in found}
    assert got == {
        ("a.bin", 0): (2, True), ("a.bin", 1): (0, True), ("a.bin", 2): (1, False), ("b.bin", 0): (0, True), ("b.bin", 1): (3, False)
    }


def test_shards_fit_and_split_only_where_needed(spark):
    rnd = random.Random(6)
    rows = [(i, "x" * rnd.randrange(200)) for i in range(400)] + [(77, "y" * 40)] * 30 + [(500, "z" * 3000), (None, None)]
    got = sharding.assigned(frame(spark, rows), 1000).collect()
    assert len(got) == len(rows)
    pages = defaultdict(list)
    for r in got:
        pages[r.shard, r.page].append(r.n_bytes)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in pages.values())
    shards = {r.shard: r.shard_bytes for r in got}
    for shard in shards:  # the directory is prefix free, and no split was needless
        assert not any(other != shard and other.startswith(shard) for other in shards)
        if shard:
            assert sum(b for s, b in shards.items() if s.startswith(shard[:-1])) > 1000
    assert sharding.assigned(frame(spark, EDGE).limit(0), 10).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, f"no id {i}", i) for i in range(30)] + [(7, "one text", 1), (7, "another text", 2)]
    rows += [(8, "copy" * 10, i) for i in range(50)] + [(9, "x" * 150, 1), (None, None, 1)] + [(100 + i, f"text {i}" * 3, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    sharding.write(df, str(tmp_path / "out"), 100)
    got = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(str(tmp_path / "out"))
    found = got.collect()
    assert sorted(map(str, [(r.doc_id, r.text, r.n) for r in found])) == sorted(map(str, rows))
    sizes = defaultdict(list)
    for r in got.select("*", "_metadata.file_path").collect():
        sizes[r.file_path.rpartition("/")[0]].append(len(r.text or ""))
    assert all(sum(s) <= 100 or len(s) == 1 for s in sizes.values())
    want = {(r.shard, r.page) for r in sharding.assigned(df, 100).collect()}
    assert len(sizes) == len(want)


def test_flat_files_of_more_than_two_gb(spark, tmp_path):
    folder = tmp_path / "a b#?%20"
    folder.mkdir()
    size = (2 << 30) + 6
    with open(folder / "large.bin", "wb") as f:  # sparse
        f.seek(size - 4)
        f.write(np.array([9, 5], "<u2").tobytes())
    (folder / "small.bin").write_bytes(np.array([1, 2, 9, 3], "<u2").tobytes())
    (folder / "empty.bin").write_bytes(b"")
    pattern = str(tmp_path / "a b*")
    blocks = token_counts.read_flat(spark, pattern, 64 << 20)
    found = token_counts.stitched(token_counts.scanned(blocks, 9)).collect()
    assert sorted((r.n_tokens, r.closed) for r in found) == [(1, False), (1, False), (2, True), (size // 2 - 2, True)]
    assert blocks.rdd.getNumPartitions() >= 8
