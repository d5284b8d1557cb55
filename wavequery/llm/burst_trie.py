"""Prefix trie over conversations, built by bursting containers.

A turn is a fixed-width symbol: the digest of its role and text, then the number of code points of its text. A conversation is the
bytes of its symbols, so that a prefix is a prefix of bytes and containers sort as bytes do. Equal conversations are one row with a
count, and with the digest of their ids.

All rows start in one container below the root. A container with more than ``LIMIT`` rows or ``LIMIT_BYTES`` bursts: what all its rows
share becomes a chain of trie heads, and its rows go to new containers by their next turn. What has not burst at the end is sorted
and swept into nodes, container by container. The subtree totals of the heads are the sums over the containers and
heads below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequery.llm import stages

LIMIT = 4096  # distinct conversations of a container
LIMIT_BYTES = 16 << 20  # of their symbols
HOT = 1000  # a container with more than 1 / HOT of all rows is hot; so there are at most HOT of them
ID_SPAN = 4096  # ids that are joined before they meet the rest of their group

_WIDTH, _DIGEST = 20, 16
_NOTHING = hashlib.sha256().hexdigest()
_NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, up array<string>"
)
NODE_COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def symbol(role: Column, text: Column) -> Column:
    """A turn as 40 hexadecimal digits; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(digest, F.lpad(F.hex(F.length(text)), 2 * (_WIDTH - _DIGEST), "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``symbols`` (bytes) of each conversation, by ``turn``, null first.

    Turns of equal number go by their symbol; repeated turns stay. Turns without a ``conv_id`` belong to no conversation
    and are left out. The symbols of one conversation, 20 bytes a turn, are one value.
    """
    coded = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), F.struct("turn", symbol(F.col("role"), F.col("text")).alias("symbol")).alias("_turn")
    )
    ordered = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return ordered.select("conv_id", F.unhex(F.array_join("_turns.symbol", "")).alias("symbols"))


def first_turns(symbols: Column, n: Column) -> Column:
    """The first ``n`` turns."""
    return F.substring(symbols, F.lit(1), (_WIDTH * n).cast("int"))


def later_turns(symbols: Column, n: Column) -> Column:
    """All turns but the first ``n``."""
    return F.substring(symbols, (_WIDTH * n + 1).cast("int"), F.length(symbols))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids of each group, whose parts come one after the other."""
    names = ["symbols", "first", "members", "ends"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    key, first, members, digest = None, None, 0, None
    done: list[tuple] = []
    for batch in batches:
        for value, low, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if value != key or digest is None:
                if digest is not None:
                    done.append((key, first, members, digest.hexdigest()))
                key, first, members, digest = value, low, n, hashlib.sha256(ids.encode())
            else:
                members += n
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)
            done = []
    if digest is not None:
        row = (key, first, members, digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``symbols``, ``first`` (smallest id), ``members`` and ``ends`` (digest of their ids) of equal conversations.

    Ids are joined by spans first, so a large group meets in one task as few long strings, which pass through the
    digest one at a time.
    """
    span = F.floor(F.col("conv_id") / ID_SPAN).alias("_span")
    parts = convs.groupBy("symbols", span).agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    parts = parts.repartition("symbols").sortWithinPartitions("symbols", "_span")
    ids = F.array_join(F.col("_ids").cast("array<string>"), ",")
    parts = parts.select("symbols", F.col("_ids")[0].alias("first"), F.size("_ids").cast("bigint").alias("n"), ids.alias("ids"))
    return parts.mapInArrow(_ends, "symbols binary, first bigint, members bigint, ends string")


class _Container:
    """Nodes of one container, from its rows in the order of their symbols."""

    def __init__(self, depth: int, above: int | None, up: list[str]):
        self.base, self.above, self.up = depth, above, up
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.chars: list[int] = []
        self.first: list[int | None] = []
        self.members: list[int] = []
        self.children: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.ends: list[str] = []
        self.path: list[int] = []
        self.before = b""

    def _open(self, symbols: bytes, depth: int) -> None:
        self.parent.append(self.path[-1] if self.path else -1)
        self.path.append(len(self.depth))
        self.depth.append(depth)
        at = _WIDTH * depth
        self.chars.append(int.from_bytes(symbols[at - _WIDTH + _DIGEST : at], "big") if depth else 0)
        for column, value in (
            (self.first, None), (self.members, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, _NOTHING)
        ):
            column.append(value)

    def _close(self) -> None:
        node = self.path.pop()
        if not self.children[node]:
            self.leaves[node] = 1
        self.saved[node] += (self.members[node] - 1) * self.chars[node]
        up = self.parent[node]
        if up >= 0:
            self.children[up] += 1
            self.members[up] += self.members[node]
            self.leaves[up] += self.leaves[node]
            self.saved[up] += self.saved[node]
            if self.first[up] is None or self.first[node] < self.first[up]:
                self.first[up] = self.first[node]

    def add(self, symbols: bytes, members: int, first: int, ends: str) -> None:
        depth, shared = len(symbols) // _WIDTH, self.base
        if not self.path:
            self._open(symbols, self.base)
        else:
            most = min(depth, len(self.before) // _WIDTH)
            while shared < most and symbols[_WIDTH * shared : _WIDTH * (shared + 1)] == self.before[_WIDTH * shared : _WIDTH * (shared + 1)]:
                shared += 1
            while self.depth[self.path[-1]] > shared:
                self._close()
        for d in range(shared + 1, depth + 1):
            self._open(symbols, d)
        node = self.path[-1]
        self.members[node] += members
        self.first[node] = first
        self.ends[node] = ends
        self.before = symbols

    def rows(self) -> Iterator[tuple]:
        while self.path:
            self._close()
        for i, up in enumerate(self.parent):
            yield (
                self.first[i], self.depth[i], self.first[up] if up >= 0 else self.above, self.members[i], self.children[i],
                self.leaves[i], self.saved[i], self.ends[i], None if up >= 0 else self.up,
            )


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.string())]
    names = [*NODE_COLUMNS, "up"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    box, held, rows = None, None, []
    for batch in batches:
        for key, depth, above, up, symbols, members, first, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or key != box:
                if held is not None:
                    rows.extend(held.rows())
                    if len(rows) > 20_000:
                        yield made(rows)
                        rows = []
                box, held = key, _Container(depth, above, up)
            held.add(symbols, members, first, ends)
    if held is not None:
        yield made([*rows, *held.rows()])


def _burst(rows: DataFrame, limit: int, limit_bytes: int) -> DataFrame:
    """The containers that burst: what their rows share, from the least and the greatest of them."""
    sizes = rows.groupBy("box", "depth", "above", "up").agg(
        F.count("*").alias("n"),
        F.sum(F.length("symbols") - _WIDTH * F.col("depth")).alias("_bytes"),
        F.sum("members").alias("members"),
        F.min("first").alias("first"),
        F.min(F.struct("symbols", "ends")).alias("_low"),
        F.max("symbols").alias("_high"),
    )
    large = sizes.where(f"n > 1 AND (n > {limit} OR _bytes > {limit_bytes})").withColumn("_least", F.col("_low.symbols"))
    turn = "substring({0}, {1} * k + 1, {1})"
    differs = f"{turn.format('_least', _WIDTH)} != {turn.format('_high', _WIDTH)}"
    most = f"length(_least) div {_WIDTH}"
    shared = F.expr(f"array_min(filter(sequence(depth, cast({most} AS int)), k -> k = {most} OR {differs}))")
    large = large.withColumn("reach", shared)
    chain = first_turns(F.col("_least"), F.col("reach"))
    ended = F.when(F.length("_least") == _WIDTH * F.col("reach"), F.col("_low.ends")).otherwise(_NOTHING)
    return large.select(
        "box", "depth", "above", "up", "n", "members", "first", "reach", chain.alias("chain"), F.md5(chain).alias("head"), ended.alias("ends")
    )


def _heads(bursts: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of all chains, with the totals of what lies below them."""
    turn_chars = f"cast(conv(hex(substring(chain, {_WIDTH} * (k - 1) + {_DIGEST + 1}, {_WIDTH - _DIGEST})), 16, 10) AS bigint)"
    # By depth, from the head of the chain on; the root has no text.
    chars = F.expr(f"transform(sequence(depth, reach), k -> CASE WHEN k = 0 THEN 0L ELSE {turn_chars} END)")
    bursts = bursts.withColumn("_saved", F.transform(chars, lambda c: c * (F.col("members") - 1)))
    own = F.aggregate("_saved", F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = tops.select("up", F.col("n_leaves").alias("_l"), F.col("saved_tokens").alias("_s")).union(
        bursts.select("up", F.lit(0).cast("bigint"), own)
    )
    parts = parts.select("_l", "_s", F.size("up").alias("_n"), F.posexplode("up").alias("_i", "head"))
    direct = F.when(F.col("_i") == F.col("_n") - 1, 1).otherwise(0)
    below = parts.groupBy("head").agg(F.sum("_l").alias("n_leaves"), F.sum("_s").alias("_below"), F.sum(direct).alias("_children"))
    placed = bursts.join(below, "head").select("*", F.posexplode("_saved").alias("_at", "_"))
    depth = F.col("depth") + F.col("_at")
    last = depth == F.col("reach")
    rest = F.aggregate(F.slice("_saved", F.col("_at") + 1, F.size("_saved")), F.col("_below"), lambda a, x: a + x)
    return placed.select(
        F.col("first").alias("conv_id"),
        depth.cast("bigint").alias("depth"),
        F.when(F.col("_at") == 0, F.col("above")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last, F.col("_children")).otherwise(1).cast("bigint").alias("n_children"),
        "n_leaves",
        rest.alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(_NOTHING).alias("ends_sha256"),
    )


def trie(convs: DataFrame, limit: int = LIMIT, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """The nodes of the prefix trie of ``convs`` (``conv_id``, once each, and ``symbols``).

    A node is named by its smallest member and its depth. ``n_children`` and ``n_leaves`` count children and childless nodes of
    its subtree, itself included; ``saved_tokens`` sums, over its subtree, the code points that members beyond the first share;
    ``ends_sha256`` is the digest of the ids of the members that end there. The root has no parent and depth 0. Equality of turns is by
    128-bit digest. An empty table has no nodes; other columns are ignored.
    """
    start = distinct_sequences(convs.select("conv_id", "symbols"))
    rows = stages.written(
        start.select(
            F.lit("").alias("box"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("above"),
            F.array().cast("array<string>").alias("up"), "symbols", "members", "first", "ends",
        ),
        "containers",
    )
    columns = rows.columns
    settled, all_bursts = [], []
    while True:
        bursts = stages.written(_burst(rows, limit, limit_bytes), "bursts")
        if bursts.isEmpty():
            settled.append(rows)
            break
        all_bursts.append(bursts)
        to = bursts.select("box", "n", F.col("first").alias("_first"), F.col("reach").alias("_reach"), "head")
        total = rows.count()
        hot = F.broadcast(to.where(F.col("n") * HOT > total))
        cold = to.where(F.col("n") * HOT <= total)
        marked = rows.join(hot, "box").unionByName(
            rows.join(hot.select("box"), "box", "left_anti").join(cold, "box", "left"), allowMissingColumns=True
        )
        marked = stages.written(marked, "containers")
        settled.append(marked.where("head IS NULL").select(*columns))
        depth = F.col("_reach") + 1
        rows = marked.where(f"head IS NOT NULL AND length(symbols) > {_WIDTH} * _reach").select(
            F.md5(first_turns(F.col("symbols"), depth)).alias("box"), depth.alias("depth"), F.col("_first").alias("above"),
            F.concat("up", F.array("head")).alias("up"), "symbols", "members", "first", "ends",
        )
    kept = settled[0]
    for more in settled[1:]:
        kept = kept.union(more)
    swept = kept.repartition("box").sortWithinPartitions("box", "symbols").mapInArrow(_swept, _NODE)
    if not all_bursts:
        return swept.select(*NODE_COLUMNS)
    swept = stages.written(swept, "trie_nodes")
    heads = all_bursts[0]
    for more in all_bursts[1:]:
        heads = heads.union(more)
    return swept.select(*NODE_COLUMNS).union(_heads(heads, swept.where("up IS NOT NULL")))
