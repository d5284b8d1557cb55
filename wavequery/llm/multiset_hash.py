"""Order-independent fingerprints of documents: sums of wide vectors hashed from their paragraphs.

A paragraph (a line that is not empty) is hashed to ``WIDE`` lanes modulo 2**32. In addition, each of its sentences
adds or subtracts 1 in ``SIGNS`` lanes modulo 2**16, by the bits of its hash. The fingerprint of a text is the sum over
its paragraphs: their order does not matter, and adding or removing a paragraph adds or subtracts its vector.

The wide lanes tell texts apart; the squared distance of the signed lanes estimates how many sentences two texts do
not share, so ``1 - distance / (sum of squares)`` is the likeness of their multisets of sentences.

All work is in column expressions. Texts move once, to ranges of ``doc_id`` in which the next document
is a window function away; everything after it stays in its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavequery.operators.running import range_edges, with_range_bucket

WIDE = 16
SIGNS = 120
HALF = SIGNS // 4  # bits of one packed sum's two lanes


def _number(digits: Column, first: int, count: int) -> Column:
    """A number from hex digits."""
    return F.conv(F.substring(digits, first, count), 16, 10).cast("bigint")


def _units(text: Column) -> Column:
    """Paragraphs and sentences of a text."""
    lines = F.filter(F.split(text, "\n"), lambda p: p != "")
    parts = F.filter(
        F.transform(F.split(F.translate(text, ".", "\n"), "\n"), lambda s: F.trim(s)), lambda s: s != ""
    )
    return F.concat(
        F.transform(lines, lambda p: F.struct(F.lit(True).alias("line"), p.alias("words"))),
        F.transform(parts, lambda s: F.struct(F.lit(False).alias("line"), s.alias("words"))),
    )


def sums(texts: DataFrame, by: list[str]) -> DataFrame:
    """Lanes of each text in the column ``text``: ``wide`` and ``signs``, grouped by the columns that name it."""
    units = texts.select(*by, F.explode_outer(_units(F.col("text"))).alias("unit"))
    line, part = F.col("unit.line"), ~F.col("unit.line")
    hashed = units.select(
        *by,
        F.when(line, F.concat(*[F.sha2(F.concat(F.lit(str(i)), "unit.words"), 256) for i in range(2)])).alias("_line"),
        F.when(part, F.md5(F.col("unit.words").cast("binary"))).alias("_part"),
    )
    numbers = hashed.select(*by, "_line", *[_number(F.col("_part"), 1 + 15 * i, 15).alias(f"_bits{i}") for i in range(2)])
    mask = (1 << HALF) | 1
    packed = [
        F.coalesce(F.sum(F.shiftright(f"_bits{i}", j).bitwiseAND(F.lit(mask))), F.lit(0)) for i in range(2) for j in range(HALF)
    ]
    wide = [F.coalesce(F.sum(_number(F.col("_line"), 1 + 8 * i, 8)), F.lit(0)) % F.lit(1 << 32) for i in range(WIDE)]
    held = numbers.groupBy(*by).agg(
        F.count("_bits0").alias("_n"), F.array(*wide).alias("wide"), F.array(*packed).alias("_packed")
    )
    low = F.lit((1 << HALF) - 1)
    both = [
        f(F.slice("_packed", 1 + HALF * i, HALF)) for i in range(2)
        for f in (lambda a: F.transform(a, lambda x: x.bitwiseAND(low)), lambda a: F.transform(a, lambda x: F.shiftright(x, HALF)))
    ]
    signs = F.transform(F.concat(*both), lambda x: _signed(2 * x - F.col("_n")))
    return held.select(*by, "wide", signs.alias("signs"))


def _signed(value: Column) -> Column:
    """A number modulo 2**16, from -2**15."""
    return F.pmod(value + F.lit(1 << 15), F.lit(1 << 16)) - F.lit(1 << 15)


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def fingerprint(wide: str | Column, signs: str | Column) -> Column:
    """The lanes as one string of hex digits."""
    return F.concat(
        F.array_join(F.transform(wide, lambda x: _hex(x, 8)), ""),
        F.array_join(F.transform(signs, lambda x: _hex(F.pmod(x, F.lit(1 << 16)), 4)), ""),
    )


def combined(a: Column, b: Column, minus: bool = False) -> Column:
    """Wide lanes after adding (or removing) the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y if minus else x + y, F.lit(1 << 32)))


def lanes(printed: Column) -> tuple[Column, Column]:
    """The wide lanes and the signs of a fingerprint."""

    def numbers(begin: int, count: int, digits: int) -> Column:
        place = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(place, lambda i: F.conv(F.substring(printed, begin + i * digits, F.lit(digits)), 16, 10).cast("bigint"))

    return numbers(1, WIDE, 8), F.transform(numbers(1 + 8 * WIDE, SIGNS, 4), _signed)


def combined_fingerprint(a: Column, b: Column, minus: bool = False) -> Column:
    """The fingerprint of a text after adding (or removing) the paragraphs of another, from both fingerprints alone.

    It equals the fingerprint of the new text, in any order of its paragraphs, in all lanes. Null if either is null.
    """
    (wide_a, signs_a), (wide_b, signs_b) = lanes(a), lanes(b)
    signs = F.zip_with(signs_a, signs_b, lambda x, y: _signed(x - y if minus else x + y))
    wide = combined(wide_a, wide_b, minus)
    return F.when(a.isNotNull() & b.isNotNull(), fingerprint(wide, signs))


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, x: total + x * x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of sentences that two texts have in common, 0 to 1."""
    apart = _squares(F.zip_with(a, b, lambda x, y: _signed(x - y)))
    both = _squares(a) + _squares(b)
    return F.when(apart == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def beside_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, the text of the next document, and its place: ``_bin``, ``_copy`` and ``_row``.

    The next document has the next smaller ``doc_id``; after the last comes the first. Ranges hold about equally many rows. The
    largest document of a range is copied to the range above it, and the largest of all to the lowest one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = with_range_bucket(rows, "doc_id", range_edges(rows.select("doc_id"), "doc_id"), "_bin")
    tops = ranged.groupBy("_bin").agg(F.max("doc_id").alias("_top"))
    up = Window.orderBy("_bin")  # one row for each range
    lowest = F.min("_bin").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("_bin", "_top", F.coalesce(F.lead("_bin").over(up), lowest).alias("_above"))
    ranged = ranged.join(F.broadcast(tops), "_bin")
    is_top = F.col("doc_id").eqNullSafe(F.col("_top"))
    own = F.struct(F.col("_bin").alias("at"), F.lit(False).alias("copy"))
    above = F.struct(F.col("_above").alias("at"), F.lit(True).alias("copy"))
    places = F.when(is_top, F.array(own, above)).otherwise(F.array(own))
    dealt = ranged.select("doc_id", "text", F.explode(places).alias("_place"))
    dealt = dealt.select("doc_id", "text", F.col("_place.at").alias("_bin"), F.col("_place.copy").alias("_copy"))
    following = Window.partitionBy("_bin").orderBy("_copy", F.col("doc_id").desc(), "text")
    return dealt.select("*", F.lead("text").over(following).alias("_next"), F.row_number().over(following).alias("_row"))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last ``floor(n / 2)`` code points replaced by as many of the next document's first ones, or by
    all of them. Null text counts as empty. Rows without ``doc_id`` come last; rows of one ``doc_id`` follow each
    other in the order of their texts. A single row is its own next document. An empty table gives no rows. Other
    columns are ignored.
    """
    near = beside_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half),
    )
    by = ["_bin", "_copy", "_row", "doc_id", "n_chars", "edited_sha256", "_edited"]
    pairs = near.select(
        "_bin", "_copy", "_row", "doc_id", "n_chars", edited.alias("_new"), F.sha2(edited, 256).alias("edited_sha256"), "text"
    )
    both = F.array(
        F.struct(F.lit(False).alias("_edited"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("_edited"), F.col("_new").alias("text")),
    )
    texts = pairs.select(*by[:-1], F.inline(both))
    lanes = sums(texts, by)
    own = {c: F.max(F.when(~F.col("_edited"), F.col(c))).alias(c) for c in ("wide", "signs")}
    new = {c: F.max(F.when(F.col("_edited"), F.col(c))).alias(f"_{c}") for c in ("wide", "signs")}
    one = lanes.groupBy(*by[:-1]).agg(*own.values(), *new.values())
    following = Window.partitionBy("_bin").orderBy("_row")
    one = one.select("*", F.lead("signs").over(following).alias("_beside")).where(~F.col("_copy"))
    return one.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint("wide", "signs").alias("fingerprint"),
        fingerprint("_wide", "_signs").alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("_beside")).alias("near_next"),
    )
