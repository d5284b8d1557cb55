"""Hash split shared by several queries, as SQL text and as columns."""

from __future__ import annotations

from wavequery.operators.splits import hash_split

VAL_SHARE, TEST_SHARE = 0.15, 0.15

UNIT_SQL = "CAST(CAST('0x' || substr(sha1({text}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE"


def split_case(text: str, val: float = VAL_SHARE, test: float = TEST_SHARE) -> str:
    unit = UNIT_SQL.format(text=text)
    return f"CASE WHEN {unit} < {val}::DOUBLE THEN 'val' WHEN {unit} < {val + test}::DOUBLE THEN 'test' ELSE 'train' END"


HASH_SPLIT_CASE = split_case("CAST(file_id AS VARCHAR) || '|' || CAST(start_us AS VARCHAR)")


def hash_subset(rows, keys=("file_id", "start_us")):
    return hash_split(rows, keys, VAL_SHARE, TEST_SHARE)
