"""All queries of the text operators. Importing the query modules registers them."""

from __future__ import annotations

import importlib

from wavequery.llm.registry import ORACLES, QUERIES

_MODULES = ("text_queries", "dedup_queries", "token_queries", "structure_queries")


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"wavequery.llm.{module}")


def queries():
    _load()
    return QUERIES


def oracles():
    _load()
    return ORACLES
