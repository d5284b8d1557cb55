"""All named queries. Importing the plan modules registers them."""

from __future__ import annotations

import importlib

from wavequery.plans.registry import ORACLES, QUERIES

_MODULES = (
    "source_plans",
    "check_plans",
    "timejoin_plans",
    "frame_plans",
    "ranking_plans",
    "summary_plans",
    "split_plans",
    "template_plans",
    "signal_plans",
    "model_plans",
    "streaming_plans",
    "flow_plans",
)


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"wavequery.plans.{module}")


def queries():
    _load()
    return QUERIES


def oracles():
    _load()
    return ORACLES
