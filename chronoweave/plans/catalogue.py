"""Imports every plan module so that its queries are registered."""

from __future__ import annotations

import importlib

from chronoweave.plans import registry

MODULES = ["source_plans", "text_plans", "mining_plans", "caption_plans", "catalog_plans", "table_plans", "custody_plans", "memory_plans", "series_plans", "stream_plans", "interval_plans"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"chronoweave.plans.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
