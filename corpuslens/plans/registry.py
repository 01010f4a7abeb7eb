"""Collects the query modules into the driver-facing registry."""

from __future__ import annotations

import importlib

from .catalog import REGISTRY

_MODULES = ["privacy_q", "descriptive_q", "classify_q", "quality_q", "canary_q", "coref_q", "records_q", "models_q", "corpus_q", "sources_q"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def all_queries():
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def all_sql():
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
