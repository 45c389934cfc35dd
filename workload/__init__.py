"""Registered queries: each Spark callable sits beside its SQL twin."""

from __future__ import annotations

import importlib

from workload.registry import REGISTRY

FAMILIES = [
    "parsing", "windows", "features", "aggregates", "calibration", "market",
    "pricing", "joins", "upserts", "quality", "modelling", "streams", "archive", "loading",
]


def load_all():
    for family in FAMILIES:
        importlib.import_module(f"workload.{family}")
    return REGISTRY
