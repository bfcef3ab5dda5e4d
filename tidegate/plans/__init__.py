"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import Registry, Tables

GROUPS = ("cohort", "relational", "metrics", "texts", "features")


def load() -> Registry:
    every = Registry()
    for name in GROUPS:
        every.merge(importlib.import_module(f"{__name__}.{name}").reg)
    return every


__all__ = ["GROUPS", "Registry", "Tables", "load"]
