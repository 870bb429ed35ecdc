"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("energy_queries", "thermo_queries", "spectra_queries",
           "cluster_queries", "source_queries")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(importlib.import_module(f"rotamera.plans.{m}"), name)
        assert not out.keys() & part.keys()
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
