"""Queries of this subpackage; ``queries()`` keys are named after the problem they solve."""

from __future__ import annotations

import importlib

MODULES = (
    "name_variants",
    "cross_source",
    "format_duplicates",
    "groups",
    "addresses",
    "survivors",
    "encoding",
    "mixing",
    "residue",
)


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"goldenloom.llm.{name}"), attribute, {}))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
