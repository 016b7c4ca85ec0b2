"""The query catalogue: every plan module's QUERIES and ORACLES."""

from __future__ import annotations

import importlib
import pkgutil

from goldenloom import plans


def _collect(attribute: str) -> dict:
    out: dict = {}
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        found = getattr(importlib.import_module(f"{plans.__name__}.{info.name}"), attribute, {})
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(found)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
