"""Registered queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("corpus", "chunks", "retrieval", "packs", "metrics", "store", "streams", "measurements", "knowledge")


def _all(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), attribute)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
