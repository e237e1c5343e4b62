"""Registered queries: every operator on a binding over the given tables, with SQL to compare."""

from __future__ import annotations

import importlib

from opsframe.checks.base import Case

MODULES = ["logs", "telemetry", "tables", "incidents", "fleet", "monitoring", "models", "captures"]


def all_cases() -> dict[str, Case]:
    out: dict[str, Case] = {}
    for name in MODULES:
        cases = importlib.import_module(f"opsframe.checks.{name}").CASES
        clash = set(out) & set(cases)
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(cases)
    return out
