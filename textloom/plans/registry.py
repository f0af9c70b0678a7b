"""All query modules together."""

from __future__ import annotations

from textloom.plans import audit, facts, lexis, records, reviewing, sources, steps, style

MODULES = (style, audit, facts, records, lexis, sources, reviewing, steps)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
