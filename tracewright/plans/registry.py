"""Every query of the core, by name, with its SQL where there is some."""

from __future__ import annotations

from tracewright.plans import evidence, exports, graphs, judged, stages, survey, texts

MODULES = (judged, survey, evidence, texts, graphs, exports, stages)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
