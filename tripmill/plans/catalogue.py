"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from tripmill.plans import analysis, enrich, motion, repair, tools

MODULES = (motion, repair, analysis, enrich, tools)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
