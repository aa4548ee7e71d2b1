"""The catalogue: every query of the core, with its SQL twin where SQL can
express it. Each module of plans holds ``QUERIES`` and ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, data, gating, hierarchy, live, measuring, ontology, proposals, reports, terms, texts

MODULES: list = [hierarchy, ontology, measuring, texts, gating, proposals, terms, audits, reports, live, data]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
