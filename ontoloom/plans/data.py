"""Queries over nested records and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import drift, nested
from ..sources.tables import table
from .proposals import P4


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.children(table(spark, sf_dir, "session_log"))


def p4_flat(child: str):
    return lambda spark, sf_dir: nested.flat(table(spark, sf_dir, "session_log"), child)


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.objects(table(spark, sf_dir, "session_log"))


def p4_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.bridge(table(spark, sf_dir, "session_log"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift(table(spark, sf_dir, "job_exports"))[1]


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "job_exports"))


QUERIES = {
    "p4_found": p4_found,
    "p4_bridge": p4_bridge,
    "p4_objects": p4_objects,
    **{f"p4_{c}": p4_flat(c) for c in ("proposals", "entities", "relations", "open_questions", "possible_relations")},
    "p6_found": p6_found,
    "p6_table": p6_table,
}

SQL: dict[str, str] = {"p4_found": P4}
