"""Small reports over documents, extraction arms and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def acts(documents: DataFrame) -> DataFrame:
    """AGG-26: by act, its documents, distinct locators and kinds; documents of no act
    are one group."""
    rows = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    return rows.groupBy("act_id").agg(F.count("*").alias("documents"), F.count_distinct("locator").alias("locators"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def compare_arms(one: DataFrame, two: DataFrame) -> DataFrame:
    """JOIN-14: (both, only_one, only_two, jaccard) of the keys of two arms, ``one(key)``
    and ``two(key)``; zero for two empty arms."""
    left, right = one.where("key is not null").select("key").distinct().withColumn("a", F.lit(1)), two.where("key is not null").select("key").distinct().withColumn("b", F.lit(1))
    counts = left.join(right, "key", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_one"), F.count_if(F.col("a").isNull()).alias("only_two"))
    size = F.col("both") + F.col("only_one") + F.col("only_two")
    return counts.select("both", "only_one", "only_two", F.when(size == 0, 0.0).otherwise(F.round(F.col("both") / size, 6)).alias("jaccard"))


def triage(violations: DataFrame) -> DataFrame:
    """AGG-29: what blocks most, by tier and code."""
    return violations.groupBy("tier", "code").agg(F.count_distinct("proposal_id").alias("proposals"), F.count("*").alias("violations"))


def first_with(chunks: DataFrame, text: str) -> DataFrame:
    """X-22: (section, chunk_id): the first chunk of each section that holds a text."""
    return chunks.where(F.contains("text", F.lit(text))).groupBy("section").agg(F.min("chunk_id").alias("chunk_id"))


def months(rows: DataFrame, column: str) -> DataFrame:
    """DATE-1: rows by month, null for none."""
    return rows.groupBy(F.date_format(column, "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"))
