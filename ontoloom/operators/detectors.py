"""Contradiction detectors over class views. Two families carry these codes with
different meanings, so each finding names its family: CK over a regulation kernel,
KA over a plain audit.

Inputs: ``reach(node, ancestor, depth)``, ``edges(child, parent)``, relation tables
(subject, object). All are joins on names; none certifies that nothing clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finding(df: DataFrame, family: str, code: str, subject: str, detail) -> DataFrame:
    return df.select(F.lit(family).alias("family"), F.lit(code).alias("code"), F.col(subject).alias("subject"), detail.alias("detail"))


def ck_a1(reach: DataFrame, excluded: DataFrame) -> DataFrame:
    """A class under a class that it excludes: ``excluded(class, other)``."""
    held = excluded.join(reach.select(F.col("node").alias("class"), F.col("ancestor").alias("other")), ["class", "other"])
    return finding(held.distinct(), "CK", "K-A1", "class", F.concat(F.lit("under and outside "), "other"))


def ck_a3(edges: DataFrame, restrictions: DataFrame, disjoint: DataFrame, upper: str) -> DataFrame:
    """Self-reference, and vacuity: only upper parents, no restriction, no disjointness."""
    loop = restrictions.where("class = filler").select("class", F.lit("filler is the class").alias("why"))
    parents = edges.groupBy("child").agg(F.bool_and(F.col("parent").startswith(upper)).alias("only")).where("only").select(F.col("child").alias("class"))
    held = disjoint.select(F.col("a").alias("class")).unionAll(disjoint.select("b")).unionAll(restrictions.select("class")).distinct()
    vacuous = parents.join(held, "class", "left_anti").select("class", F.lit("vacuous").alias("why"))
    return finding(loop.unionAll(vacuous).distinct(), "CK", "K-A3", "class", F.col("why"))


def ck_b2(assessed: DataFrame, derives: DataFrame) -> DataFrame:
    """JOIN-3: an act with two assessors or more that trace to two grants or more:
    ``assessed(act, assessor)``, ``derives(assessor, grant)``."""
    traced = assessed.distinct().join(derives.distinct(), "assessor")
    acts = traced.groupBy("act").agg(F.count_distinct("assessor").alias("assessors"), F.count_distinct("grant").alias("grants")).where("assessors >= 2 and grants >= 2")
    return finding(acts, "CK", "K-B2", "act", F.concat_ws("/", F.col("assessors").cast("string"), F.col("grants").cast("string")))


def ck_c1(reach: DataFrame, left: str, right: str) -> DataFrame:
    """HIER-13: nodes under both roots."""
    under = reach.where(F.col("ancestor").isin(left, right)).groupBy("node").agg(F.count_distinct("ancestor").alias("roots")).where("roots = 2")
    return finding(under, "CK", "K-C1", "node", F.lit(f"under {left} and {right}"))


def ck_c3(relations: DataFrame, signatures: DataFrame, reach: DataFrame) -> DataFrame:
    """Domain and range: ``relations(s, p, o)`` against ``signatures(p, domain, range)``."""
    typed = relations.join(F.broadcast(signatures), "p")
    held = reach.select(F.col("node"), F.col("ancestor"))
    bad_s = typed.where("domain is not null").join(held.toDF("s", "domain"), ["s", "domain"], "left_anti").select(F.col("s").alias("subject"), F.concat(F.lit("domain of "), "p").alias("why"))
    bad_o = typed.where("range is not null").join(held.toDF("o", "range"), ["o", "range"], "left_anti").select(F.col("o").alias("subject"), F.concat(F.lit("range of "), "p").alias("why"))
    return finding(bad_s.unionAll(bad_o).distinct(), "CK", "K-C3", "subject", F.col("why"))


def ck_d1(rates: DataFrame) -> DataFrame:
    """AGG-18: outcome dispersion of ``rates(source, rate)``, with 30 rows or more and
    a deviation of five or more."""
    stats = rates.groupBy("source").agg(F.count("rate").alias("n"), F.round(F.stddev_samp("rate"), 6).alias("sd"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    return finding(stats.where("n >= 30 and sd >= 5"), "CK", "K-D1", "source", F.concat_ws(" ", F.col("n").cast("string"), F.round("sd", 3).cast("string")))


def ck_d2(preconditions: DataFrame, excludes: DataFrame) -> DataFrame:
    """SET-5: what a path requires and excludes: both (act, condition)."""
    return finding(preconditions.intersect(excludes), "CK", "K-D2", "act", F.concat(F.lit("requires and excludes "), "condition"))


def ck_d3(paths: DataFrame, excludes: DataFrame) -> DataFrame:
    """JOIN-4: two paths that repair one act, one excluding the other: ``paths(path,
    act)``, ``excludes(path, other)``. Paths meet through their exclusion, never all
    with all."""
    pairs = excludes.where("path <> other").distinct()
    met = pairs.join(paths.distinct(), "path").join(paths.distinct().toDF("other", "act"), ["other", "act"])
    back = pairs.select(F.col("path").alias("other"), F.col("other").alias("path"), F.lit(True).alias("back"))
    mutual = met.join(back, ["path", "other"], "left")
    return finding(mutual, "CK", "K-D3", "act", F.concat_ws(" ", "path", F.when(F.col("back"), "<>").otherwise(">"), "other"))


def ka_a1(typed: DataFrame, reach: DataFrame, disjoint: DataFrame) -> DataFrame:
    """An individual of two disjoint classes: ``typed(individual, class)``."""
    all_types = typed.select("individual", "class").unionAll(typed.join(reach.select(F.col("node").alias("class"), "ancestor"), "class").select("individual", F.col("ancestor").alias("class"))).distinct()
    one = all_types.join(disjoint, F.col("class") == F.col("a")).select("individual", "a", "b")
    both = one.join(all_types.select("individual", F.col("class").alias("b")), ["individual", "b"]).distinct()
    return finding(both, "KA", "K-A1", "individual", F.concat_ws(" and ", "a", "b"))


def ka_c3(individuals: DataFrame, relations: DataFrame) -> DataFrame:
    """Dependent individuals that no relation ties to a bearer."""
    return finding(individuals.join(relations.select(F.col("s").alias("individual")).distinct(), "individual", "left_anti").distinct(), "KA", "K-C3", "individual", F.lit("no bearer"))


def justification(reach: DataFrame, disjoint: DataFrame, edges: DataFrame) -> DataFrame:
    """JUST-1: for a class under a disjoint pair, its parents and the pairs counted."""
    from .graph import straddles

    clashes = straddles(reach, disjoint).groupBy("node").agg(F.count("*").alias("pairs"), F.min(F.concat_ws(" ", "a", "b")).alias("first_pair"))
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("parent")), " ").alias("parents"))
    return clashes.join(parents, "node").select("node", "parents", "pairs", "first_pair")


def shared_criteria(pairs: DataFrame, criteria: DataFrame) -> DataFrame:
    """ICD-1, JOIN-10: disjoint pairs (a, b) by the criteria (class, property, filler)
    both have; AGG-19: and how often each member takes part in a pair."""
    rows = criteria.select("class", "property", "filler").distinct()
    one = pairs.join(rows.toDF("a", "property", "filler"), "a").join(rows.toDF("b", "property", "filler"), ["b", "property", "filler"])
    shared = one.groupBy("a", "b").agg(F.count("*").alias("shared"))
    taking = pairs.select(F.col("a").alias("m")).unionAll(pairs.select("b")).groupBy("m").agg(F.count("*").alias("parts"))
    out = pairs.join(shared, ["a", "b"], "left").join(taking.toDF("a", "parts_a"), "a").join(taking.toDF("b", "parts_b"), "b")
    return out.select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), (F.col("parts_a") + F.col("parts_b")).alias("participation"))
