"""Measures over findings, bindings, timings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import wilson

# A shape is blanket from so many findings on, a code is saturated
# beyond that rate, and the gates of dispersion.
BLANKET, SATURATED = 40, 0.5
GATES = {"mean_multiplicity": (1.5, "<="), "exclusivity": (0.50, ">="), "capture": (60.0, "<="), "max_jaccard": (0.60, "<=")}


def shape(detail: Column) -> Column:
    """The evidence without its first two words, 60 characters of it."""
    return F.substring(F.element_at(F.split(detail, " ", 3), -1), 1, 60)


def counts(findings: DataFrame) -> DataFrame:
    """AGG-3."""
    return findings.groupBy("code", "locus").agg(F.count("*").alias("findings"))


def blanket_shapes(findings: DataFrame) -> DataFrame:
    """AGG-4: (code, shape, findings) that occur often enough to be a blanket."""
    return findings.groupBy("code", shape(F.col("detail")).alias("shape")).agg(F.count("*").alias("findings")).where(F.col("findings") >= BLANKET)


def locus_density(findings: DataFrame) -> DataFrame:
    """AGG-5: findings per locus, all and without the blanket ones; the counts by
    shape are aggregated before they meet."""
    grouped = findings.groupBy("code", "locus", shape(F.col("detail")).alias("shape")).agg(F.count("*").alias("n"))
    blanket = blanket_shapes(findings).select("code", "shape", F.lit(True).alias("blanket"))
    rows = grouped.join(blanket, ["code", "shape"], "left")
    return rows.groupBy("locus").agg(F.sum("n").alias("findings"), F.coalesce(F.sum(F.when(F.col("blanket").isNull(), F.col("n"))), F.lit(0)).alias("specific"))


def debt(findings: DataFrame, registry: DataFrame, population: int, totals: DataFrame | None = None) -> DataFrame:
    """DEBT-1, AGG-12: (code, findings, undetermined, translation, rate, saturated, debt).
    ``registry(code, kind, weight)`` has one row a code; a finding of another code
    raises. Findings from translation never count, coverage codes never add, ``totals(code,
    total)`` above what was seen count as undetermined, and a code whose findings are
    more than half of the population is left out as saturated."""
    own = findings.groupBy("code").agg(
        F.count_if(~F.col("attribution").eqNullSafe("translation")).alias("seen"), F.count_if(F.coalesce("attribution", F.lit("undetermined")) == "undetermined").alias("open"), F.count_if(F.col("attribution") == "translation").alias("translation")
    )
    if totals is not None:
        own = own.join(totals, "code", "full")
    else:
        own = own.withColumn("total", F.lit(0))
    known = own.join(F.broadcast(registry), "code", "left")
    code = F.when(F.col("kind").isNull(), F.raise_error(F.concat(F.lit("unknown code "), "code")).cast("string")).otherwise(F.col("code"))
    seen, total = F.coalesce("seen", F.lit(0)), F.coalesce("total", F.lit(0)).cast("bigint")
    rows = known.select(code.alias("code"), "kind", "weight", F.greatest(seen, total).alias("findings"), (F.coalesce("open", F.lit(0)) + F.greatest(total - seen, F.lit(0))).alias("undetermined"), F.coalesce("translation", F.lit(0)).alias("translation"))
    rate = F.round(F.col("findings") / F.greatest(F.lit(population), F.lit(1)), 6)
    return rows.withColumn("rate", rate).select(
        "code", "findings", "undetermined", "translation", "rate", (F.col("rate") > SATURATED).alias("saturated"),
        F.when((F.col("rate") > SATURATED) | (F.col("kind") == "coverage"), 0.0).otherwise(F.round(F.col("weight") * F.col("findings"), 6)).alias("debt"),
    )


def completeness(registry: DataFrame, findings: DataFrame) -> DataFrame:
    """DEBT-3: what each primitive's silence means."""
    seen = findings.groupBy("code").agg(F.count("*").alias("findings"))
    state = F.when(F.col("findings").isNotNull(), "instrumented").when(F.col("applies"), "silent_by_principle").otherwise("not_applicable")
    return registry.join(seen, "code", "left").select("code", state.alias("state"), F.coalesce("findings", F.lit(0)).alias("findings"))


def coverage(rows: DataFrame, **conditions: Column) -> DataFrame:
    """AGG-13: (metric, present, missing, pct) of each condition, in one pass."""
    total = rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(m) for m, c in conditions.items()])
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("present"), (F.col("n") - F.col(m)).alias("missing"), F.round(100 * F.col(m) / F.greatest("n", F.lit(1)), 2).alias("pct")) for m in conditions]
    return total.select(F.inline(F.array(*parts)))


def precision(rows: DataFrame, key: str, hit: Column) -> DataFrame:
    """AGG-10, 11: hits, size, rate and Wilson interval by key."""
    grouped = rows.groupBy(key).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return grouped.select(key, "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), low.alias("low"), high.alias("high"))


def stratified_sample(findings: DataFrame, size: int, seed: int) -> DataFrame:
    """WIN-10: a round-robin sample over (code, locus): first one finding of each
    cell, then a second of each, up to ``size``. The order within a cell is that of
    a keyed hash. The rank is a group limit, which Spark applies before the shuffle
    as well, so a cell that holds most findings sends few."""
    key = F.md5(F.concat_ws("|", F.col("subject").cast("string"), "code", "locus", "detail", F.lit(str(seed))))
    rows = findings.select("code", "locus", "subject", key.alias("key")).distinct()
    cell = Window.partitionBy("code", "locus").orderBy("key", "subject")
    ranked = rows.withColumn("turn", F.row_number().over(cell)).where(F.col("turn") <= size)
    return ranked.orderBy("turn", "key", "subject").limit(size).select("code", "locus", "subject", "turn")


# ---------------------------------------------------------------- dispersion

def multiplicity(bindings: DataFrame) -> DataFrame:
    return bindings.groupBy("class").agg(F.count_distinct("locus").alias("loci"))


def dispersion(bindings: DataFrame) -> DataFrame:
    """AGG-14: bound classes, mean, median and greatest multiplicity, share of
    classes at one locus, capture (the share of the fullest locus in percent)."""
    per_class = multiplicity(bindings)
    fullest = bindings.groupBy("locus").agg(F.count_distinct("class").alias("n")).agg(F.max("n")).scalar()
    stats = per_class.agg(
        F.count("*").alias("bound"), F.round(F.avg("loci"), 6).alias("mean_multiplicity"), F.percentile("loci", F.lit(0.5)).alias("median_multiplicity"),
        F.max("loci").alias("max_multiplicity"), F.round(F.count_if(F.col("loci") == 1) / F.greatest(F.count("*"), F.lit(1)), 6).alias("exclusivity"),
    )
    return stats.withColumn("capture", F.round(100 * fullest / F.greatest("bound", F.lit(1)), 6))


def jaccards(bindings: DataFrame) -> DataFrame:
    """Pairwise Jaccard of the loci, from counts of classes by pair of loci. The
    pairs within a class are as few as there are loci."""
    rows = bindings.select("locus", "class").distinct()
    sizes = rows.groupBy("locus").agg(F.count("*").alias("n"))
    shared = rows.toDF("a", "class").join(rows.toDF("b", "class"), "class").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return both.select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def gates(bindings: DataFrame) -> DataFrame:
    """AGG-15: (gate, value, bound, passed)."""
    most_alike = jaccards(bindings).agg(F.coalesce(F.max("jaccard"), F.lit(0.0))).scalar()
    one = dispersion(bindings).withColumn("max_jaccard", most_alike)
    rows = []
    for name, (bound, sign) in GATES.items():
        value = F.col(name).cast("double")
        rows.append(F.struct(F.lit(name).alias("gate"), value.alias("value"), F.lit(bound).alias("bound"), (value <= bound if sign == "<=" else value >= bound).alias("passed")))
    return one.select(F.inline(F.array(*rows)))


def top_multiplicity(bindings: DataFrame, k: int = 10) -> DataFrame:
    return multiplicity(bindings).orderBy(F.desc("loci"), "class").limit(k)


# ---------------------------------------------------------------- timings

def percentiles(timings: DataFrame, *percents: int) -> DataFrame:
    """PCT-1 by phase: nearest rank with half-even rounding. Values are counted
    before they are ordered, so a phase that holds most rows is no larger than its
    distinct values."""
    values = timings.where(F.col("ms").isNotNull()).groupBy("phase", "ms").agg(F.count("*").alias("n"))
    by = Window.partitionBy("phase")
    ranked = values.withColumns({"upto": F.sum("n").over(by.orderBy("ms")), "total": F.sum("n").over(by)})
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p / 100) * (F.col("total") - 1), 0), F.col("ms")))
    return ranked.groupBy("phase").agg(*[at(p).alias(f"p{p}") for p in percents])


def phase_stats(timings: DataFrame) -> DataFrame:
    """AGG-16: count, mean, p50, p95, sum and share by phase. The share is of the
    phase ``total``, or of all phases where there is none."""
    basic = timings.groupBy("phase").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 6).alias("mean"), F.round(F.sum("ms"), 4).alias("sum"))
    whole = basic.agg(F.coalesce(F.max(F.when((F.col("phase") == "total") & (F.col("sum") > 0), F.col("sum"))), F.sum("sum"))).scalar()
    rows = basic.join(percentiles(timings, 50, 95), "phase")
    return rows.select("phase", "n", "mean", "p50", "p95", "sum", F.round(F.col("sum") / F.nullif(whole, F.lit(0.0)), 6).alias("share"))


def quartile_means(timings: DataFrame) -> DataFrame:
    """WIN-1: (run, quartile, mean) of runs of eight rows or more; the last
    quartile takes the remainder."""
    order = Window.partitionBy("run").orderBy("seq")
    rows = timings.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("run"))}).where("n >= 8")
    quartile = F.least(F.floor(F.col("i") / F.floor(F.col("n") / 4)), F.lit(3))
    return rows.groupBy("run", (quartile + 1).cast("int").alias("quartile")).agg(F.round(F.avg("ms"), 6).alias("mean"))


def quartile_growth(timings: DataFrame) -> DataFrame:
    """WIN-2: last over first quarter by run and phase; the middle is ignored, and
    growth is null where the first mean is zero."""
    by = Window.partitionBy("run", "phase")
    rows = timings.withColumns({"i": F.row_number().over(by.orderBy("seq")), "n": F.count("*").over(by)})
    q = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    ends = rows.groupBy("run", "phase").agg(F.avg(F.when(F.col("i") <= q, F.col("ms"))).alias("first"), F.avg(F.when(F.col("i") > F.col("n") - q, F.col("ms"))).alias("last"))
    return ends.select("run", "phase", F.round(F.col("last") / F.nullif("first", F.lit(0.0)), 6).alias("growth"))


def modal_agreement(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """AGG-8: (key, n, agreement); null counts as an answer."""
    grouped = rows.groupBy(key, answer).agg(F.count("*").alias("c"))
    return grouped.groupBy(key).agg(F.sum("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("agreement"))


def mean_sd(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-9: the deviation of a single value is zero."""
    return rows.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"))


# Prices for a million tokens: input, cached input, output.
RATES = (3.0, 0.3, 15.0)


def costs(usage: DataFrame) -> DataFrame:
    """AGG-17, 30: tokens, actual and naive cost, cache hits and savings by phase."""
    fresh, cached, out = (r / 1e6 for r in RATES)
    sums = usage.groupBy("phase").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")])
    actual = (F.col("input_tokens") - F.col("cached_tokens")) * fresh + F.col("cached_tokens") * cached + F.col("output_tokens") * out
    naive = F.col("input_tokens") * fresh + F.col("output_tokens") * out
    return sums.select("phase", "input_tokens", "cached_tokens", "output_tokens", F.round(actual, 4).alias("actual"), F.round(naive, 4).alias("naive"), F.round(F.col("cached_tokens") / F.nullif("input_tokens", F.lit(0)), 6).alias("hit_ratio"), F.round(naive - actual, 4).alias("saved"))
