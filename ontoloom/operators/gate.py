"""The gate over proposals: construction lint, structural lint, first violation.

Proposals come as flat tables: ``entities(proposal_id, pos, label, iri, parent, kind,
category, is_new, definition)``, ``relations(proposal_id, pos, s, p, o)``. Every rule gives
violations (proposal_id, tier, code, subject). A gate that finds nothing has not
shown that a proposal is coherent: what no rule decides is left to a reasoner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key

# Lint patterns for names and the tiers in order.
PRIVATION = r"^(?:Non|Not|No|Un|Lack|Absence|Failure)(?:Of)?[A-Z]|^(?:not|no|lack of|absence of|failure to)\b"
CONNECTIVE = r"[a-z](?:And|Or|Of|With|Without|For|By)[A-Z]"
META_LABEL = r"(?i)\((?:reuse|instance|class|example[^)]*)\)|^example"
EXPRESSION = r"(?i)(?:\bnot\s*\(|\bsome\b|\bonly\b|\band\b|\bor\b).*"
TIERS = ["construction", "lint", "reasoner"]


def violation(df: DataFrame, tier: str, code: str, subject: Column) -> DataFrame:
    return df.select("proposal_id", F.lit(tier).alias("tier"), F.lit(code).alias("code"), subject.cast("string").alias("subject"))


def together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.distinct()


def camel_words(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("[A-Z][a-z]*|[a-z]+"), F.lit(0))


def name_lint(entities: DataFrame) -> DataFrame:
    """PC-1, 2, 17, 18: privations, compounds, meta labels, sentences as names."""
    label = F.col("label")
    return together(
        violation(entities.where(label.rlike(PRIVATION)), "construction", "PC-1", label),
        violation(entities.where((F.size(camel_words(label)) >= 4) | label.rlike(CONNECTIVE)), "construction", "PC-2", label),
        violation(entities.where(label.rlike(META_LABEL)), "construction", "PC-17", label),
        violation(entities.where((F.size(F.split(F.trim(label), r"\s+")) > 5) & ~label.rlike(EXPRESSION)), "construction", "PC-18", label),
    )


def typing(entities: DataFrame, upper: DataFrame, relations: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """PC-3, 4, 5: new entities without a category of the upper catalogue; relations
    outside the closed vocabulary; catalogues are fixed tables."""
    known = F.broadcast(upper.select(F.col("fragment").alias("category")))
    terms = F.broadcast(vocabulary.select(F.col("property").alias("p")))
    return together(
        violation(entities.where("is_new").join(known, "category", "left_anti"), "construction", "PC-3", F.col("label")),
        violation(relations.join(terms, "p", "left_anti"), "construction", "PC-4", F.col("p")),
    )


def contradictions(relations: DataFrame) -> DataFrame:
    """PC-11: the same pair included and excluded."""
    pairs = relations.groupBy("proposal_id", "s", "o").agg(F.bool_or(F.col("p") == "includes").alias("i"), F.bool_or(F.col("p") == "excludes").alias("x"))
    return violation(pairs.where("i and x"), "construction", "PC-11", F.concat_ws(" ", "s", "o"))


def definitions(entities: DataFrame) -> DataFrame:
    """PC-14: a new class has a definition that names its genus."""
    new = entities.where("is_new and kind = 'class'")
    bare = F.coalesce(F.trim("definition"), F.lit("")) == ""
    genus = F.contains(F.lower("definition"), F.lower("parent"))
    return together(violation(new.where(bare), "construction", "PC-14 missing", F.col("label")), violation(new.where(~bare & ~F.coalesce(genus, F.lit(True))), "construction", "PC-14 genus", F.col("label")))


def collisions(entities: DataFrame, existing: DataFrame) -> DataFrame:
    """PC-15, 16: a new name whose key exists must reuse it; one key, two categories."""
    keyed = entities.withColumn("key", label_key(F.col("label"))).where("key <> ''")
    held = existing.select(label_key(F.col("label")).alias("key")).where("key <> ''").distinct()
    twice = keyed.groupBy("proposal_id", "key").agg(F.count_distinct("category").alias("n")).where("n > 1")
    return together(violation(keyed.where("is_new").join(held, "key", "left_semi"), "construction", "PC-15", F.col("label")), violation(twice, "construction", "PC-16", F.col("key")))


def straddling(entities: DataFrame, reach: DataFrame, disjoint: DataFrame) -> DataFrame:
    """GS-1: what is committed and what is proposed, together under a disjoint pair."""
    above = reach.select(F.col("node").alias("parent"), F.col("ancestor").alias("top")).unionAll(reach.select(F.col("node").alias("parent"), F.col("node").alias("top"))).distinct()
    tops = entities.join(above, "parent").select("proposal_id", "label", "top").distinct()
    pairs = disjoint.select(F.col("a").alias("top"), F.col("b").alias("other"))
    met = tops.join(pairs, "top").join(tops.withColumnRenamed("top", "other"), ["proposal_id", "label", "other"])
    return violation(met, "lint", "GS-1", F.col("label")).distinct()


def signatures(relations: DataFrame, anchors: DataFrame, clash: DataFrame, signature: DataFrame) -> DataFrame:
    """GS-2: a relation whose every anchor of an end clashes with the signature:
    ``anchors(term, anchor)``, ``clash(a, b)`` both ways, ``signature(p, domain, range)``."""
    def end(column: str, wanted: str) -> DataFrame:
        rows = relations.join(F.broadcast(signature), "p").where(F.col(wanted).isNotNull()).join(anchors.withColumnRenamed("term", column), column)
        marked = rows.join(F.broadcast(clash.select(F.col("a").alias("anchor"), F.col("b").alias(wanted), F.lit(True).alias("bad"))), ["anchor", wanted], "left")
        every = marked.groupBy("proposal_id", "pos", "p", column).agg(F.bool_and(F.coalesce("bad", F.lit(False))).alias("every"))
        return violation(every.where("every"), "lint", "GS-2", F.concat_ws(" ", "p", column))

    return together(end("s", "domain"), end("o", "range"))


def budget(entities: DataFrame, most: int = 5) -> DataFrame:
    """BUD-1: more new classes than a proposal may mint."""
    minted = entities.where("is_new and kind = 'class'").groupBy("proposal_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return violation(minted, "construction", "BUD-1", F.col("n"))


def kernel_requests(questions: DataFrame) -> DataFrame:
    """KEXT-1: requests for new kernel terms among ``questions(event_id, question)``."""
    term = F.regexp_extract("question", r"(?i)\bsplit from (\w+)", 1)
    subject = F.regexp_extract("question", r"(?i)\bshould (\w+) be", 1)
    return questions.select("event_id", subject.alias("subject"), term.alias("term")).where("term <> ''")


def first_violation(proposals: DataFrame, violations: DataFrame) -> DataFrame:
    """GATE-1: (proposal_id, outcome, tier, code): the first tier that rejects, and
    in it the first code; others go on to a reasoner."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    first = violations.groupBy("proposal_id").agg(F.min(F.struct(rank.alias("rank"), "tier", "code")).alias("v"), F.count("*").alias("violations"))
    joined = proposals.select("proposal_id").distinct().join(first, "proposal_id", "left")
    return joined.select("proposal_id", F.when(F.col("v").isNull(), "needs_reasoner").otherwise("reject").alias("outcome"), F.col("v.tier").alias("tier"), F.col("v.code").alias("code"), F.coalesce("violations", F.lit(0)).alias("violations"))


def recall(labelled: DataFrame, violations: DataFrame) -> DataFrame:
    """AGG-24, BENCH-1: by expected tier, labelled bad proposals (proposal_id,
    expected) and those caught there."""
    caught = violations.select("proposal_id", F.col("tier").alias("expected"), F.lit(1).alias("hit")).distinct()
    return labelled.join(caught, ["proposal_id", "expected"], "left").groupBy("expected").agg(F.count("*").alias("n"), F.count("hit").alias("caught"), F.round(F.count("hit") / F.count("*"), 3).alias("recall"))


# ---------------------------------------------------------------- scope resolution

def resolve(failures: DataFrame, states: DataFrame) -> DataFrame:
    """RES-2: (failure, verdict, first_unmet). ``failures(failure, precondition, ordinal,
    instrument)`` against ``states(precondition, satisfied)``, where null is unknown and
    counts as unmet."""
    rows = failures.join(F.broadcast(states), "precondition", "left").withColumn("ok", F.coalesce("satisfied", F.lit(False)))
    unmet = F.min(F.when(~F.col("ok"), F.struct("ordinal", "precondition")))
    one = rows.groupBy("failure", "instrument").agg(unmet.alias("u"), F.bool_or(F.col("satisfied").isNull() & F.col("precondition").isNotNull()).alias("unknown"))
    verdict = F.when(F.col("u").isNull() & F.col("instrument").isNull(), "human").when(F.col("u").isNull(), "in_scope").when(F.col("unknown"), "undetermined").otherwise("out_of_scope")
    return one.select("failure", verdict.alias("verdict"), F.col("u.precondition").alias("first_unmet"))


def cumulative(preconditions: DataFrame) -> DataFrame:
    """RES-3: (stratum, needed): what a stratum needs, with the strata before it; a
    fixed table."""
    strata = preconditions.select("stratum").distinct()
    held = strata.join(preconditions.withColumnRenamed("stratum", "earlier"), F.col("earlier") <= F.col("stratum"))
    return held.groupBy("stratum").agg(F.array_join(F.array_sort(F.collect_set("precondition")), ",").alias("needed"))


def coverage_rule(facts: DataFrame) -> DataFrame:
    """COV-1, 2: (subject, state) of ``facts(subject, granted, excluded, restored)``, closed
    world: an exclusion holds unless it is restored; a grant that is effectively
    excluded is a contradiction, neither is indeterminate."""
    effective = F.col("excluded") & ~F.col("restored")
    state = F.when(F.col("granted") & effective, "contradiction").when(F.col("granted"), "covered").when(effective, "excluded").otherwise("indeterminate")
    return facts.select("subject", state.alias("state"))
