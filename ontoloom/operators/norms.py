"""Norm tuples: capacities and the pathways that serve them, and lexical tags of
quotes and instruments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PATHWAYS, VAGUE, clause_kind, content_tokens, rule_root
from ..session import settled

CAPACITIES = ("power", "permission")
COVERAGE = 0.5
#: All kinds of pathways, in order, and those that a capacity's own tuple is no route by.
KINDS = sorted([*dict(PATHWAYS), "deadline", "recipient"])
OWN_ONLY = ("recipient", "order")
#: Tuples of a corpus that meet its needs in one task, and pairs compared at once.
BLOCK, TILE = 65536, 1 << 22


def tuples(norm_tuples: DataFrame) -> DataFrame:
    """Each tuple once, with its content tokens, rule root and pathway kinds."""
    return _features(norm_tuples.where("tuple_id is not null").dropDuplicates(["tuple_id"]))


def _features(rows: DataFrame) -> DataFrame:
    conditions = F.coalesce(F.array_join("conditions", " "), F.lit(""))
    text = F.concat_ws(" ", F.coalesce("action", F.lit("")), F.coalesce("source_quote", F.lit("")), conditions)
    low, party = F.lower(text), F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce("counterparty", F.lit("")))), r"^(the|a|an)\s+", ""))
    signs = [F.when(low.rlike(p), kind) for kind, p in PATHWAYS if kind != "form"]
    form = dict(PATHWAYS)["form"]
    signs.append(F.when(low.rlike(form) & ((F.lower("modality") == "duty") | F.lower(conditions).rlike(form)), "form"))
    signs.append(F.when(F.coalesce("deadline", F.lit("")) != "", "deadline"))
    signs.append(F.when(~party.isin(*VAGUE), "recipient"))
    return rows.select(
        "tuple_id", "corpus_id", F.lower("modality").alias("modality"), "source_locator", "bearer_role", "external_reference", "action",
        content_tokens(F.coalesce("action", F.lit(""))).alias("need"), content_tokens(text).alias("tokens"), content_tokens(F.coalesce("counterparty", F.lit(""))).alias("party"),
        rule_root(F.lower(F.trim("source_locator"))).alias("root"), F.array_sort(F.array_compact(F.array(*signs))).alias("kinds"),
    )


def _has(i: int) -> Column:
    """Whether packed kinds have that of place ``i``."""
    return F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0


def _packed(norm_tuples: DataFrame) -> DataFrame:
    """Each tuple once, as narrow as capacities need it: kinds are bits, words one text
    (none holds a blank), and there is no word that nothing compares."""
    rows = _features(norm_tuples.where("tuple_id is not null"))
    bits = sum((F.when(F.array_contains("kinds", k), 1 << i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    useful = F.size("kinds") > 0
    return rows.select(
        "tuple_id", "corpus_id", F.col("modality").isin(*CAPACITIES).alias("capacity"), "external_reference", "root", "bearer_role", bits.cast("int").alias("kinds"),
        F.when(F.col("modality").isin(*CAPACITIES), F.array_join("need", " ")).alias("need"),
        F.when(useful, F.array_join("tokens", " ")).alias("tokens"), F.when(useful & (F.col("root") != ""), F.array_join("party", " ")).alias("party"),
    ).dropDuplicates(["tuple_id"])


def _summed() -> Column:
    return F.array(*[F.sum(F.col("n")[i]) for i in range(len(KINDS))])


def _served(needs: pa.Table, useful: pa.Table) -> pa.Table:
    """(corpus_id, need, n): for each need of a corpus the number of the block's tuples
    that have half of its words, by kind."""
    needs, useful = needs.combine_chunks(), useful.combine_chunks()
    split = lambda column: pc.split_pattern(column.combine_chunks() if len(column) else pa.array([], pa.string()), " ")
    words, tokens = split(needs.column("need")), split(useful.column("tokens"))
    kinds = (useful.column("kinds").to_numpy()[:, None] >> np.arange(len(KINDS)) & 1).astype(np.float32)
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    start, flat, held = np.cumsum(size) - size, words.flatten().dictionary_encode(), tokens.flatten()
    code, place = flat.indices.to_numpy(), pc.index_in(held, value_set=flat.dictionary)
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))[pc.is_valid(place).to_numpy(zero_copy_only=False)]
    place, order = place.drop_null().to_numpy(), np.argsort(size, kind="stable")
    found = np.zeros((len(size), len(KINDS)), dtype=np.int64)
    for lo in range(0, len(order), 512):
        part = order[lo : lo + 512]
        own = np.unique(np.concatenate([code[start[i] : start[i] + size[i]] for i in part]))
        # One row a word, and a last one for the places that a short need leaves empty.
        near = np.full(len(flat.dictionary), -1)
        near[own] = np.arange(len(own))
        has = np.zeros((len(own) + 1, len(tokens)), dtype=np.uint16 if size[part].max() > 255 else np.uint8)
        at = near[place]
        has[at[at >= 0], row[at >= 0]] = 1
        step = max(1, TILE // max(1, len(tokens)))
        for few in np.split(part, range(step, len(part), step)):
            shared = np.zeros((len(few), len(tokens)), dtype=has.dtype)
            for j in range(int(size[few].max())):
                shared += has[np.where(j < size[few], near[code[np.minimum(start[few] + j, len(code) - 1)]], len(own))]
            found[few] = (shared >= np.ceil(size[few] * COVERAGE)[:, None]).astype(np.float32) @ kinds
    some = np.flatnonzero(found.any(axis=1))
    return pa.table({"corpus_id": needs.column("corpus_id").take(some), "need": needs.column("need").take(some), "n": pa.array(list(found[some]), pa.list_(pa.int64()))})


def _by_wording(inner: DataFrame, useful: DataFrame) -> DataFrame:
    """(corpus_id, need, n): the tuples of the corpus that have half of the need's words,
    counted by kind. The tuples of a corpus are cut into blocks, and a block meets the
    needs of its corpus in one task, so that no pair of them is ever a row."""
    blocks = useful.groupBy("corpus_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    needs = inner.where("need <> ''").select("corpus_id", "need").distinct()
    needs = needs.join(blocks, "corpus_id").select("corpus_id", "need", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = useful.join(blocks, "corpus_id").select("corpus_id", "tokens", "kinds", F.pmod(F.xxhash64("tuple_id"), "blocks").cast("int").alias("block"))
    met = needs.groupBy("corpus_id", "block").cogroup(held.toDF("of", "tokens", "kinds", "at").groupBy("of", "at")).applyInArrow(_served, "corpus_id STRING, need STRING, n ARRAY<BIGINT>")
    return met.groupBy("corpus_id", "need").agg(_summed().alias("n"))


def _by_place(inner: DataFrame, useful: DataFrame) -> DataFrame:
    """(corpus_id, root, bearer_role, n): the tuples under the same rule with the same
    actor, or addressed to it, counted by kind. Which parties an actor is one of is
    found once for each pair of names."""
    at = useful.where("root <> ''").groupBy("corpus_id", "root", "bearer_role", "party").agg(F.array(*[F.count_if(_has(i)) for i in range(len(KINDS))]).alias("n"))
    at = at.withColumn("party", F.split("party", " "))
    actors = inner.where("root <> '' and bearer_role <> ''").select("bearer_role").distinct().withColumn("actor", content_tokens(F.col("bearer_role")))
    parties = at.select("party").distinct().select("party", F.explode("party").alias("w"))
    named = actors.withColumn("w", F.try_element_at("actor", F.lit(1))).join(parties, "w").where(F.size(F.array_except("actor", "party")) == 0).select(F.col("bearer_role").alias("holder"), "party")
    addressed = at.join(named, "party").where(~F.col("bearer_role").eqNullSafe(F.col("holder"))).select("corpus_id", "root", F.col("holder").alias("bearer_role"), "n")
    same = at.where("bearer_role <> ''").select("corpus_id", "root", "bearer_role", "n")
    return same.unionAll(addressed).groupBy("corpus_id", "root", "bearer_role").agg(_summed().alias("n"))


def capacities(norm_tuples: DataFrame) -> DataFrame:
    """PATH-1, 2: (tuple_id, corpus_id, role, verdict, kinds): for each capacity the
    kinds of the tuples of its corpus that refer to it.

    A tuple refers to a capacity by wording (it has half of the capacity's words), by
    place (same rule, and the same actor or addressed to it), or is the capacity's
    own, whose recipient and order are no route. Equal needs are one need, and all
    that is kept of the tuples that serve one is their number by kind: as a capacity
    always refers to itself, two of a kind tell that another one does."""
    rows = settled(lambda: _packed(norm_tuples))
    caps = rows.where("capacity")
    inner = caps.where(~F.coalesce("external_reference", F.lit(False)))
    useful = rows.where("kinds <> 0")
    wording, place = settled(lambda: _by_wording(inner, useful)), _by_place(inner, useful)
    keyed = caps.select("tuple_id", "corpus_id", "external_reference", "root", "bearer_role", "need", "kinds")
    keyed = keyed.join(wording.withColumnRenamed("n", "by_words"), ["corpus_id", "need"], "left").join(place.withColumnRenamed("n", "by_place"), ["corpus_id", "root", "bearer_role"], "left")

    def served(i: int, kind: str) -> Column:
        own = _has(i)
        least = F.when(own, 2).otherwise(1) if kind in OWN_ONLY else F.lit(1)
        other = F.coalesce(F.col("by_words")[i] >= least, F.lit(False)) | F.coalesce(F.col("by_place")[i] >= least, F.lit(False))
        return F.when(other if kind in OWN_ONLY else other | own, kind)

    external = F.coalesce("external_reference", F.lit(False))
    found = F.array_compact(F.array(*[served(i, k) for i, k in enumerate(KINDS)]))
    kinds = F.when(~external & (F.size(found) > 0), F.array_join(found, ","))
    verdict = F.when(external, "external").when(F.col("kinds").isNotNull(), "pathway_found").otherwise("no_pathway")
    return keyed.select("tuple_id", "corpus_id", F.coalesce("bearer_role", F.lit("")).alias("role"), "external_reference", kinds.alias("kinds")).select("tuple_id", "corpus_id", "role", verdict.alias("verdict"), "kinds")


def kd3(norm_tuples: DataFrame) -> DataFrame:
    """PATH-3: findings of the capacities without a pathway, surer with a role."""
    return capacities(norm_tuples).where("verdict = 'no_pathway'").select("tuple_id", F.lit("K-D3").alias("code"), F.when(F.col("role") != "", 0.8).otherwise(0.6).alias("confidence"))


# The kinds of clauses that are norms, and the words of the chain's nodes.
NORM_CLAUSES = ["norm", "conferral", "remedy", "time_limit"]
CHAIN_WORDS = {
    "conduct": r"(?i)\b(?:shall(?: not)?|may(?: not)?|must|is entitled to|has the right to|shall have the power to)\s+\w+",
    "condition": r"(?i)\b(?:where|if|in the case of|in any case where|provided that|unless|after having become aware)\b",
    "breach": r"(?i)\b(?:infringe\w*|breach\w*|fail\w* to|non-?complian\w*|violat\w*|in breach of|contrary to)\b",
    "remedy": r"(?i)\b(?:lodge a complaint|judicial remedy|compensation|liable|administrative fines?|penalt\w+|sanction\w*|damages)\b",
}
NODES = ["source", "norm", "addressee", "position", "conduct", "condition", "breach", "remedy"]


def chain_nodes(norm_tuples: DataFrame) -> DataFrame:
    """LEX-13, LEGAL-3, JOIN-13: (tuple_id, corpus_id, nodes): for each norm the nodes of
    the chain that its text supplies. A condition may be that of another clause of the
    same article, a remedy one found elsewhere in the act: both are flags by group,
    which meet the norms by key."""
    rows = norm_tuples.where("tuple_id is not null").dropDuplicates(["tuple_id"]).withColumns({"quote": F.coalesce("source_quote", F.lit("")), "article": F.regexp_replace(F.coalesce(F.nullif("source_locator", F.lit("")), F.lit("unknown")), "[/(].*$", "")})
    rows = rows.withColumn("clause", clause_kind(F.col("quote")))
    act = ["corpus_id"]
    siblings = rows.groupBy(*act, "article").agg(F.bool_or(F.col("clause") == "condition").alias("sibling_condition"))
    remedies = rows.groupBy(*act).agg(F.bool_or((F.col("clause") == "remedy") | F.col("quote").rlike(CHAIN_WORDS["remedy"])).alias("act_remedy"))
    met = rows.where(F.col("clause").isin(*NORM_CLAUSES)).join(siblings, [*act, "article"], "left").join(remedies, act, "left")
    has = lambda node: F.col("quote").rlike(CHAIN_WORDS[node])
    supplied = {
        "source": F.col("corpus_id").isNotNull(), "norm": F.col("quote") != "", "addressee": F.coalesce("bearer", F.lit("")) != "", "position": ~F.coalesce(F.lower("modality"), F.lit("none")).isin("", "none"),
        "conduct": has("conduct"), "condition": has("condition") | F.coalesce("sibling_condition", F.lit(False)), "breach": has("breach"), "remedy": has("remedy") | F.coalesce("act_remedy", F.lit(False)),
    }
    return met.select("tuple_id", "corpus_id", F.array_compact(F.array(*[F.when(supplied[n], n) for n in NODES])).alias("nodes"))


def chain_coverage(norm_tuples: DataFrame) -> DataFrame:
    """LEGAL-3: (node, present, missing) over all norms."""
    stats = chain_nodes(norm_tuples).agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("nodes", node)).alias(node) for node in NODES])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(node).alias("node"), F.col(node).alias("present"), (F.col("n") - F.col(node)).alias("missing")) for node in NODES])))
