"""Rewrites of a triple set: every operator gives a new set and changes nothing in place.

Triples have the columns (s, s_kind, p, o, o_kind, ...); what is added takes null in the
others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import graph
from .lint import expression
from .triples import CLASS, DISJOINT, ON, RESTRICTION, SOME, SUBCLASS, TYPE, subclass_edges

OWN = ["s", "s_kind", "p", "o", "o_kind"]


def added(triples: DataFrame, *parts: DataFrame) -> DataFrame:
    """The triples and more of (s, s_kind, p, o, o_kind), as a set."""
    for part in parts:
        triples = triples.unionByName(part.select(*OWN), allowMissingColumns=True)
    return triples.dropDuplicates(OWN)


def apply_delta(triples: DataFrame, plus: DataFrame, minus: DataFrame) -> DataFrame:
    """MUT-1: without ``minus`` and with ``plus``; ``rollback`` takes the same delta back."""
    return added(triples.join(minus.select(*OWN).distinct(), OWN, "left_anti"), plus)


def rollback(triples: DataFrame, before: DataFrame, plus: DataFrame, minus: DataFrame) -> DataFrame:
    """MUT-1: takes a delta back: what it added and was not there before goes, what it
    removed and was there comes back."""
    triples, before = written(triples), written(before.select(*OWN).distinct())
    new = plus.select(*OWN).distinct().join(before.select(*OWN), OWN, "left_anti")
    gone = before.select(*OWN).join(minus.select(*OWN).distinct(), OWN, "left_semi")
    return added(triples.join(new, OWN, "left_anti"), gone)


def renamed_spaces(triples: DataFrame, spaces: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """MUT-3: names in a namespace of ``spaces(old, new)`` in the new one, in all three
    positions; with ``known(local)`` only those whose local name the base has. The
    namespaces are a fixed table."""
    out = triples
    for row in spaces.collect():
        for c in ("s", "p", "o"):
            local = F.substring(F.col(c), F.lit(len(row["old"]) + 1), F.length(c))
            hit = F.col(c).startswith(row["old"]) & (F.lit(True) if c != "o" else F.col("o_kind") == "iri")
            if known is not None:
                marked = known.select(F.col("local").alias("_l"), F.lit(True).alias("_k")).distinct()
                out = out.withColumn("_l", F.when(hit, local)).join(marked, "_l", "left")
                hit = F.coalesce("_k", F.lit(False))
            out = out.withColumn(c, F.when(hit, F.concat(F.lit(row["new"]), local)).otherwise(F.col(c))).drop("_l", "_k")
    return out.distinct()


def conforming(triples: DataFrame, header: str, kept: str) -> DataFrame:
    """MUT-6: with an ontology header, restrictions typed, and without predicates that do
    not match ``kept``."""
    untyped = triples.where((F.col("p") == ON) & (F.col("s_kind") == "bnode")).select("s").distinct().join(triples.where(F.col("p") == TYPE).select("s"), "s", "left_anti")
    typing = untyped.select("s", F.lit("bnode").alias("s_kind"), F.lit(TYPE).alias("p"), F.lit(RESTRICTION).alias("o"), F.lit("iri").alias("o_kind"))
    head = triples.sparkSession.createDataFrame([(header, "iri", TYPE, "owl:Ontology", "iri")], "s STRING, s_kind STRING, p STRING, o STRING, o_kind STRING")
    return added(triples.where(F.col("p").rlike(kept)), typing, head)


def without_property_parents(triples: DataFrame) -> DataFrame:
    """MUT-8: without classes under a property."""
    properties = triples.where((F.col("p") == TYPE) & F.col("o").endswith("Property")).select(F.col("s").alias("o")).distinct()
    bad = triples.where(F.col("p") == SUBCLASS).join(properties, "o", "left_semi").select(*OWN)
    return triples.join(bad, OWN, "left_anti")


def without_kin_disjointness(triples: DataFrame) -> DataFrame:
    """MUT-8: without disjointness between a class and one above it."""
    triples = written(triples)
    reach = graph.closure(subclass_edges(triples)).select("node", "ancestor")
    pairs = triples.where(F.col("p") == DISJOINT)
    down = pairs.join(reach.toDF("s", "o"), ["s", "o"], "left_semi").select(*OWN)
    up = pairs.join(reach.toDF("o", "s"), ["s", "o"], "left_semi").select(*OWN)
    return triples.join(down.unionAll(up), OWN, "left_anti")


def collision_repair(types: DataFrame, disjoint: DataFrame, max_rounds: int = 6) -> DataFrame:
    """MUT-7: (s, type, rank): of ``types(s, type, rank)`` that clash by ``disjoint(a, b)``
    the one of the lower rank stays, round by round; what still clashes after
    ``max_rounds`` raises."""
    pairs = disjoint.select("a", "b").unionAll(disjoint.select("b", "a")).distinct()
    held = written(types.distinct())
    for _ in range(max_rounds):
        rival = held.select("s", F.col("type").alias("other"), F.col("rank").alias("other_rank"))
        one = held.join(pairs.toDF("type", "other"), "type").join(rival, ["s", "other"])
        worse = one.where("rank > other_rank or (rank = other_rank and type > other)").groupBy("s").agg(F.max(F.struct("rank", "type")).alias("w")).select("s", "w.type")
        if worse.isEmpty():
            return held
        held = written(held.join(worse, ["s", "type"], "left_anti"))
    raise RuntimeError("collision_repair: categories still clash")


def migrated_expressions(triples: DataFrame) -> DataFrame:
    """MUT-9, X-5: (step, s, p, o): axioms whose object is the text of an expression: made a
    restriction or a complement where it parses (``built``), else dropped (``dropped``)."""
    rows = triples.where((F.col("o_kind") == "iri") & F.col("o").rlike(r"^_:|\s")).select("s", "p", "o", expression(F.col("o")).alias("e"))
    node = F.concat(F.lit("_:"), F.substring(F.sha2("o", 256), 1, 16))
    lost = rows.where("e is null").select(F.lit("dropped").alias("step"), "s", "p", "o")
    made = rows.where("e is not null").withColumn("n", node)
    inner = F.when(F.col("e.op") == "not", F.array(F.struct(F.lit("owl:complementOf").alias("p"), F.col("e.cls").alias("o")))).otherwise(
        F.array(F.struct(F.lit(TYPE).alias("p"), F.lit(RESTRICTION).alias("o")), F.struct(F.lit(ON).alias("p"), F.col("e.prop").alias("o")), F.struct(F.lit(SOME).alias("p"), F.col("e.cls").alias("o")))
    )
    return lost.unionAll(made.select(F.lit("built"), "s", "p", "n")).unionAll(made.select(F.lit("built"), F.col("n"), F.inline(inner))).distinct()


def reparented(triples: DataFrame, dead: DataFrame) -> DataFrame:
    """X-2: without ``dead(term)``: children go to the parents of what they were under, over
    any run of dead terms, and restrictions filled by one go as a whole."""
    from .triples import purge

    edges = subclass_edges(triples)
    live = lambda df, c: df.join(dead.select(F.col("term").alias(c)), c, "left_anti")
    within = edges.join(dead.select(F.col("term").alias("child")), "child", "left_semi")
    up = graph.closure(within).select(F.col("node").alias("parent"), F.col("ancestor").alias("over"))
    moved = live(edges, "child").join(up, "parent").select("child", F.col("over").alias("parent"))
    new = live(moved, "parent").select(F.col("child").alias("s"), F.lit("iri").alias("s_kind"), F.lit(SUBCLASS).alias("p"), F.col("parent").alias("o"), F.lit("iri").alias("o_kind"))
    return added(purge(triples, dead), new)


def reachable(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """X-6, HIER-23: the triples of ``seeds(term)`` and of all that they lead to."""
    edges = triples.where("o_kind <> 'lit'").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    reach = graph.closure(edges).join(seeds.select(F.col("term").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("s"))
    return triples.join(reach.unionAll(seeds.select("term")).distinct(), "s", "left_semi")


def flag_triples(findings: DataFrame) -> DataFrame:
    """SNK-4: nine triples for each of ``findings(flag_id, code, subject, locus, section,
    evidence, detector, stratum, confidence)``."""
    me = F.concat(F.lit("flag:"), F.col("flag_id").cast("string"))
    pairs = [(TYPE, F.lit("working:Flag")), *[(f"working:{c}", F.col(c).cast("string")) for c in ("code", "subject", "locus", "section", "evidence", "detector", "stratum", "confidence")]]
    return findings.select(me.alias("s"), F.lit("iri").alias("s_kind"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs]))).withColumn("o_kind", F.when(F.col("p").isin(TYPE, "working:subject"), "iri").otherwise("lit")).where("o is not null")


def act_triples(acts: DataFrame) -> DataFrame:
    """X-12: the act, its enactment and its document, for each distinct ``acts(act_id)``."""
    a = F.col("act_id")
    rows = [
        (a, TYPE, F.lit("working:Act")), (F.concat(a, F.lit("/enactment")), TYPE, F.lit("working:Enactment")), (F.concat(a, F.lit("/enactment")), "working:enacts", a),
        (F.concat(a, F.lit("/document")), TYPE, F.lit("working:Document")), (F.concat(a, F.lit("/document")), "working:records", F.concat(a, F.lit("/enactment"))),
    ]
    return acts.where("act_id is not null").select("act_id").distinct().select(F.inline(F.array(*[F.struct(s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind")) for s, p, o in rows])))


def proposal_triples(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """X-8: the triples of proposed entities and of the relations between them."""
    from .lint import fragment_triples

    me = F.coalesce(F.nullif("iri", F.lit("")), F.col("label"))
    pairs = [(TYPE, F.when(F.col("kind") == "class", CLASS).otherwise(F.concat(F.lit("obo:"), "bfo_type")), "iri"), (SUBCLASS, F.when(F.col("kind") == "class", F.concat(F.lit("obo:"), F.regexp_replace(F.coalesce("parent_class", "bfo_type"), "^.*:", ""))), "iri"), ("rdfs:label", F.col("label"), "lit"), ("obo:IAO_0000115", F.col("definition"), "lit"), ("working:definitionStatus", F.col("definition_status"), "lit"), ("working:sourceSpan", F.col("source_span"), "lit")]
    told = entities.select(me.alias("s"), F.lit("iri").alias("s_kind"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind")) for p, o, k in pairs]))).where("s is not null and o is not null")
    said = fragment_triples(relations).select("s", F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri").alias("s_kind"), F.regexp_replace("p", "^bfo:", "obo:").alias("p"), F.regexp_replace("o", "^bfo:", "obo:").alias("o"), F.when(F.col("o").startswith("_:"), "bnode").otherwise("iri").alias("o_kind"))
    return told.unionAll(said).distinct()


def claims_of_terms(triples: DataFrame) -> DataFrame:
    """SRC-11: (s, claim_text, source_quote, confidence, label): claims told as individuals;
    those without a text are none, confidence is medium where it is missing."""
    wide = triples.where(F.col("p").isin("working:claimText", "working:sourceQuote", "working:confidence", "rdfs:label")).groupBy("s").pivot("p", ["working:claimText", "working:sourceQuote", "working:confidence", "rdfs:label"]).agg(F.min("o"))
    rows = wide.toDF("s", "claim_text", "source_quote", "confidence", "label")
    return rows.where("claim_text <> ''").withColumn("confidence", F.coalesce("confidence", F.lit("medium")))


def examples(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-9: (illustrative, rest) of entities, to be written apart."""
    shown = F.coalesce("illustrative", F.lit(False))
    return entities.where(shown), entities.where(~shown)
