"""Queries of audits, detectors, rewrites, extraction and envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import catalog as K
from ..operators import extraction as E
from ..operators import graph, lint
from ..operators import rewrites as R
from ..operators import triples as G
from ..sources import adapters as A
from ..sources import corpus
from ..sources.tables import table
from . import proposals as P
from .hierarchy import CYCLE, SUB
from .measuring import FIND
from .ontology import RESTR, T_


def _said(spark, d):
    """The triples of all logged proposals."""
    return R.proposal_triples(P.entities(spark, d), P.relations(spark, d))


def _key(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _equivalent(spark, d):
    edges = A.cyclic_graph(spark, d)
    return edges.select(_key("u:", "child").alias("s"), F.lit("iri").alias("s_kind"), F.lit(G.EQUIVALENT).alias("p"), _key("u:", "parent").alias("o"), F.lit("iri").alias("o_kind"))


def _shaped(spark, d):
    """The triples; customers of the first market segment are disjoint from one another's
    nation, nations of even keys are equal to a complement."""
    customer, nation = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), table(spark, d, "nation").where("n_nationkey % 2 = 0")
    made = lambda df, s, k, p, o, kind: df.select(s.alias("s"), F.lit(k).alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    more = made(customer, _key("c:", "c_custkey"), "iri", G.DISJOINT, _key("n:", "c_nationkey"), "iri").unionAll(made(nation, _key("n:", "n_nationkey"), "iri", G.EQUIVALENT, _key("_:x", "n_nationkey"), "bnode")).unionAll(made(nation, _key("_:x", "n_nationkey"), "bnode", G.COMPLEMENT, _key("r:", "n_regionkey"), "iri"))
    return A.triples(spark, d).select(*R.OWN).unionAll(more)


def _no_lists(spark):
    return spark.createDataFrame([], "head STRING, member STRING")


def _placed(spark, d):
    """Proposed classes at their link, with the upper classes above their type."""
    e = lint.named(P.entities(spark, d)).where("kind = 'class'")
    order = F.array_position(F.array(*[F.lit(locus) for locus, _ in K.CHAIN]), F.col("locus"))
    me = F.concat_ws(" ", "pid", "name")
    placed = e.where(order > 0).select(me.alias("class"), F.concat(F.lit("L"), order.cast("string")).alias("link")).distinct()
    reach = e.select(me.alias("node"), F.col("anchor").alias("fragment")).join(F.broadcast(K.ancestors(spark)), "fragment").select("node", "ancestor").distinct()
    return placed, reach


def _c2(spark, d):
    placed, reach = _placed(spark, d)
    r = P.relations(spark, d)
    held = r.select(F.concat_ws(" ", "pid", lint.local(F.col("s"))).alias("class"), K.fragment(F.col("p")).alias("property"), F.concat_ws(" ", "pid", lint.local(F.col("o"))).alias("filler")).where("class is not null")
    known = held.join(reach.select(F.col("node").alias("class")).distinct(), "class", "left_semi")
    return U.ck_c2(known, reach, placed)


def _b1(spark, d):
    tree = A.taxonomy(spark, d).select(F.lit("subClassOf").alias("relation"), "child", "parent")
    users = A.cyclic_graph(spark, d).select(F.lit("precedes").alias("relation"), F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"))
    return U.ck_b1(tree.unionAll(users))


def _d3(spark, d):
    s = table(spark, d, "supplier")
    excludes = s.select(F.col("s_suppkey").alias("path"), (F.col("s_suppkey") + 3).alias("other"))
    return U.ck_d3_shared(excludes, s.select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("condition")))


def _measured(spark, d):
    return U.metrics(_said(spark, d))


def _finalize(spark, d):
    """Gates over the counts of the triples; one is waived, one never measured."""
    one = G.census(A.triples(spark, d)).select(F.inline(F.array(*[F.struct(F.lit(m).alias("gate"), F.col(m).cast("double").alias("value")) for m in ("classes", "labelled", "restrictions", "individuals")])))
    gates = spark.createDataFrame([("classes", 100.0), ("labelled", 1e12), ("restrictions", 1e12), ("individuals", 10.0), ("reasoner", 1.0)], "gate STRING, least DOUBLE")
    return U.finalize(gates, one, spark.createDataFrame([("labelled",)], "gate STRING"))


def _probes(spark, d):
    one = G.census(A.triples(spark, d)).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("classes", "restrictions", "properties")])))
    rules = [("bfo_grounded", "classes", 1.0), ("chain_bound", "restrictions", 20.0), ("has_acts", "properties", 1000.0), ("profile_dl", "profile", 1.0)]
    return U.probes(one, spark.createDataFrame(rules, "precondition STRING, metric STRING, least DOUBLE"))


def _chain(spark, d):
    profile = K.chain_profile(P._links(spark, d), spark)
    declared = spark.createDataFrame([("authority", "thick", "2026-01-01"), ("criteria", "thick", "2020-01-01"), ("act", "thin", "soon"), ("remedy", "thin", None)], "locus STRING, declared STRING, as_of STRING")
    return U.chain_validation(profile.drop("state").join(declared, "locus", "left"))


def _located(spark, d):
    f = A.findings(spark, d)
    anchors = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("subject"), F.lit("L9").alias("locus"))
    usual = f.select("code").distinct().select("code", F.when(F.col("code") < "K-N", "L1").alias("locus"))
    return U.located_findings(f, anchors, usual).groupBy("code", "at").agg(F.count("*").alias("findings"))


def _verdicts(spark, d):
    rules = [("regulation", F.col("weight") >= 3), ("translation", F.col("attribution") == "translation"), ("source", F.col("kind") == "coverage")]
    return U.adjudicated(A.findings(spark, d), rules).groupBy("verdict").agg(F.count("*").alias("findings"))


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return U.vector_clusters(v, 0.4, 0.45)


def _scoped(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null").dropDuplicates(["doc_id"])
    return U.scoped_senses(docs.select(F.col("locator").alias("label"), F.col("act_id").alias("act"), F.substring("text", 1, 12).alias("text"), (F.col("kind") == "article").alias("operative"), F.col("doc_id").alias("ordinal")).where("act is not null"))


def _delta(spark, d):
    """A delta over nations and back; what is left differing, which is nothing."""
    t = A.triples(spark, d)
    minus = t.where("p = 'rdfs:label'")
    plus = t.where("p = 'hasBrand'").withColumn("p", F.lit("skos:prefLabel")).unionAll(t.where("p = 'hasSize'"))
    after = R.apply_delta(t, plus, minus)
    back = R.rollback(after, t, plus, minus).select(*R.OWN)
    base = t.select(*R.OWN).distinct()
    count = lambda df, name: df.agg(F.count("*").alias("triples")).select(F.lit(name).alias("state"), "triples")
    return count(base, "before").unionAll(count(after, "after")).unionAll(count(back.exceptAll(base).unionAll(base.exceptAll(back)), "differing"))


def _spaces(spark, d):
    t = A.triples(spark, d)
    spaces = spark.createDataFrame([("part:", "https://parts/")], "old STRING, new STRING")
    known = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("local"))
    return R.renamed_spaces(t, spaces, known).where("s like 'https:%' or s like 'part:%'").groupBy(F.regexp_extract("s", "^[a-z]+", 0).alias("space")).agg(F.count_distinct("s").alias("subjects"))


def _conform(spark, d):
    return R.conforming(A.triples(spark, d), "https://onto.example/", "^(?:rdf|rdfs|owl):").groupBy("p").agg(F.count("*").alias("triples"))


def _guards(spark, d):
    t = A.triples(spark, d).select(*R.OWN)
    bad = [("n:1", "iri", G.SUBCLASS, "locatedIn", "iri"), ("n:1", "iri", G.DISJOINT, "entity", "iri"), ("r:1", "iri", G.DISJOINT, "r:2", "iri"), ("entity", "iri", G.DISJOINT, "n:3", "iri")]
    more = t.unionAll(spark.createDataFrame(bad, "s STRING, s_kind STRING, p STRING, o STRING, o_kind STRING"))
    kept = R.without_kin_disjointness(R.without_property_parents(more))
    return kept.groupBy("p").agg(F.count("*").alias("triples"))


def _collisions(spark, d):
    types = table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("rank")).groupBy("s", "type").agg(F.min("rank").alias("rank"))
    return R.collision_repair(types, spark.createDataFrame([("A", "R"), ("N", "R")], "a STRING, b STRING"))


def _reparent(spark, d):
    dead = table(spark, d, "region").where("r_regionkey in (1, 3)").select(_key("r:", "r_regionkey").alias("term")).unionAll(table(spark, d, "nation").where("n_nationkey % 5 = 1").select(_key("n:", "n_nationkey")))
    return R.reparented(A.triples(spark, d), dead).where("p = 'rdfs:subClassOf' and o_kind = 'iri'").groupBy("o").agg(F.count("*").alias("children"))


def _reachable(spark, d):
    seeds = table(spark, d, "nation").where("n_nationkey < 3").select(_key("n:", "n_nationkey").alias("term"))
    return R.reachable(A.triples(spark, d), seeds).select("s", "p", "o")


def _migrated(spark, d):
    t = P.relations(spark, d).where("s is not null and p is not null and o is not null").select("s", F.lit("iri").alias("s_kind"), F.lit(G.SUBCLASS).alias("p"), F.when(F.col("quantifier") == "some", F.concat("p", F.lit(" some "), "o")).when(F.col("quantifier") == "only", F.concat(F.lit("not "), "o")).when(F.col("quantifier") == "value", F.concat(F.lit("the "), "o", F.lit(" of it"))).otherwise(F.col("o")).alias("o"), F.lit("iri").alias("o_kind"))
    return R.migrated_expressions(t).groupBy("step", "p").agg(F.count("*").alias("axioms"))


def _flags(spark, d):
    f = A.findings(spark, d).select(F.md5(F.concat_ws("|", "code", "locus", F.col("subject").cast("string"), "detail")).alias("flag_id"), "code", "subject", "locus", F.lit(None).cast("string").alias("section"), F.col("detail").alias("evidence"), F.lit("k").alias("detector"), F.lit("A").alias("stratum"), "weight").withColumnRenamed("weight", "confidence").distinct()
    return R.flag_triples(f).groupBy("p", "o_kind").agg(F.count("*").alias("triples"))


def _outputs(spark, d):
    """Norm tuples as a model would write them: arrays in fences, every third one broken off."""
    n = table(spark, d, "norm_tuples").where("tuple_id is not null").dropDuplicates(["tuple_id"])
    one = F.to_json(F.struct("bearer", "modality", "action", "confidence"))
    text = F.concat(F.lit("Here it is:\n```json\n["), one, F.lit(", "), one, F.when(F.length("tuple_id") % 3 == F.conv(F.substring("tuple_id", 6, 8), 16, 10).cast("int") % 3, "").otherwise("]\n```"))
    return n.select(F.col("tuple_id").alias("id"), text.alias("text"))


def _envelopes(spark, d):
    """All jobs out and in again: the claims that come back, by status."""
    out = corpus.export_jobs(table(spark, d, "jobs"), table(spark, d, "claims"))
    return corpus.import_claims(out).groupBy("status").agg(F.count("*").alias("claims"))


def _clauses(spark, d):
    c = table(spark, d, "claims").where("claim_key is not null").dropDuplicates(["claim_key"])
    kind = F.when(F.col("status") == "committed", "grant").when(F.col("status") == "rejected", "exclusion").when(F.col("status") == "needs_review", "carveback").otherwise(F.col("status"))
    return E.coverage_rows(c.select(F.col("claim_key").alias("clause_id"), kind.alias("kind"), F.col("section").alias("subject"), F.col("job_id").alias("object")))


def _policies(spark, d):
    c = table(spark, d, "claims").where("claim_key is not null and proposal_id is not null").dropDuplicates(["claim_key"])
    return E.policies(c.select(F.coalesce("confidence", F.lit("none")).alias("policy"), F.col("proposal_id").alias("run"), F.struct("updated_at", "claim_key").alias("seq"), F.coalesce(F.col("verdict") == "inconsistent", F.lit(False)).alias("clashed"), F.when(F.col("status") == "committed", "accept").otherwise("reject").alias("outcome")))


def _once(spark, d):
    return table(spark, d, "claims").where("claim_key is not null").dropDuplicates(["claim_key"])


def _provenance(spark, d):
    labels = P.entities(spark, d).where("label is not null").select("label")
    return E.provenance(labels.unionAll(table(spark, d, "chunks").where("heading is not null").select(F.col("heading").alias("label"))), table(spark, d, "chunks").where("chunk_id is not null").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("passage"), "heading", "text"))


QUERIES = {
    "hier_typed_closure": lambda spark, d: U.typed_closure(A.triples(spark, d)).groupBy("ancestor").agg(F.count("*").alias("below")),
    "hier_equivalence_cycles": lambda spark, d: U.equivalence_cycles(_equivalent(spark, d)),
    "hier_differentiated": lambda spark, d: U.differentiated(_shaped(spark, d), _no_lists(spark)),
    "hier_complement_only": lambda spark, d: U.complement_only(_shaped(spark, d), _no_lists(spark)),
    "hier_residual": lambda spark, d: U.residual(_shaped(spark, d), _no_lists(spark)),
    "audit_metrics": _measured,
    "audit_dangling": lambda spark, d: U.dangling(_said(spark, d), K.upper(spark).select(F.concat(F.lit("obo:"), "fragment").alias("s"))),
    "ck_a2_verdicts": lambda spark, d: U.ck_a2(None, spark),
    "ck_b1_cycles": _b1,
    "ck_b3_links": lambda spark, d: U.ck_b3(*_placed(spark, d)),
    "ck_c2_levels": _c2,
    "ck_d2_self_repair": lambda spark, d: U.ck_d2_self(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("act"))),
    "ck_d3_shared_condition": _d3,
    "icd_substantive": lambda spark, d: U.substantive(G.restrictions(A.triples(spark, d)), "r:0"),
    "icd_bearing_dispositions": lambda spark, d: U.bearing_dispositions(G.restrictions(A.triples(spark, d)), graph.closure(A.taxonomy(spark, d)), "r:1", "entity", ["locatedIn"]),
    "x_blast_radius": lambda spark, d: U.blast_radius(table(spark, d, "nation").select(_key("g:", "n_regionkey").alias("grp"), _key("n:", "n_nationkey").alias("class")), A.taxonomy(spark, d).select(F.col("child").alias("class")).where("class not like 's:%'").distinct(), A.taxonomy(spark, d)),
    "lint_definitions": lambda spark, d: U.definition_coverage(P.entities(spark, d).where("label is not null").select(F.col("label").alias("term")), P.entities(spark, d).where("definition is not null").select(F.col("label").alias("term")), P.entities(spark, d).where("definition_status is not null").select(F.col("label").alias("term"))),
    "lint_capacities": lambda spark, d: U.capacity_realization(P.entities(spark, d).where("bfo_type = 'BFO_0000023' and iri is not null").select(F.col("iri").alias("term")), P.relations(spark, d).where("p in ('bfo:BFO_0000054', 'bfo:BFO_0000055')").select(F.explode(F.array("s", "o")).alias("term"))),
    "fin_gates": _finalize,
    "res_probes": _probes,
    "res_chain": _chain,
    "debt_older": lambda spark, d: U.older_debt(A.findings(spark, d)),
    "debt_located": _located,
    "debt_retyped": lambda spark, d: U.retyped_acts(A.findings(spark, d), table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("subject"))).groupBy("code").agg(F.count("*").alias("findings")),
    "debt_bands": lambda spark, d: U.older_debt(A.findings(spark, d)).select("code", U.debt_band(F.col("debt") % 150).alias("band")),
    "adj_verdicts": _verdicts,
    "join_default": lambda spark, d: U.with_default(_once(spark, d).select("claim_key", "section"), table(spark, d, "chunks").where("section is not null").groupBy("section").agg(F.min("heading").alias("heading")), "section", "heading", "unknown").select("claim_key", "heading"),
    "legal_checks": lambda spark, d: U.legal_checks(G.restrictions(_said(spark, d)), P.entities(spark, d).where("bfo_type in ('BFO_0000030', 'BFO_0000040')").select(F.col("iri").alias("class")), _said(spark, d)),
    "legal_draft": lambda spark, d: U.draft_report(_said(spark, d)),
    "legal_scoped": _scoped,
    "vector_clusters": _vectors,
    "mut_delta": _delta,
    "mut_spaces": _spaces,
    "mut_conforming": _conform,
    "mut_guards": _guards,
    "mut_collisions": _collisions,
    "mut_migrated": _migrated,
    "x_reparented": _reparent,
    "x_reachable": _reachable,
    "x_act_triples": lambda spark, d: R.act_triples(table(spark, d, "documents")).groupBy("p").agg(F.count("*").alias("triples")),
    "snk_flags": _flags,
    "snk_examples": lambda spark, d: R.examples(P.entities(spark, d))[0].select("pid", "pos", "label"),
    "src_told_claims": lambda spark, d: R.claims_of_terms(_once(spark, d).select(_key("claim:", "claim_key").alias("s"), F.inline(F.array(F.struct(F.lit("working:claimText").alias("p"), F.col("claim").alias("o")), F.struct(F.lit("working:sourceQuote").alias("p"), F.col("source_quote").alias("o")), F.struct(F.lit("working:confidence").alias("p"), F.col("confidence").alias("o"))))).where("o is not null")).groupBy("confidence").agg(F.count("*").alias("claims")),
    "src_envelopes": _envelopes,
    "json_salvaged": lambda spark, d: E.salvage(_outputs(spark, d)).groupBy("whole").agg(F.count("*").alias("objects")),
    "json_validated": lambda spark, d: E.validated(E.salvage(_outputs(spark, d))).groupBy("modality", "confidence").agg(F.count("*").alias("tuples")),
    "ext_terms": lambda spark, d: E.terms(table(spark, d, "documents")),
    "ext_provenance": _provenance,
    "cov_rows": lambda spark, d: _clauses(spark, d).groupBy("row").agg(F.count("*").alias("clauses")),
    "cov_facts": lambda spark, d: E.coverage_facts(_clauses(spark, d)),
    "x_routes": lambda spark, d: E.routed(table(spark, d, "norm_tuples").where("corpus_id is not null"), spark.createDataFrame([("frost_rules", "norms"), ("frost_rules", "claims"), ("*", "claims")], "corpus_id STRING, extractor STRING")),
    "x_lacking": lambda spark, d: E.lacking_fields(table(spark, d, "norm_tuples").where("tuple_id is not null").dropDuplicates(["tuple_id"]), ["bearer", "action", "deadline"]).select(F.array_join("lacking", ",").alias("lacking")).groupBy("lacking").agg(F.count("*").alias("tuples")),
    "x_acquisition": lambda spark, d: E.acquisition(spark.createDataFrame([(1,), (2,), (10**9,)], "source BIGINT"), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"))),
    "x_policies": _policies,
    "flt_client": lambda spark, d: E.client_rows(_once(spark, d), ["claim_key", "claim"], F.coalesce(F.col("claim").rlike(r"\d/|\bthe record\b"), F.lit(False))),
    "win_attach": lambda spark, d: E.attach_fractions(table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.when(F.col("p_size") < 20, "working:a").when(F.col("p_size") < 30, "bfo:b").otherwise("x").alias("target"))),
    "log_session_costs": lambda spark, d: E.session_costs(_once(spark, d)),
    "str_flush_marks": lambda spark, d: E.flush_marks(_once(spark, d).where("job_id is not null")),
    "fol_axioms": lambda spark, d: E.axiom_text(A.triples(spark, d)),
}

RAW = f"{T_.replace('WITH ', 'WITH RECURSIVE ', 1)}"
SQL = {
    "hier_typed_closure": f"{RAW}, e AS (SELECT DISTINCT s AS c, o AS p FROM t WHERE p IN ('rdfs:subClassOf', 'rdf:type') AND s_kind = 'iri' AND o_kind = 'iri' AND NOT regexp_matches(o, '^(rdf|rdfs|owl):')), w AS (SELECT c, p FROM e UNION SELECT w.c, e.p FROM w JOIN e ON e.c = w.p) SELECT p AS ancestor, count(*) AS below FROM w GROUP BY 1",
    "hier_equivalence_cycles": f"{CYCLE} SELECT 'u:' || node AS node FROM reach WHERE node = ancestor",
    "hier_differentiated": "SELECT 'n:' || n_nationkey AS class FROM nation UNION SELECT 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "hier_complement_only": "SELECT 'n:' || n_nationkey AS class FROM nation WHERE n_nationkey % 2 = 0",
    "hier_residual": f"""WITH {SUB}, told AS (SELECT 'n:' || n_nationkey AS c FROM nation UNION SELECT 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        SELECT 'n:' || n_nationkey AS class, 'complement only' AS why FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT child, 'no differentia beside its siblings' FROM sub WHERE child NOT IN (SELECT c FROM told) AND parent IN (SELECT parent FROM sub WHERE child IN (SELECT c FROM told))""",
    "ck_b1_cycles": f"{CYCLE}, k AS (SELECT a.node, min(least(a.node::VARCHAR, a.ancestor::VARCHAR)) AS c FROM reach a JOIN reach b ON b.node = a.ancestor AND b.ancestor = a.node GROUP BY 1) SELECT 'CK' AS family, 'K-B1' AS code, c AS subject, 'precedes cycle of ' || count(*) AS detail FROM k GROUP BY c",
    "ck_b3_links": f"""{P.G}, {P.UP}, ord(locus, link) AS (VALUES {", ".join(f"('{locus}', 'L{i}')" for i, (locus, _) in enumerate(K.CHAIN, 1))}), ex(link, a) AS (VALUES {", ".join(f"('{link}', '{c}')" for link, held in U.EXPECTED for c in held)})
        SELECT DISTINCT 'CK' AS family, 'K-B3' AS code, e.pid || ' ' || e.name AS subject, 'at ' || link AS detail FROM e JOIN ord ON ord.locus = e.locus WHERE kind = 'class' AND NOT EXISTS (SELECT 1 FROM e x JOIN anc ON anc.f = x.anchor JOIN ex ON ex.a = anc.a AND ex.link = ord.link WHERE x.pid = e.pid AND x.name = e.name AND x.kind = 'class')""",
    "ck_d2_self_repair": "SELECT DISTINCT 'CK' AS family, 'K-D2' AS code, l_suppkey AS subject, 'repairs itself' AS detail FROM lineitem WHERE l_suppkey = l_partkey",
    "ck_d3_shared_condition": "SELECT 'CK' AS family, 'K-D3' AS code, a.s_suppkey AS subject, concat_ws(' ', 'bars', a.s_suppkey + 3, 'while', b.s_suppkey, 'is open under', a.s_nationkey) AS detail FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey NOT IN (a.s_suppkey, a.s_suppkey + 3)",
    "icd_substantive": f"{T_}, {RESTR} SELECT DISTINCT * FROM x WHERE filler <> 'r:0'",
    "icd_bearing_dispositions": "SELECT 'n:' || n_nationkey AS class, 'r:' || n_regionkey AS filler FROM nation WHERE n_regionkey = 1",
    "x_blast_radius": "SELECT 'g:' || n_regionkey AS grp, count(DISTINCT n_nationkey) AS direct, count(DISTINCT c_custkey) AS cascade FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    "lint_definitions": f"""{P.G}, n AS (SELECT label, bool_or(definition IS NOT NULL) AS d, bool_or(status IS NOT NULL) AS x FROM e WHERE label IS NOT NULL GROUP BY 1)
        SELECT count(*) FILTER (WHERE NOT x OR d) AS population, count(*) FILTER (WHERE d) AS covered, count(*) FILTER (WHERE x AND NOT d) AS deferred, round(100 * count(*) FILTER (WHERE d) / count(*) FILTER (WHERE NOT x OR d), 2) AS pct FROM n""",
    "lint_capacities": f"{P.G}, c AS (SELECT DISTINCT iri FROM e WHERE bfo_type = 'BFO_0000023' AND iri IS NOT NULL), k AS (SELECT iri IN (SELECT unnest([s, o]) FROM r WHERE p IN ('bfo:BFO_0000054', 'bfo:BFO_0000055')) AS hit FROM c) SELECT count(*) AS population, count(*) FILTER (WHERE hit) AS covered, round(100 * count(*) FILTER (WHERE hit) / count(*), 2) AS pct FROM k",
    "fin_gates": f"""{T_}, m AS (SELECT count(DISTINCT s) FILTER (WHERE o = 'owl:Class')::DOUBLE AS c, count(DISTINCT s) FILTER (WHERE p = 'rdfs:label')::DOUBLE AS l, count(*) FILTER (WHERE o = 'owl:Restriction')::DOUBLE AS r, count(DISTINCT s) FILTER (WHERE p = 'rdf:type' AND NOT regexp_matches(o, '^(rdf|rdfs|owl):'))::DOUBLE AS i FROM t)
        SELECT 'classes' AS gate, c AS value, 100.0::DOUBLE AS least, 'passed' AS state, false AS blocks FROM m UNION ALL SELECT 'labelled', l, 1e12, 'waived', false FROM m UNION ALL SELECT 'restrictions', r, 1e12, 'failed', true FROM m UNION ALL SELECT 'individuals', i, 10.0, 'passed', false FROM m UNION ALL SELECT 'reasoner', NULL, 1.0, 'not evaluated', true""",
    "debt_older": f"WITH {FIND} SELECT code, count(*) AS debt FROM f WHERE attribution <> 'translation' GROUP BY 1",
    "debt_located": f"WITH {FIND} SELECT code, CASE WHEN subject IN (SELECT p_partkey FROM part WHERE p_size < 10) THEN 'L9' WHEN code < 'K-N' THEN 'L1' END AS at, count(*) AS findings FROM f GROUP BY 1, 2",
    "debt_retyped": f"WITH {FIND} SELECT CASE WHEN code = 'K-A2' AND subject IN (SELECT p_partkey FROM part WHERE p_size > 40) THEN 'K-D2' ELSE code END AS code, count(*) AS findings FROM f GROUP BY 1",
    "debt_bands": f"WITH {FIND}, g AS (SELECT code, count(*) % 150 AS n FROM f WHERE attribution <> 'translation' GROUP BY 1) SELECT code, CASE WHEN n = 0 THEN 'coherent' WHEN n < 100 THEN 'warning' ELSE 'failure' END AS band FROM g",
    "adj_verdicts": f"WITH {FIND} SELECT CASE WHEN weight >= 3 THEN 'regulation' WHEN attribution = 'translation' THEN 'translation' WHEN kind = 'coverage' THEN 'source' ELSE 'open' END AS verdict, count(*) AS findings FROM f GROUP BY 1",
    "join_default": "WITH c AS (SELECT DISTINCT claim_key, section FROM claims WHERE claim_key IS NOT NULL), h AS (SELECT section, min(heading) AS heading FROM chunks WHERE section IS NOT NULL GROUP BY 1) SELECT claim_key, coalesce(heading, 'unknown') AS heading FROM c LEFT JOIN h USING (section)",
    "vector_clusters": """WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings), p AS (SELECT a.vec_id AS x, b.vec_id AS y, array_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE array_cosine_similarity(a.v, b.v) >= 0.4),
        b AS (SELECT x, y FROM p UNION SELECT y, x FROM p), r AS (SELECT x AS n, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.n), g AS (SELECT n, min(root) AS cluster FROM r GROUP BY 1), l AS (SELECT cluster, round(min(c), 4) AS least FROM p JOIN g ON g.n = p.x GROUP BY 1)
        SELECT n AS vec_id, g.cluster, least, CASE WHEN least >= 0.45 THEN 'high' ELSE 'medium' END AS confidence FROM g JOIN l USING (cluster)""",
    "mut_spaces": "SELECT CASE WHEN p_size <= 25 THEN 'https' ELSE 'part' END AS space, count(*) AS subjects FROM part GROUP BY 1",
    "mut_conforming": f"{T_}, k AS (SELECT DISTINCT s, p, o FROM t WHERE regexp_matches(p, '^(rdf|rdfs|owl):') UNION SELECT 'https://onto.example/', 'rdf:type', 'owl:Ontology') SELECT p, count(*) AS triples FROM k GROUP BY 1",
    "mut_guards": f"{T_}, k AS (SELECT s, p, o FROM t UNION ALL SELECT 'r:1', 'owl:disjointWith', 'r:2') SELECT p, count(*) AS triples FROM k GROUP BY 1",
    "x_reachable": f"{RAW}, e AS (SELECT s AS c, o AS p FROM t WHERE o_kind <> 'lit'), w AS (SELECT 'n:' || n_nationkey AS n FROM nation WHERE n_nationkey < 3 UNION SELECT e.p FROM w JOIN e ON e.c = w.n) SELECT s, p, o FROM t WHERE s IN (SELECT n FROM w)",
    "x_act_triples": "WITH a AS (SELECT count(DISTINCT act_id) AS n FROM documents) SELECT * FROM (SELECT 'rdf:type' AS p, 3 * n AS triples FROM a UNION ALL SELECT 'working:enacts', n FROM a UNION ALL SELECT 'working:records', n FROM a)",
    "snk_flags": f"WITH {FIND}, g AS (SELECT count(*) AS n FROM (SELECT DISTINCT code, subject, locus, detail, weight FROM f)) SELECT * FROM (SELECT 'rdf:type' AS p, 'iri' AS o_kind, n AS triples FROM g UNION ALL SELECT 'working:subject', 'iri', n FROM g " + " ".join(f"UNION ALL SELECT 'working:{c}', 'lit', n FROM g" for c in ("code", "locus", "evidence", "detector", "stratum", "confidence")) + ")",
    "src_told_claims": "WITH c AS (SELECT DISTINCT * FROM claims WHERE claim_key IS NOT NULL AND claim <> '') SELECT coalesce(confidence, 'medium') AS confidence, count(*) AS claims FROM c GROUP BY 1",
    "src_envelopes": "WITH j AS (SELECT DISTINCT job_id FROM jobs WHERE job_id IS NOT NULL), c AS (SELECT DISTINCT ON (job_id, id) job_id, id, status FROM claims WHERE job_id IN (SELECT job_id FROM j) AND id IS NOT NULL) SELECT status, count(*) AS claims FROM c GROUP BY 1",
    "cov_rows": "WITH c AS (SELECT DISTINCT * FROM claims WHERE claim_key IS NOT NULL) SELECT CASE WHEN coalesce(section, '') = '' THEN 'skipped' WHEN status = 'committed' THEN 'grant' WHEN status = 'rejected' THEN 'exclusion' WHEN status = 'needs_review' THEN 'carveback' ELSE 'skipped' END AS row, count(*) AS clauses FROM c GROUP BY 1",
    "cov_facts": "SELECT section AS subject, bool_or(status = 'committed') AS granted, bool_or(status = 'rejected') AS excluded, bool_or(status = 'needs_review') AS restored FROM claims WHERE claim_key IS NOT NULL AND section <> '' AND status IN ('committed', 'rejected', 'needs_review') GROUP BY 1",
    "x_routes": "WITH c AS (SELECT DISTINCT corpus_id FROM norm_tuples WHERE corpus_id IS NOT NULL) SELECT corpus_id, 'claims' AS extractor FROM c UNION ALL SELECT corpus_id, 'norms' FROM c WHERE corpus_id = 'frost_rules'",
    "x_lacking": "WITH n AS (SELECT DISTINCT * FROM norm_tuples WHERE tuple_id IS NOT NULL) SELECT concat_ws(',', CASE WHEN trim(coalesce(bearer, '')) = '' THEN 'bearer' END, CASE WHEN trim(coalesce(action, '')) = '' THEN 'action' END, CASE WHEN trim(coalesce(deadline, '')) = '' THEN 'deadline' END) AS lacking, count(*) AS tuples FROM n GROUP BY 1",
    "x_acquisition": "WITH x(source) AS (VALUES (1), (2), (1000000000)) SELECT source::BIGINT AS source, count(l_suppkey) AS rows, CASE WHEN count(l_suppkey) = 0 THEN 'missing' WHEN count(l_suppkey) < 30 THEN 'too few' ELSE 'acquired' END AS status FROM x LEFT JOIN lineitem ON l_suppkey = source GROUP BY 1",
    "x_policies": """WITH c AS (SELECT DISTINCT * FROM claims WHERE claim_key IS NOT NULL AND proposal_id IS NOT NULL), l AS (SELECT coalesce(confidence, 'none') AS policy, proposal_id, bool_or(coalesce(verdict = 'inconsistent', false)) AS k, arg_max(coalesce(status, ''), (updated_at, claim_key)) AS st FROM c GROUP BY ALL)
        SELECT policy, count(*) AS runs, count(*) FILTER (WHERE k) AS clashes, count(*) FILTER (WHERE k AND st = 'committed') AS recovered FROM l GROUP BY 1""",
    "flt_client": r"SELECT DISTINCT claim_key, claim FROM claims WHERE claim_key IS NOT NULL AND NOT coalesce(regexp_matches(claim, '\d/|\bthe record\b'), false)",
    "win_attach": """WITH p AS (SELECT least((row_number() OVER (ORDER BY p_partkey) - 1) // greatest(1, (SELECT count(*) FROM part) // 4), 3) + 1 AS q, p_size FROM part)
        SELECT q::INT AS quartile, round(count(*) FILTER (WHERE p_size < 20) / count(*), 6) AS working, round(count(*) FILTER (WHERE p_size >= 20 AND p_size < 30) / count(*), 6) AS upper, round(count(*) FILTER (WHERE p_size >= 30) / count(*), 6) AS other FROM p GROUP BY 1""",
    "log_session_costs": "SELECT status, count(DISTINCT claim_key) AS claims FROM claims WHERE claim_key IS NOT NULL GROUP BY 1",
    "str_flush_marks": """WITH c AS (SELECT DISTINCT * FROM claims WHERE claim_key IS NOT NULL AND job_id IS NOT NULL), m AS (SELECT job_id, coalesce(min(id) FILTER (WHERE status = 'pending') - 1, max(id)) AS watermark FROM c GROUP BY 1)
        SELECT m.job_id, watermark, (SELECT count(*) FROM c WHERE c.job_id = m.job_id AND status = 'committed' AND id > watermark) AS refed FROM m""",
    "fol_axioms": f"{T_} SELECT s, 'all x (' || regexp_replace(s, '[^A-Za-z0-9_]', '_', 'g') || '(x) -> ' || regexp_replace(o, '[^A-Za-z0-9_]', '_', 'g') || '(x)).' AS formula FROM t WHERE p = 'rdfs:subClassOf' AND s_kind = 'iri' AND o_kind = 'iri'",
}
