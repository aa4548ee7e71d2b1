"""Queries that rank, select, name and scan terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terms as X
from ..operators import triples as G
from ..sources import adapters as A
from ..sources.tables import table
from . import proposals as P
from .hierarchy import SUB
from .ontology import LABELS, T_, key_sql


def existing(spark, d):
    """The names that proposals reuse, in the order of their names; those of processes
    are canonical."""
    rows = P.entities(spark, d).where("not is_new and label is not null").groupBy("label").agg(F.min("iri").alias("iri"), F.bool_or(F.col("bfo_type") == "BFO_0000015").alias("canonical"))
    return rows.select("iri", "label", F.coalesce("canonical", F.lit(False)).alias("canonical"), F.xxhash64("label").alias("h")).withColumn("ordinal", F.col("label")).drop("h")


def wanted(spark, d):
    return P.entities(spark, d).where("is_new and label is not null").select("label").distinct()


def utterances(spark, d):
    from ..operators import nested

    rows = nested.flat(table(spark, d, "session_log"), "proposals")
    return rows.where("utterance is not null").select(F.concat_ws(":", "event_id", "proposal_pos").alias("id"), F.col("utterance").alias("text"))


def _clusters(spark, d):
    """Clusters of part labels by key, by stem and by bag."""
    l = A.part_labels(spark, d)
    rows = l.groupBy(F.lower("label").alias("name")).agg(F.count("*").alias("members"))
    return rows.select("name", F.when(F.col("members") > 6, "exact").when(F.col("members") > 4, "stem").otherwise("bag").alias("kind"), F.when(F.col("members") % 3 == 0, "high").when(F.col("members") % 3 == 1, "medium").otherwise("review_required").alias("confidence"), "members")


CLUSTERS = f"WITH {LABELS}, c0 AS (SELECT lower(label) AS name, count(*) AS members FROM l GROUP BY 1), c AS (SELECT name, CASE WHEN members > 6 THEN 'exact' WHEN members > 4 THEN 'stem' ELSE 'bag' END AS kind, CASE members % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'review_required' END AS confidence, members FROM c0)"
EXIST = f"{P.G}, x AS (SELECT label, min(iri) AS iri, coalesce(bool_or(bfo_type = 'BFO_0000015'), false) AS canonical, label AS ordinal FROM e WHERE NOT is_new AND label IS NOT NULL GROUP BY 1), xk AS (SELECT *, list_filter(string_split({key_sql('label')}, ' '), lambda w: w <> '') AS held FROM x), ut AS (SELECT event_id || ':' || pp AS id, o->>'utterance' AS text FROM prop WHERE json_type(o) = 'OBJECT' AND o->>'utterance' IS NOT NULL)"
CATEGORIES = ["licence", "permit", "tenure", "remedy", "record"]


def _raw(spark, d):
    """The names of all relations as RDF attributes."""
    r = P.relations(spark, d).where("s is not null and o is not null")
    return r.select(F.concat_ws("/", "pid", F.col("pos").cast("string")).alias("id"), F.concat(F.lit('<owl:Class rdf:about="http://x/'), F.regexp_replace("s", "working:", "w#"), F.lit('"><p rdf:resource="http://x#'), F.when(F.col("quantifier") == "only", F.concat(F.lit("complementOf "), "o")).otherwise(F.col("o")), F.lit('"/>')).alias("raw"))


def _new_claims(spark, d):
    """Claims without an id get one; here all claims of the rejected status are new."""
    c = table(spark, d, "claims").where("claim_key is not null and job_id is not null").dropDuplicates(["claim_key"])
    new, old = c.where("status = 'rejected'").select("job_id", "claim_key"), c.where("status <> 'rejected'").select("job_id", "id")
    return X.numbered(new, "job_id", ["claim_key"], old)


def _siblings(spark, d):
    t = A.triples(spark, d)
    return X.sibling_census(A.taxonomy(spark, d), G.labels(t), G.labels(t).select(F.col("iri").alias("term")), A.region_disjointness(spark, d))


def _xrefs(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("iri"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"))
    claims = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_partkey").alias("claim_id"), F.initcap("p_name").alias("subject"), F.col("p_type").alias("quote"))
    return X.cross_references(parts, claims)


def _metrics(spark, d):
    """Counts by table and part of it, as leaves of a report."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.lit(1).alias("version"))
    return e.select(F.inline(F.array(*[F.struct(F.concat(F.lit("events."), "event_type", F.lit(f".{m}")).alias("path"), F.col(m).cast("double").alias("value")) for m in ("rows", "users", "version")])))


def _ordered_anchor(spark, d):
    from ..operators import graph

    return graph.first_anchor(A.taxonomy(spark, d).withColumn("ordinal", F.when(F.col("parent").startswith("r:"), 1).otherwise(0)), "r:")


QUERIES = {
    "top_reuse": lambda spark, d: X.reuse_candidates(wanted(spark, d), existing(spark, d)),
    "top_contained": lambda spark, d: X.contained_candidates(utterances(spark, d), existing(spark, d)),
    "label_overlap_rank": lambda spark, d: X.overlap_rank(utterances(spark, d), existing(spark, d)),
    "top_canonical_first": lambda spark, d: X.canonical_first(existing(spark, d).withColumn("id", F.substring("label", 1, 1))).select("id", "iri", "place"),
    "top_clusters": lambda spark, d: X.cluster_rank(_clusters(spark, d)),
    "flt_candidates": lambda spark, d: X.candidates(_clusters(spark, d), ["exact", "stem"], "medium"),
    "top_member": lambda spark, d: X.canonical_member(A.part_labels(spark, d).select(F.lower("label").alias("key"), F.col("label").alias("name"))),
    "top_mention": lambda spark, d: table(spark, d, "documents").select("doc_id", X.first_mention(F.col("text"), CATEGORIES).alias("category")),
    "top_capped": lambda spark, d: X.capped(P.QUERIES["pc_chain"](spark, d), "code", ["pid", "subject"], 10),
    "top_anchor": _ordered_anchor,
    "set_undefined": lambda spark, d: X.undefined(P.entities(spark, d).where("label is not null").select(F.col("label").alias("term")), P.entities(spark, d).where("definition is not null").select(F.col("label").alias("term")), P.entities(spark, d).where("definition_status is not null").select(F.col("label").alias("term"))),
    "set_all_but": lambda spark, d: X.all_but([A.taxonomy(spark, d).select(F.col("child").alias("class")), A.taxonomy(spark, d).select(F.col("parent").alias("class"))], A.taxonomy(spark, d).where("parent = 'r:1'").select(F.col("child").alias("class"))),
    "set_first_kept": lambda spark, d: X.first_kept(P.relations(spark, d).where("s is not null").select("s", "p", "pid", "pos"), ["s", "p"], ["pid", "pos"]),
    "win_new_ids": _new_claims,
    "mut_reserved": lambda spark, d: X.reserved(wanted(spark, d), existing(spark, d)),
    "norm_surface": lambda spark, d: table(spark, d, "part").select("p_name").distinct().select("p_name", F.array_join(X.surface_forms(F.col("p_name")), "|").alias("forms")),
    "norm_iris": lambda spark, d: P.relations(spark, d).where("p is not null").select("p").distinct().select("p", X.full_iri(F.col("p"), "https://onto.example/working#").alias("iri")),
    "lex_provision": lambda spark, d: table(spark, d, "documents").groupBy(X.provision(F.col("locator")).alias("kind")).agg(F.count("*").alias("documents")),
    "lex_smells": lambda spark, d: P.entities(spark, d).where("label is not null").select("label").distinct().select("label", X.smell(F.col("label")).alias("pattern")).where("pattern is not null"),
    "lex_sources": lambda spark, d: table(spark, d, "part").select("p_partkey", X.implied_source(F.concat(F.lit("see "), (F.col("p_partkey") % 50).cast("string"), F.when(F.col("p_size") < 10, " CFR part 404").when(F.col("p_size") < 20, " U.S.C. 423").when(F.col("p_size") < 30, " and DSM 5").otherwise("")), F.concat(F.lit("ICD-"), "p_size")).alias("source")),
    "lex_prose_length": lambda spark, d: X.prose_rows(table(spark, d, "claims").where("claim_key is not null").dropDuplicates(["claim_key"]).select(F.col("claim_key").alias("s"), F.lit("rdfs:comment").alias("p"), F.col("source_quote").alias("o"), F.lit("lit").alias("o_kind")), ["rdfs:comment"], table(spark, d, "claims").where("confidence = 'high'").select(F.col("claim_key").alias("s"))),
    "lex_iri_scan": lambda spark, d: X.iri_scan(_raw(spark, d)).groupBy("code").agg(F.count("*").alias("hits")),
    "lex_modal_context": lambda spark, d: table(spark, d, "claims").where("claim_key is not null").dropDuplicates(["claim_key"]).select("claim_key", X.governing_context(F.substring("source_quote", 60, 40), F.col("source_quote")).alias("context")),
    "txt_window": lambda spark, d: table(spark, d, "documents").select("doc_id", X.word_window(F.col("text"), F.lit("licence")).alias("window")),
    "x_cross_references": _xrefs,
    "x_sibling_census": _siblings,
    "agg_repeated_metrics": lambda spark, d: X.repeated_metrics(_metrics(spark, d), ["version"]),
    "log_graph_summary": lambda spark, d: X.graph_summary(A.part_labels(spark, d)),
}

SQL = {
    "top_reuse": f"""{EXIST}, w AS (SELECT label, list_filter(string_split({key_sql('label')}, ' '), lambda w: w <> '') AS words FROM (SELECT DISTINCT label FROM e WHERE is_new AND label IS NOT NULL)),
        p AS (SELECT w.label, iri, canonical, ordinal, len(list_intersect(words, held)) / len(list_distinct(list_concat(words, held))) AS j FROM w JOIN xk ON len(words) > 0 AND len(held) > 0 AND list_has_any(words, held)),
        rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (j = 1) DESC, canonical DESC, round(j, 3) DESC, ordinal)::INT AS place FROM p WHERE j >= 0.5) SELECT label, iri, j = 1 AS exact, round(j, 3) AS similarity, place FROM rk WHERE place <= 5""",
    "top_contained": f"""{EXIST}, u AS (SELECT id, list_filter(string_split({key_sql('text')}, ' '), lambda w: w <> '') AS words FROM ut), rk AS (SELECT id, iri, row_number() OVER (PARTITION BY id ORDER BY canonical DESC, length({key_sql('label')}) DESC, ordinal)::INT AS place FROM u JOIN xk ON len(held) > 0 AND list_has_all(words, held)) SELECT * FROM rk WHERE place <= 5""",
    "top_canonical_first": f"{EXIST} SELECT label[1] AS id, iri, row_number() OVER (PARTITION BY label[1] ORDER BY canonical DESC, ordinal)::INT AS place FROM x",
    "top_clusters": f"{CLUSTERS} SELECT name, CASE kind WHEN 'exact' THEN 1 WHEN 'stem' THEN 2 ELSE 3 END AS kind_rank, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS confidence_rank, members FROM c",
    "flt_candidates": f"{CLUSTERS} SELECT * FROM c WHERE kind IN ('exact', 'stem') AND confidence IN ('high', 'medium')",
    "top_member": f"WITH {LABELS} SELECT lower(label) AS key, coalesce(arg_min(label, (length(label), label)) FILTER (WHERE regexp_matches(label, '^[A-Z]')), arg_min(label, (length(label), label))) AS member FROM l GROUP BY 1",
    "top_mention": "SELECT doc_id, (SELECT arg_min(c, (p, i)) FROM (SELECT unnest(['licence', 'permit', 'tenure', 'remedy', 'record']) AS c, unnest([1, 2, 3, 4, 5]) AS i) k, LATERAL (SELECT instr(lower(text), c) AS p) q WHERE p > 0) AS category FROM documents",
    "set_undefined": f"{P.G} SELECT DISTINCT label AS term FROM e WHERE label IS NOT NULL AND label NOT IN (SELECT label FROM e WHERE label IS NOT NULL AND (definition IS NOT NULL OR status IS NOT NULL))",
    "set_all_but": f"WITH {SUB} SELECT child AS class FROM sub UNION SELECT parent FROM sub EXCEPT SELECT child FROM sub WHERE parent = 'r:1'",
    "set_first_kept": f"{P.G} SELECT s, p, min(pid) AS pid, arg_min(pos, (pid, pos))::INT AS pos FROM r WHERE s IS NOT NULL GROUP BY s, p",
    "win_new_ids": "WITH c AS (SELECT DISTINCT * FROM claims WHERE claim_key IS NOT NULL AND job_id IS NOT NULL), t AS (SELECT job_id, max(id) AS top FROM c WHERE status <> 'rejected' GROUP BY 1) SELECT c.job_id, claim_key, coalesce(top, -1) + row_number() OVER (PARTITION BY c.job_id ORDER BY claim_key) AS id FROM c LEFT JOIN t USING (job_id) WHERE status = 'rejected'",
    "norm_iris": f"""{P.G} SELECT DISTINCT p, CASE WHEN p LIKE 'rdf:%' THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#' || p[5:] WHEN p LIKE 'rdfs:%' THEN 'http://www.w3.org/2000/01/rdf-schema#' || p[6:] WHEN p LIKE 'bfo:%' THEN 'http://purl.obolibrary.org/obo/' || p[5:] WHEN p LIKE 'working:%' THEN 'https://onto.example/working#' || p[9:] WHEN p LIKE 'owl:%' THEN 'http://www.w3.org/2002/07/owl#' || p[5:] WHEN contains(p, ':') THEN p ELSE 'https://onto.example/working#' || p END AS iri FROM r WHERE p IS NOT NULL""",
    "lex_provision": "SELECT CASE WHEN trim(coalesce(locator, '')) LIKE 'rec_%' THEN 'recital' WHEN trim(coalesce(locator, '')) IN ('', 'unknown') THEN 'unknown' ELSE 'operative' END AS kind, count(*) AS documents FROM documents GROUP BY 1",
    "lex_smells": f"{P.G} SELECT * FROM (SELECT DISTINCT label, CASE " + " ".join(f"WHEN regexp_matches(lower(label), '{'|'.join(w)}') THEN '{n}'" for n, w in X.SMELLS) + " END AS pattern FROM e WHERE label IS NOT NULL) WHERE pattern IS NOT NULL",
    "lex_sources": "SELECT p_partkey, CASE WHEN p_size < 10 THEN (p_partkey % 50) || ' CFR 404' WHEN p_size < 20 THEN (p_partkey % 50) || ' USC 423' WHEN p_size < 30 THEN 'DSM-5' ELSE 'ICD-' || p_size END AS source FROM part",
    "lex_prose_length": "SELECT DISTINCT claim_key AS s, 'rdfs:comment' AS p, length(source_quote)::INT AS chars FROM claims WHERE claim_key IS NOT NULL AND length(source_quote) > 120 AND claim_key NOT IN (SELECT claim_key FROM claims WHERE confidence = 'high' AND claim_key IS NOT NULL)",
    "txt_window": r"""WITH d AS (SELECT doc_id, text, instr(lower(text), 'licence') AS pl FROM documents) SELECT doc_id, CASE WHEN pl > 0 THEN array_to_string(list_filter(regexp_split_to_array(substr(text, greatest(pl - 150, 1), pl - greatest(pl - 150, 1) + 7 + 150), '\s+'), lambda w: w <> '')[1:38], ' ') END AS "window" FROM d""",
    "x_cross_references": """WITH k AS (SELECT 'part:' || p_partkey AS iri, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part), f AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, min(p_partkey) AS id, arg_min(p_type, p_partkey) AS quote FROM part GROUP BY 1)
        SELECT iri AS s, 'claimId' AS p, id::VARCHAR AS o FROM k JOIN f USING (key) UNION SELECT iri, 'sourceQuote', quote FROM k JOIN f USING (key)""",
    "x_sibling_census": f"""{T_}, k AS (SELECT DISTINCT child, parent FROM sub), lb AS (SELECT s, max(o) AS label FROM t WHERE p = 'rdfs:label' GROUP BY 1), j AS (SELECT k.parent, k.child, lb.label FROM k LEFT JOIN lb ON lb.s = k.child)
        SELECT parent, count(*) AS children, count(label) AS defined, CASE WHEN parent = 'entity' THEN (SELECT count(*) FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey) ELSE 0 END AS disjoint, arg_max(label, (length(label), label)) AS longest, count(*) FILTER (WHERE length(label) > 120) AS over FROM j GROUP BY 1""",
    "agg_repeated_metrics": "WITH e AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1) SELECT * FROM (SELECT 'rows' AS key, count(DISTINCT n) AS values FROM e UNION ALL SELECT 'users', count(DISTINCT u) FROM e) WHERE values > 1",
    "log_graph_summary": f"WITH {LABELS} SELECT iri, label FROM l ORDER BY label, iri LIMIT 20",
}
