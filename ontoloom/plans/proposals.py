"""Queries of the gate over the proposals of the session log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import gate, lint, nested
from ..sources import adapters as A
from ..sources.tables import table


def entities(spark, d):
    rows = nested.flat(table(spark, d, "session_log"), "entities")
    return rows.select(
        F.concat_ws(":", "event_id", "proposal_pos").alias("pid"), "pos", "label", F.col("iri_suggestion").alias("iri"), "bfo_type", "parent_class", "kind", (F.col("is_new") == "true").alias("is_new"),
        "existing_iri", "definition", "definition_status", "source_span", "distinct_from", F.col("recognition_locus").alias("locus"), F.coalesce(F.col("illustrative") == "true", F.lit(False)).alias("illustrative"),
    )


def relations(spark, d):
    rows = nested.flat(table(spark, d, "session_log"), "relations")
    return rows.select(F.concat_ws(":", "event_id", "proposal_pos").alias("pid"), "pos", "s", "p", "o", "quantifier")


def proposals(spark, d):
    rows = nested.flat(table(spark, d, "session_log"), "proposals")
    return rows.select(F.concat_ws(":", "event_id", "proposal_pos").alias("pid"), "proposal_id", "gate_outcome", "gate_tier", "reasoner_verdict")


def existing(spark, d):
    """Labels of parts as existing classes; those of the smallest sizes are canonical."""
    labels = A.part_labels(spark, d).join(table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("iri"), (F.col("p_size") <= 5).alias("canonical")), "iri")
    reused = entities(spark, d).where("not is_new").select("label", F.lit(False).alias("canonical"))
    return labels.select("label", "canonical").unionAll(reused)


def _e(operator):
    return lambda spark, d: operator(entities(spark, d))


def _r(operator):
    return lambda spark, d: operator(relations(spark, d))


def _er(operator):
    return lambda spark, d: operator(entities(spark, d), relations(spark, d))


def violations(spark, d):
    """All rules that reject, of both tiers."""
    e, r = entities(spark, d), relations(spark, d)
    both = lint.union(lint.naming(e), lint.typing(e, r), lint.lexical(e, r), lint.chain_rules(e), lint.defining(e), lint.reuse(e, existing(spark, d)), lint.straddling(e), lint.signed(r, e), lint.bearing(r, e))
    return both.where("tier <> 'finding'")


def _first(spark, d):
    rows = violations(spark, d).withColumnRenamed("pid", "proposal_id")
    return gate.first_violation(proposals(spark, d).select(F.col("pid").alias("proposal_id")), rows)


def _recall(spark, d):
    """BENCH-1: of the proposals that were logged as rejected or repaired, by the tier
    logged, those in which a rule of that tier finds something."""
    labelled = proposals(spark, d).where("gate_outcome in ('reject', 'repair') and gate_tier is not null").select(F.col("pid").alias("proposal_id"), F.col("gate_tier").alias("expected"))
    return gate.recall(labelled, violations(spark, d).withColumnRenamed("pid", "proposal_id"))


def _drafting(spark, d):
    """Norm tuples as claims, their relations of bearing and inherence as edges."""
    n = table(spark, d, "norm_tuples").where("tuple_id is not null").dropDuplicates(["tuple_id"])
    claims = n.select(
        F.col("tuple_id").alias("pid"), F.col("bearer").alias("subject"), F.when(F.size("conditions") > 0, "condition").when(F.col("chain_link") == "criteria", "definition").otherwise("norm").alias("clause"),
        F.when(F.col("external_reference"), F.col("corpus_id")).alias("act_id"), (F.col("confidence") == "high").alias("verified"), F.when(F.col("confidence") == "low", "most").otherwise("every").alias("quantifier"), F.lower("modality").alias("modality"), F.col("source_quote").alias("context"),
    )
    edges = n.select(F.col("tuple_id").alias("pid"), F.lit(0).alias("pos"), F.col("bearer").alias("s"), F.when(F.col("chain_link") == "effect", "BFO_0000197").otherwise("BFO_0000196").alias("p"), F.lit("some").alias("q"), F.explode(F.array_compact(F.array("counterparty", "bearer_role"))).alias("o")).where("s is not null")
    kinds = edges.select("pid", F.col("s").alias("ref"), F.lit(True).alias("independent"), F.lit(False).alias("dependent")).distinct()
    return lint.drafting(claims, edges, kinds)


def _alternatives(spark, d):
    r = relations(spark, d).withColumn("q", F.coalesce("quantifier", F.lit("some")))
    listed = relations(spark, d).select("pid", lint.local(F.col("o")).alias("alternative"))
    return lint.alternatives(r.where("s is not null"), listed)


def _identity(spark, d):
    e = entities(spark, d)
    labelled = e.where("not is_new and iri is not null").select("iri", "label", "kind")
    return lint.identity_hits(e.where("is_new"), labelled)


def _positions(spark, d):
    """The modalities of a rule as positions: who owes, who may, towards whom."""
    n = table(spark, d, "norm_tuples").where("tuple_id is not null and source_locator is not null").dropDuplicates(["tuple_id"])
    named = F.when(F.lower("modality") == "duty", "duty").when(F.lower("modality") == "power", "power").when(F.lower("modality") == "permission", "privilege").when(F.lower("modality") == "exemption", "immunity").when(F.lower("modality") == "liability", "liability")
    return lint.positions(n.select(F.concat_ws("/", "corpus_id", "source_locator").alias("pid"), named.alias("position"), F.col("bearer_role").alias("holder"), F.col("counterparty").alias("against")).where("position is not null"))


def _typed(spark, d):
    e = lint.named(entities(spark, d))
    return e.select(F.concat_ws(" ", "pid", "name").alias("class"), F.explode(F.array("anchor", "parent")).alias("fragment")).where("fragment <> ''")


def _links(spark, d):
    return lint.named(entities(spark, d)).where("locus is not null and locus <> 'none'").select(F.col("name").alias("class"), "locus", (F.coalesce("source_span", F.lit("")) != "").alias("justified"))


def _expressions(spark, d):
    """EXPR-1 over all objects of relations, and over strings written from them."""
    r = relations(spark, d).where("o is not null and p is not null")
    texts = r.select(F.explode(F.array(F.col("o"), F.concat(F.lit("not "), "o"), F.concat(F.lit("not ("), "p", F.lit(" some "), "o", F.lit(")")), F.concat("p", F.lit(" some "), "o"), F.concat("p", F.lit(" "), "o"), F.concat(F.lit("_:x "), "p", F.lit(" "), "o"))).alias("t"))
    return texts.groupBy(lint.expression(F.col("t"))["op"].alias("op")).agg(F.count("*").alias("texts"))


def _triples(spark, d):
    r = relations(spark, d)
    some = r.withColumn("o", F.when(F.col("quantifier") == "some", F.concat(F.lit("_:r "), "p", F.lit(" "), "o")).when(F.col("quantifier") == "only", F.concat(F.lit("not "), "o")).otherwise(F.col("o")))
    return lint.fragment_triples(some).groupBy("p").agg(F.count("*").alias("triples"))


QUERIES = {
    "pc_naming": _e(lint.naming),
    "pc_typing": _er(lint.typing),
    "pc_strict": _er(lambda e, r: lint.typing(e, r, True).where("code = 'PC-4'")),
    "pc_lexical": _er(lint.lexical),
    "pc_chain": _e(lint.chain_rules),
    "pc_source": _r(lint.source_rules),
    "pc_definitions": _e(lambda e: lint.defining(e, True)),
    "pc_reuse": lambda spark, d: lint.reuse(entities(spark, d), existing(spark, d)),
    "gs_straddles": _e(lint.straddling),
    "gs_signatures": _er(lambda e, r: lint.signed(r, e)),
    "gs_bearers": lambda spark, d: lint.bearing(relations(spark, d).withColumn("p", F.when(F.col("p") == "working:grantedBy", "obo:RO_0000087").when(F.col("p") == "working:recognizedBy", "obo:RO_0000091").otherwise(F.col("p"))), entities(spark, d)),
    "gs_needs_reasoner": lambda spark, d: lint.needs_reasoner(proposals(spark, d), relations(spark, d), entities(spark, d)),
    "scf_scaffolds": _er(lint.scaffolds),
    "gate_logged_first": _first,
    "gate_logged_recall": _recall,
    "ld_drafting": _drafting,
    "ld_alternatives": _alternatives,
    "ld_identity": _identity,
    "lp_positions": _positions,
    "cat_ancestors": lambda spark, d: K.ancestors(spark),
    "cat_clashes": lambda spark, d: K.clashes(spark),
    "cat_bindings": lambda spark, d: K.bindings(_typed(spark, d), spark).groupBy("locus").agg(F.count("*").alias("classes")),
    "cat_unbound": lambda spark, d: K.unbound(_typed(spark, d), spark),
    "cat_first_clash": lambda spark, d: K.first_clash(_typed(spark, d), spark),
    "cat_entailed": lambda spark, d: K.entailed(_typed(spark, d), spark).groupBy("ancestor").agg(F.count("*").alias("classes")),
    "cat_links": lambda spark, d: K.asserted_links(_links(spark, d)),
    "cat_chain_profile": lambda spark, d: K.chain_profile(_links(spark, d), spark),
    "expr_classes": _expressions,
    "expr_triples": _triples,
}


# ---------------------------------------------------------------- twins

def _dec(x: str) -> str:
    """What a JSON string encodes."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') AND regexp_matches({x}->>'$', '^\\s*[\\[{{\"]') THEN ({x}->>'$')::JSON WHEN json_type({x}) = 'VARCHAR' AND trim({x}->>'$') = 'null' THEN NULL ELSE {x} END"


def _listed(name: str, source: str, path: str, keep: str, pos: str = "pos") -> str:
    return f"""{name}0 AS (SELECT {keep}, {_dec(f"o->'$.{path}'")} AS v FROM {source} WHERE json_type(o) = 'OBJECT'),
{name}1 AS (SELECT {keep}, CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN []::JSON[] WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS l FROM {name}0),
{name}2 AS (SELECT {keep}, unnest(l) AS o0, generate_subscripts(l, 1) - 1 AS {pos} FROM {name}1),
{name}3 AS (SELECT {keep}, {pos}, {_dec('o0')} AS o FROM {name}2),
{name} AS (SELECT * FROM {name}3 WHERE o IS NOT NULL AND json_type(o) <> 'NULL')"""


PROPOSALS = f"""ev AS (SELECT DISTINCT event_id, TRY_CAST(payload AS JSON) AS o0 FROM session_log WHERE event_type = 'propose' AND event_id IS NOT NULL AND json_valid(payload)),
ev1 AS (SELECT event_id, {_dec('o0')} AS o FROM ev), {_listed('prop', 'ev1', 'proposal', 'event_id', 'pp')}"""
CHILDREN = f"""{PROPOSALS}, {_listed('ent', 'prop', 'entities', 'event_id, pp')}, {_listed('rel', 'prop', 'relations', 'event_id, pp')},
{_listed('opq', 'prop', 'open_questions', 'event_id, pp')}, {_listed('por', 'ent', 'possible_relations', 'event_id, pp, pos', 'sub_pos')}"""
GATE = f"""{CHILDREN}, e0 AS (SELECT event_id || ':' || pp AS pid, pos, o->>'label' AS label, o->>'iri_suggestion' AS iri, o->>'bfo_type' AS bfo_type, o->>'parent_class' AS parent_class, o->>'kind' AS kind, coalesce(o->>'is_new' = 'true', false) AS is_new, o->>'existing_iri' AS existing_iri,
    o->>'definition' AS definition, o->>'definition_status' AS status, o->>'source_span' AS span, o->>'distinct_from' AS distinct_from, o->>'recognition_locus' AS locus FROM ent),
e AS (SELECT *, regexp_replace(coalesce(nullif(iri, ''), label), '^.*[#/:]', '') AS name, regexp_replace(trim(coalesce(bfo_type, '')), '^.*[#/:]', '') AS anchor, regexp_replace(trim(coalesce(parent_class, '')), '^.*[#/:]', '') AS parent, kind = 'class' AND is_new AND coalesce(existing_iri, '') = '' AS minted FROM e0),
r AS (SELECT event_id || ':' || pp AS pid, pos, o->>'s' AS s, o->>'p' AS p, o->>'o' AS o, o->>'quantifier' AS q FROM rel),
known(f) AS (VALUES {', '.join(f"('{f}')" for f, _, _ in K.UPPER)})"""
LOCAL = "regexp_replace({}, '^.*[#/:]', '')"
UP = "up(f, parent) AS (VALUES " + ", ".join(f"('{f}', {repr(p) if p else 'NULL'})" for f, p, _ in K.UPPER) + "), anc AS (SELECT f, f AS a, 0 AS depth FROM up UNION ALL SELECT anc.f, up.parent, depth + 1 FROM anc JOIN up ON up.f = anc.a WHERE up.parent IS NOT NULL)"
DIS = "dis(g, f) AS (VALUES " + ", ".join(f"({i}, '{f}')" for i, g in enumerate(K.DISJOINT) for f in g) + "), clash AS (SELECT DISTINCT x.f AS a, y.f AS b FROM dis p JOIN dis q ON p.g = q.g AND p.f <> q.f JOIN anc x ON x.a = p.f JOIN anc y ON y.a = q.f)"
KP = ", ".join(f"'{K.property_name(n)}'" for n in K.KERNEL_PROPERTIES)
UPL = "upl(f, upper_label) AS (VALUES " + ", ".join(f"('{f}', '{label}')" for f, _, label in K.UPPER) + ")"
ADM = "chain(locus, anchor) AS (VALUES " + ", ".join(f"('{locus}', '{a}')" for locus, anchors in K.CHAIN for a in anchors) + "), adm AS (SELECT DISTINCT locus, anc.f FROM chain JOIN anc ON anc.a = chain.anchor)"
SIG = "sig(rel, dom, ran) AS (VALUES " + ", ".join(f"('{p}', {repr(d) if d else 'NULL'}, {repr(r) if r else 'NULL'})" for p, _, d, r in K.SIGNATURES) + ")"
REFS = "refs0 AS (SELECT pid, unnest([iri, existing_iri, label]) AS ref, anchor, parent FROM e), refs AS (SELECT DISTINCT pid, ref, anchor AS f FROM refs0 WHERE ref <> '' AND anchor IN (SELECT f FROM known) UNION SELECT pid, ref, parent FROM refs0 WHERE ref <> '' AND parent IN (SELECT f FROM known))"
G = f"WITH RECURSIVE {GATE}"


def _no_class(x: str) -> str:
    return f"({x} <> '' AND ({x} IN ({KP}) OR (regexp_matches({x}, '^(BFO|RO|IAO)_[0-9]+$') AND {x} NOT IN (SELECT f FROM known))))"


from .ontology import LABELS, key_sql  # noqa: E402

SQL = {
    "pc_naming": f"""{G} SELECT pid, 'construction' AS tier, 'PC-1' AS code, name AS subject FROM e WHERE minted AND regexp_matches(name, '{lint.PRIVATION}')
        UNION SELECT pid, 'construction', 'PC-2', name FROM e WHERE minted AND (len(regexp_extract_all(name, '[A-Z][a-z0-9]*')) >= 4 OR list_has_any(regexp_extract_all(name, '[A-Z][a-z0-9]*'), ['With', 'For']) OR (regexp_matches(name, '.(Relation|Dependency|Alignment|Grounding|Support)$')))
        UNION SELECT pid, 'construction', 'PC-17', label FROM e WHERE regexp_matches(label, '(?i)\\((reuse|instance|class|example[^)]*)\\)|^example\\b')""",
    "pc_typing": f"""{G}, {UP}, m AS (SELECT *, {LOCAL.format("coalesce(p, '')")} AS rel, coalesce(p, '') AS pp FROM r)
        SELECT pid, 'construction' AS tier, 'PC-3' AS code, name AS subject FROM e WHERE coalesce(existing_iri, '') = '' AND anchor NOT IN (SELECT f FROM known) AND parent NOT IN (SELECT f FROM known)
        UNION SELECT pid, 'construction', 'PC-6', name FROM e WHERE (SELECT count(DISTINCT a) FROM anc WHERE anc.f IN (e.anchor, e.parent) AND a IN ('BFO_0000002', 'BFO_0000003')) = 2
        UNION SELECT pid, 'construction', 'PC-5', p FROM m WHERE NOT (pp IN ('a', 'owl:disjointWith', 'rdf:type', 'rdfs:subClassOf') OR regexp_replace(pp, '^.*#', '') IN ('type', 'subClassOf', 'disjointWith')) AND rel NOT IN ({KP})
        UNION SELECT pid, 'construction', 'PC-5', {LOCAL.format('s')} FROM m WHERE (contains(pp, 'subClassOf') OR contains(pp, 'type')) AND {_no_class("regexp_replace(trim(coalesce(o, '')), '^.*[#/:]', '')")}
        UNION SELECT pid, 'construction', 'PC-5', name FROM e WHERE {_no_class('parent')}""",
    "pc_strict": f"{G} SELECT DISTINCT pid, 'construction' AS tier, 'PC-4' AS code, name AS subject FROM e WHERE minted",
    "pc_chain": f"""{G}, {UP}, {ADM} SELECT pid, 'construction' AS tier, 'PC-9' AS code, name AS subject FROM e WHERE locus <> 'none' AND locus <> '' AND anchor <> '' AND NOT EXISTS (SELECT 1 FROM adm WHERE adm.locus = e.locus AND adm.f = e.anchor)
        UNION SELECT pid, 'finding', 'PC-10', name FROM e WHERE regexp_matches(lower(concat_ws(' ', label, name)), '{"|".join(lint.RESIDUAL)}') OR regexp_matches(regexp_replace(lower(concat_ws(' ', label, name)), '[ _-]', '', 'g'), '{"|".join(m.replace(" ", "") for m in lint.RESIDUAL)}')
        UNION SELECT pid, 'construction', 'PC-12', name FROM e WHERE minted AND lower(CASE WHEN regexp_matches(name, '[A-Z]') THEN array_to_string(regexp_extract_all(name, '[A-Z][a-z0-9]*'), '') ELSE name END) IN ({", ".join(f"'{n}'" for n in lint.CHAIN_NAMES)})""",
    "pc_source": f"""{G}, x AS (SELECT DISTINCT pid, {LOCAL.format('s')} AS s, lower({LOCAL.format("coalesce(p, '')")}) AS p, {LOCAL.format('o')} AS o FROM r WHERE s <> '' AND o <> ''), k AS (SELECT pid, o AS parent, list(DISTINCT s) AS kids FROM x WHERE p IN ('subclassof', 'is_a', 'isa') GROUP BY ALL HAVING count(DISTINCT s) > 1)
        SELECT pid, 'finding' AS tier, 'PC-11' AS code, s || ' ' || o AS subject FROM x GROUP BY pid, s, o HAVING bool_or(regexp_matches(p, 'exclusion|excludes|notincluded')) AND bool_or(regexp_matches(p, 'inclusion|includes|criterion|criteria') AND NOT regexp_matches(p, 'exclusion|excludes|notincluded'))
        UNION SELECT pid, 'finding', 'PC-13', parent FROM k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.pid = k.pid AND contains(x.p, 'disjoint') AND list_contains(k.kids, x.s) AND list_contains(k.kids, x.o) AND x.s <> x.o)""",
    "pc_definitions": f"""{G}, {UPL}, g AS (SELECT pid, ref, min(label) AS genus FROM (SELECT pid, unnest([iri, existing_iri]) AS ref, label FROM e) WHERE ref <> '' GROUP BY ALL),
        m AS (SELECT e.*, trim(coalesce(definition, '')) AS txt, coalesce(g.genus, upl.upper_label) AS genus FROM e LEFT JOIN g ON g.pid = e.pid AND g.ref = coalesce(nullif(e.parent_class, ''), e.bfo_type) LEFT JOIN upl ON upl.f = regexp_replace(trim(coalesce(nullif(e.parent_class, ''), e.bfo_type)), '^.*[#/:]', '') WHERE minted)
        SELECT DISTINCT pid, 'construction' AS tier, 'PC-14 missing' AS code, label AS subject FROM m WHERE txt = '' AND coalesce(status, '') <> 'absent-in-source'
        UNION SELECT pid, 'construction', 'PC-14 genus', label FROM m WHERE txt <> '' AND genus IS NOT NULL AND NOT contains(lower(txt), lower(genus)) AND NOT ({key_sql('genus')} <> '' AND list_has_all(string_split({key_sql('txt')}, ' '), string_split({key_sql('genus')}, ' ')))
        UNION SELECT pid, 'construction', 'PC-14 span', label FROM m WHERE txt <> '' AND trim(coalesce(span, '')) = ''""",
    "pc_reuse": f"""{G}, {LABELS}, h0 AS (SELECT label, p_size <= 5 AS canonical FROM l JOIN part ON iri = 'part:' || p_partkey UNION ALL SELECT label, false FROM e WHERE NOT is_new), h AS (SELECT {key_sql('label')} AS key, bool_or(canonical) AS canonical FROM h0 GROUP BY 1),
        k AS (SELECT *, {key_sql('label')} AS key, trim(coalesce(span, '')) <> '' AS spanned FROM e WHERE minted)
        SELECT DISTINCT pid, 'construction' AS tier, 'PC-15' AS code, label AS subject FROM k JOIN h USING (key) WHERE key <> '' AND (canonical OR NOT (spanned AND trim(coalesce(distinct_from, '')) <> ''))
        UNION SELECT pid, 'finding', 'PC-16', key FROM k WHERE key <> '' GROUP BY pid, key HAVING count(*) > 1 AND count(DISTINCT coalesce(bfo_type, '')) > 1 AND NOT bool_and(spanned)""",
    "gs_straddles": f"{G}, {UP}, {DIS}, {REFS} SELECT DISTINCT x.pid, 'lint' AS tier, 'GS-1' AS code, x.ref AS subject FROM refs x JOIN refs y ON x.pid = y.pid AND x.ref = y.ref JOIN clash ON clash.a = x.f AND clash.b = y.f",
    "gs_signatures": f"""{G}, {UP}, {DIS}, {REFS}, {SIG}, t AS (SELECT r.pid, r.pos, r.s, r.o, dom, ran FROM r JOIN sig ON sig.rel = {LOCAL.format('r.p')} WHERE NOT contains(coalesce(r.o, ''), ' ') AND NOT starts_with(coalesce(r.o, ''), '_:')),
        n AS (SELECT pid, pos, 'd' AS slot, s AS ref, dom AS w FROM t WHERE dom IS NOT NULL UNION ALL SELECT pid, pos, 'r', o, ran FROM t WHERE ran IS NOT NULL)
        SELECT DISTINCT pid, 'lint' AS tier, 'GS-2' AS code, {LOCAL.format('ref')} AS subject FROM (SELECT n.pid, n.pos, n.slot, n.ref, bool_and(EXISTS (SELECT 1 FROM clash c WHERE c.a = refs.f AND c.b = n.w)) AS every FROM n JOIN refs ON refs.pid = n.pid AND refs.ref = n.ref GROUP BY ALL) WHERE every""",
    "gs_needs_reasoner": f"""{G}, {REFS}, p AS (SELECT DISTINCT event_id || ':' || pp AS pid FROM prop WHERE json_type(o) = 'OBJECT'), w AS (SELECT pid, 'expression' AS why FROM r WHERE starts_with(coalesce(o, ''), '_:') OR contains(trim(coalesce(o, '')), ' some ') OR regexp_matches(coalesce(p, ''), 'equivalentClass|disjointWith|complementOf')
        UNION SELECT pid, 'unresolved' FROM (SELECT pid, unnest([s, o]) AS ref FROM r) u WHERE ref IS NOT NULL AND {LOCAL.format('trim(ref)')} NOT IN (SELECT f FROM known) AND NOT EXISTS (SELECT 1 FROM refs WHERE refs.pid = u.pid AND refs.ref = u.ref))
        SELECT p.pid, min(why) IS NOT NULL AS needed, min(why) AS why FROM p LEFT JOIN w USING (pid) GROUP BY 1""",
    "cat_ancestors": f"WITH RECURSIVE {UP} SELECT f AS fragment, a AS ancestor, depth FROM anc",
    "cat_clashes": f"WITH RECURSIVE {UP}, {DIS} SELECT a, b FROM clash",
    "cat_bindings": f"{G}, {UP}, {ADM} SELECT adm.locus, count(DISTINCT pid || ' ' || name) AS classes FROM e JOIN adm ON adm.f IN (e.anchor, e.parent) GROUP BY 1",
    "cat_unbound": f"{G}, {UP}, {ADM} SELECT DISTINCT pid || ' ' || name AS class FROM e WHERE (anchor <> '' OR parent <> '') AND NOT EXISTS (SELECT 1 FROM e x JOIN adm ON adm.f IN (x.anchor, x.parent) WHERE x.pid = e.pid AND x.name = e.name)",
    "cat_first_clash": f"""{G}, {UP}, {DIS}, t AS (SELECT pid || ' ' || name AS class, unnest([anchor, parent]) AS f FROM e), p AS (SELECT x.class, x.f AS a, y.f AS b FROM t x JOIN t y ON x.class = y.class AND x.f < y.f JOIN clash ON clash.a = x.f AND clash.b = y.f)
        SELECT class, min(a) AS a, arg_min(b, (a, b)) AS b FROM p GROUP BY 1""",
    "cat_entailed": f"{G}, {UP} SELECT a AS ancestor, count(DISTINCT pid || ' ' || name) AS classes FROM e JOIN anc ON anc.f IN (e.anchor, e.parent) GROUP BY 1",
    "cat_links": f"{G} SELECT name AS class, count(DISTINCT locus) AS links, count(DISTINCT locus) <= 1 OR bool_or(coalesce(span, '') <> '') AS kept FROM e WHERE locus <> 'none' GROUP BY 1",
    "cat_chain_profile": f"""{G}, c(locus, ordinal) AS (VALUES {", ".join(f"('{locus}', {i})" for i, (locus, _) in enumerate(K.CHAIN, 1))}), n AS (SELECT c.locus, c.ordinal, count(DISTINCT e.name) AS classes FROM c LEFT JOIN e ON e.locus = c.locus GROUP BY ALL)
        SELECT *, CASE WHEN classes = 0 THEN 'absent' WHEN classes < 3 THEN 'thin' ELSE 'thick' END AS state FROM n""",
    "expr_classes": f"""{G}, n AS (SELECT count(*) FILTER (WHERE regexp_full_match(o, '{lint.TERM}')) AS t, count(*) AS n FROM r WHERE o IS NOT NULL AND p IS NOT NULL)
        SELECT * FROM (SELECT NULL AS op, 6 * n - 4 * t AS texts FROM n UNION ALL SELECT 'not', t FROM n UNION ALL SELECT 'not_some', t FROM n UNION ALL SELECT 'some', 2 * t FROM n)""",
    "ld_identity": f"""{G}, k AS (SELECT *, trim(regexp_replace(lower(regexp_replace(label, '[‘’''"]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM e), h AS (SELECT norm, min(iri) AS iri, arg_min(kind, (iri, kind)) AS kind FROM k WHERE NOT is_new AND iri IS NOT NULL AND norm <> '' GROUP BY 1)
        SELECT DISTINCT k.pid, k.label, h.iri, h.kind FROM k JOIN h USING (norm) WHERE k.is_new AND k.label IS NOT NULL""",
    "lp_positions": """WITH n AS (SELECT DISTINCT corpus_id || '/' || source_locator AS pid, CASE lower(modality) WHEN 'duty' THEN 'duty' WHEN 'power' THEN 'power' WHEN 'permission' THEN 'privilege' WHEN 'exemption' THEN 'immunity' WHEN 'liability' THEN 'liability' END AS position, bearer_role FROM norm_tuples WHERE tuple_id IS NOT NULL AND source_locator IS NOT NULL AND corpus_id IS NOT NULL),
        c(a, b) AS (VALUES ('duty', 'claim'), ('power', 'liability'), ('privilege', 'no-claim'), ('immunity', 'disability'), ('liability', 'power'))
        SELECT DISTINCT pid, position, 'unheld' AS problem FROM n WHERE position IS NOT NULL AND coalesce(bearer_role, '') = '' UNION SELECT DISTINCT pid, position, 'no correlative' FROM n JOIN c ON c.a = position WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.pid = n.pid AND m.position = c.b)""",
}

#: The twins of problem 4.
P4 = f"""WITH {CHILDREN} SELECT DISTINCT event_id, 'entities' AS child, pos::INT AS pos, -1 AS sub_pos FROM ent UNION SELECT event_id, 'relations', pos::INT, -1 FROM rel
UNION SELECT event_id, 'open_questions', pos::INT, -1 FROM opq UNION SELECT event_id, 'possible_relations', pos::INT, sub_pos::INT FROM por"""
