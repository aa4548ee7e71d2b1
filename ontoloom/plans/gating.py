"""Queries of the gate. Parts stand for proposals: a part's names are its entities,
its line items its relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate, graph, nested
from ..sources import adapters as A
from ..sources.tables import table

UPPER = ["BRONZE", "COPPER", "STEEL", "ECONOMY", "PROMO", "STANDARD"]


def entities(spark, d):
    word = lambda i: F.initcap(F.element_at(F.split("p_name", " "), i))
    label = (
        F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("Non"), word(1)))
        .when(F.col("p_partkey") % 10 == 1, F.concat(word(1), F.lit("And"), word(2)))
        .when(F.col("p_partkey") % 10 == 2, F.concat("p_name", F.lit(" (reuse)")))
        .when(F.col("p_partkey") % 10 == 3, F.concat("p_name", F.lit(" which is held by the owner")))
        .otherwise(F.concat(word(1), word(2)))
    )
    return table(spark, d, "part").select(
        (F.col("p_partkey") % 500).alias("proposal_id"), F.col("p_partkey").alias("pos"), label.alias("label"), F.concat(F.lit("n:"), (F.col("p_partkey") % 25).cast("string")).alias("parent"),
        F.when(F.col("p_size") > 10, "class").otherwise("individual").alias("kind"), F.element_at(F.split("p_type", " "), 1).alias("category"), (F.col("p_size") % 2 == 0).alias("is_new"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("A n:"), (F.col("p_partkey") % 25).cast("string"), F.lit(" that is sold."))).when(F.col("p_size") % 3 == 1, "Something sold.").alias("definition"),
    )


def relations(spark, d):
    p = F.when(F.col("l_returnflag") == "A", "includes").when(F.col("l_returnflag") == "R", "excludes").otherwise("hasPart")
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("proposal_id"), F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("s"), p.alias("p"), F.col("l_suppkey").alias("o"))


def _static(spark):
    upper = spark.createDataFrame([(u,) for u in UPPER[:4]], "fragment STRING")
    return upper, spark.createDataFrame([("includes",), ("excludes",)], "property STRING")


def _two_parents(spark, d):
    """Customers with their nation, and a second nation for every eleventh, as entities."""
    sub = A.straddling_taxonomy(spark, d).where("child like 'c:%' and parent like 'n:%'")
    key = F.substring("child", 3, 20).cast("bigint")
    return sub.select((key % 100).alias("proposal_id"), F.col("child").alias("label"), "parent")


def _construction(spark, d):
    e, r = entities(spark, d), relations(spark, d)
    upper, words = _static(spark)
    return gate.together(gate.name_lint(e), gate.typing(e, upper, r, words), gate.contradictions(r), gate.definitions(e), gate.budget(e))


def _structural(spark, d):
    return gate.straddling(_two_parents(spark, d), graph.closure(A.taxonomy(spark, d)), A.region_disjointness(spark, d))


def _first(spark, d):
    both = gate.together(gate.budget(entities(spark, d)), gate.contradictions(relations(spark, d)), _structural(spark, d))
    return gate.first_violation(entities(spark, d), both)


def _recall(spark, d):
    labelled = spark.range(100).select(F.col("id").alias("proposal_id"), F.when(F.col("id") % 2 == 0, "lint").otherwise("construction").alias("expected"))
    return gate.recall(labelled, gate.together(gate.budget(entities(spark, d)), _structural(spark, d)))


def _collisions(spark, d):
    return gate.collisions(entities(spark, d), A.part_labels(spark, d))


def _signatures(spark, d):
    """Suppliers serve parts; anchors are their regions by key."""
    rel = relations(spark, d)
    anchors = rel.select(F.col("s").alias("term")).unionAll(rel.select("o")).distinct().select("term", (F.col("term") % 5).alias("anchor"))
    clash = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "a BIGINT, b BIGINT")
    return gate.signatures(rel, anchors, clash, spark.createDataFrame([("includes", 1, 2), ("excludes", 3, None)], "p STRING, domain BIGINT, range BIGINT"))


FAILURES = [("F1", "bfo_grounded", 1, "reasoner"), ("F1", "chain_bound", 2, "reasoner"), ("F2", "bfo_grounded", 1, None), ("F3", "profile_dl", 1, "reasoner"), ("F4", "chain_bound", 1, "prose")]
STATES = [("bfo_grounded", True), ("chain_bound", False), ("profile_dl", None)]
STRATA = [("A", "bfo_grounded"), ("B", "chain_bound"), ("B", "has_acts"), ("C", "profile_dl"), ("D", "world_data")]


def _resolve(spark, d):
    return gate.resolve(spark.createDataFrame(FAILURES, "failure STRING, precondition STRING, ordinal INT, instrument STRING"), spark.createDataFrame(STATES, "precondition STRING, satisfied BOOLEAN"))


def _coverage(spark, d):
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("subject"), (F.col("o_orderkey") % 3 != 0).alias("granted"), (F.col("o_orderkey") % 4 == 1).alias("excluded"), (F.col("o_orderkey") % 5 == 1).alias("restored"))
    return gate.coverage_rule(facts).groupBy("state").agg(F.count("*").alias("subjects"))


QUERIES = {
    "gate_construction": _construction,
    "gate_collisions": _collisions,
    "gate_structural": _structural,
    "gate_signatures": _signatures,
    "gate_first_violation": _first,
    "gate_recall": _recall,
    "gate_kernel_requests": lambda spark, d: gate.kernel_requests(nested.flat(table(spark, d, "session_log"), "open_questions")),
    "scope_resolution": _resolve,
    "scope_preconditions": lambda spark, d: gate.cumulative(spark.createDataFrame(STRATA, "stratum STRING, precondition STRING")),
    "coverage_rule": _coverage,
}

from .hierarchy import TREE  # noqa: E402
from .ontology import LABELS, key_sql  # noqa: E402

ENT = """w AS (SELECT *, upper(split_part(p_name, ' ', 1)[1]) || lower(split_part(p_name, ' ', 1)[2:]) AS a, upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS b FROM part),
e AS (SELECT p_partkey % 500 AS proposal_id, p_partkey AS pos, CASE p_partkey % 10 WHEN 0 THEN 'Non' || a WHEN 1 THEN a || 'And' || b WHEN 2 THEN p_name || ' (reuse)' WHEN 3 THEN p_name || ' which is held by the owner' ELSE a || b END AS label,
    'n:' || (p_partkey % 25) AS parent, CASE WHEN p_size > 10 THEN 'class' ELSE 'individual' END AS kind, split_part(p_type, ' ', 1) AS category, p_size % 2 = 0 AS is_new,
    CASE p_size % 3 WHEN 0 THEN 'A n:' || (p_partkey % 25) || ' that is sold.' WHEN 1 THEN 'Something sold.' END AS definition FROM w)"""
REL = "r AS (SELECT l_partkey % 500 AS proposal_id, l_orderkey AS pos, l_partkey AS s, CASE l_returnflag WHEN 'A' THEN 'includes' WHEN 'R' THEN 'excludes' ELSE 'hasPart' END AS p, l_suppkey AS o FROM lineitem)"
BUD = "bud AS (SELECT proposal_id, 'construction' AS tier, 'BUD-1' AS code, count(*)::VARCHAR AS subject FROM e WHERE is_new AND kind = 'class' GROUP BY 1 HAVING count(*) > 5)"
CON = "con AS (SELECT proposal_id, 'construction' AS tier, 'PC-11' AS code, s || ' ' || o AS subject FROM r GROUP BY proposal_id, s, o HAVING bool_or(p = 'includes') AND bool_or(p = 'excludes'))"
STR = """u AS (SELECT c_custkey % 100 AS proposal_id, 'c:' || c_custkey AS label, 'n:' || c_nationkey AS parent FROM customer UNION ALL SELECT c_custkey % 100, 'c:' || c_custkey, 'n:' || ((c_nationkey + 6) % 25) FROM customer WHERE c_custkey % 11 = 0),
st AS (SELECT DISTINCT x.proposal_id, 'lint' AS tier, 'GS-1' AS code, x.label AS subject FROM u x JOIN u y ON x.label = y.label JOIN reach p ON p.node = x.parent AND p.ancestor LIKE 'r:%' JOIN reach q ON q.node = y.parent AND q.ancestor LIKE 'r:%' AND q.ancestor > p.ancestor)"""



SQL = {
    "gate_construction": f"""WITH {ENT}, {REL}, {BUD}, {CON}, v AS (
        SELECT proposal_id, 'construction' AS tier, 'PC-1' AS code, label AS subject FROM e WHERE regexp_matches(label, '{gate.PRIVATION}')
        UNION SELECT proposal_id, 'construction', 'PC-2', label FROM e WHERE len(regexp_extract_all(label, '[A-Z][a-z]*|[a-z]+')) >= 4 OR regexp_matches(label, '{gate.CONNECTIVE}')
        UNION SELECT proposal_id, 'construction', 'PC-17', label FROM e WHERE regexp_matches(label, '{gate.META_LABEL}')
        UNION SELECT proposal_id, 'construction', 'PC-18', label FROM e WHERE len(regexp_split_to_array(trim(label), '\\s+')) > 5 AND NOT regexp_matches(label, '{gate.EXPRESSION}')
        UNION SELECT proposal_id, 'construction', 'PC-3', label FROM e WHERE is_new AND category NOT IN ({", ".join(f"'{u}'" for u in UPPER[:4])})
        UNION SELECT proposal_id, 'construction', 'PC-4', p FROM r WHERE p NOT IN ('includes', 'excludes')
        UNION SELECT * FROM con UNION SELECT proposal_id, 'construction', 'PC-14 missing', label FROM e WHERE is_new AND kind = 'class' AND definition IS NULL
        UNION SELECT proposal_id, 'construction', 'PC-14 genus', label FROM e WHERE is_new AND kind = 'class' AND definition IS NOT NULL AND NOT contains(lower(definition), lower(parent))
        UNION SELECT * FROM bud) SELECT * FROM v""",
    "gate_collisions": f"""WITH {ENT}, {LABELS}, k AS (SELECT *, {key_sql('label')} AS key FROM e), h AS (SELECT {key_sql('label')} AS key FROM l)
        SELECT DISTINCT proposal_id, 'construction' AS tier, 'PC-15' AS code, label AS subject FROM k WHERE key <> '' AND is_new AND key IN (SELECT key FROM h)
        UNION SELECT proposal_id, 'construction', 'PC-16', key FROM k WHERE key <> '' GROUP BY proposal_id, key HAVING count(DISTINCT category) > 1""",
    "gate_structural": f"{TREE}, {STR} SELECT * FROM st",
    "gate_signatures": f"""WITH {REL}, g(p, d, rg) AS (VALUES ('includes', 1, 2), ('excludes', 3, NULL)), k(a, b) AS (VALUES (0, 1), (1, 0), (2, 3), (3, 2))
        SELECT DISTINCT proposal_id, 'lint' AS tier, 'GS-2' AS code, concat_ws(' ', r.p, s) AS subject FROM r JOIN g ON g.p = r.p JOIN k ON k.a = s % 5 AND k.b = d
        UNION SELECT proposal_id, 'lint', 'GS-2', concat_ws(' ', r.p, o) FROM r JOIN g ON g.p = r.p JOIN k ON k.a = o % 5 AND k.b = rg""",
    "gate_first_violation": f"""{TREE}, {ENT}, {REL}, {BUD}, {CON}, {STR}, v AS (SELECT * FROM bud UNION SELECT * FROM con UNION SELECT * FROM st)
        SELECT x.proposal_id, CASE WHEN count(v.code) = 0 THEN 'needs_reasoner' ELSE 'reject' END AS outcome, min(v.tier) AS tier, arg_min(v.code, (v.tier, v.code)) FILTER (WHERE v.code IS NOT NULL) AS code, count(v.code) AS violations FROM (SELECT DISTINCT proposal_id FROM e) x LEFT JOIN v USING (proposal_id) GROUP BY 1""",
    "gate_recall": f"""{TREE}, {ENT}, {BUD}, {STR}, l AS (SELECT range AS proposal_id, CASE WHEN range % 2 = 0 THEN 'lint' ELSE 'construction' END AS expected FROM range(100)), v AS (SELECT DISTINCT proposal_id, tier FROM (SELECT * FROM bud UNION SELECT * FROM st))
        SELECT expected, count(*) AS n, count(v.tier) AS caught, round(count(v.tier) / count(*), 3) AS recall FROM l LEFT JOIN v ON v.proposal_id = l.proposal_id AND v.tier = expected GROUP BY 1""",
    "scope_resolution": """SELECT * FROM (VALUES ('F1', 'out_of_scope', 'chain_bound'), ('F2', 'human', NULL), ('F3', 'undetermined', 'profile_dl'), ('F4', 'out_of_scope', 'chain_bound')) v(failure, verdict, first_unmet)""",
    "scope_preconditions": """WITH p(stratum, precondition) AS (VALUES ('A', 'bfo_grounded'), ('B', 'chain_bound'), ('B', 'has_acts'), ('C', 'profile_dl'), ('D', 'world_data'))
        SELECT s.stratum, string_agg(DISTINCT p.precondition, ',' ORDER BY p.precondition) AS needed FROM (SELECT DISTINCT stratum FROM p) s JOIN p ON p.stratum <= s.stratum GROUP BY 1""",
    "coverage_rule": """WITH f AS (SELECT o_orderkey % 3 <> 0 AS g, o_orderkey % 4 = 1 AND o_orderkey % 5 <> 1 AS x FROM orders) SELECT CASE WHEN g AND x THEN 'contradiction' WHEN g THEN 'covered' WHEN x THEN 'excluded' ELSE 'indeterminate' END AS state, count(*) AS subjects FROM f GROUP BY 1""",
}
