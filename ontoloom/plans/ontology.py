"""Queries over triples, labels and detectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors as D
from ..operators import graph
from ..operators import triples as G
from ..sources import adapters as A
from ..sources.tables import table
from .hierarchy import STRADDLE, SUB, TREE

TRIPLES = SUB + """, t AS (
    SELECT child AS s, 'iri' AS s_kind, 'rdfs:subClassOf' AS p, parent AS o, 'iri' AS o_kind FROM sub
    UNION ALL SELECT n, 'iri', 'rdf:type', 'owl:Class', 'iri' FROM (SELECT child AS n FROM sub UNION SELECT parent FROM sub)
    UNION ALL SELECT 'n:' || n_nationkey, 'iri', 'rdfs:label', n_name, 'lit' FROM nation
    UNION ALL SELECT 'r:' || r_regionkey, 'iri', 'rdfs:label', r_name, 'lit' FROM region
    UNION ALL SELECT 'part:' || p_partkey, 'iri', 'rdf:type', 'type:' || replace(p_type, ' ', '_'), 'iri' FROM part
    UNION ALL SELECT 'part:' || p_partkey, 'iri', 'rdfs:label', p_name, 'lit' FROM part
    UNION ALL SELECT 'part:' || p_partkey, 'iri', 'hasBrand', p_brand, 'lit' FROM part
    UNION ALL SELECT 'part:' || p_partkey, 'iri', 'hasSize', p_size::VARCHAR, 'lit' FROM part WHERE p_size > 40
    UNION ALL SELECT 'part:' || p_partkey, 'iri', 'rdf:type', 'owl:Class', 'iri' FROM part WHERE p_partkey % 50 = 0
    UNION ALL SELECT name, 'iri', 'rdf:type', 'owl:ObjectProperty', 'iri' FROM (VALUES ('locatedIn'), ('hasBrand'), ('neverUsed')) v(name)
    UNION ALL SELECT 'n:' || n_nationkey, 'iri', 'rdfs:subClassOf', '_:n' || n_nationkey, 'bnode' FROM nation
    UNION ALL SELECT '_:n' || n_nationkey, 'bnode', 'rdf:type', 'owl:Restriction', 'iri' FROM nation
    UNION ALL SELECT '_:n' || n_nationkey, 'bnode', 'owl:onProperty', 'locatedIn', 'iri' FROM nation
    UNION ALL SELECT '_:n' || n_nationkey, 'bnode', 'owl:someValuesFrom', 'r:' || n_regionkey, 'iri' FROM nation)"""
RESTR = "x AS (SELECT h.s AS class, a.o AS property, 'some' AS quantifier, f.o AS filler FROM t h JOIN t a ON a.s = h.o AND a.p = 'owl:onProperty' JOIN t f ON f.s = h.o AND f.p = 'owl:someValuesFrom' WHERE h.p = 'rdfs:subClassOf' AND h.o_kind = 'bnode')"
LABELS = """l0 AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
l1 AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN b ELSE a END AS one, CASE WHEN p_partkey % 2 = 1 THEN a ELSE b END AS two FROM l0),
l AS (SELECT 'part:' || p_partkey AS iri, (CASE WHEN p_partkey % 3 = 0 THEN upper(one[1]) || one[2:] || upper(two[1]) || two[2:] ELSE one || ' ' || two END) || CASE WHEN p_partkey % 5 = 0 THEN 'Process' ELSE '' END AS label FROM l1)"""


def _quoted(words):
    return ", ".join(f"'{w}'" for w in words)


def key_sql(label: str) -> str:
    bare = f"lower(regexp_replace(regexp_replace({label}, '\\([^)]*\\)', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'))"
    return f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({bare}, '[a-z]+'), lambda w: w NOT IN ({_quoted(T.LABEL_NOISE)})))), ' ')"


BAG_SQL = f"array_to_string(list_sort(list_filter(list_transform(regexp_extract_all(label, '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), lambda w: lower(w)), lambda w: w NOT IN ({_quoted(T.BAG_STOP)}))), ' ')"
STEM_SQL = "CASE " + " ".join(f"WHEN label LIKE '%{s}' AND length(label) > {len(s) + 3} THEN lower(label[1:length(label) - {len(s)}])" for s in T.NAME_SUFFIXES) + " END"


def _t(operator):
    return lambda spark, d: operator(A.triples(spark, d))


def _l(operator):
    return lambda spark, d: operator(A.part_labels(spark, d))


def _keys(l):
    rows = l.select("iri", T.label_key(F.col("label")).alias("norm"), T.reservation_key(F.col("label")).alias("reserved"), T.term_key(F.col("label")).alias("term"), T.label_norm(F.col("label")).alias("plain"), T.search_norm(F.col("label")).alias("search"), T.content_hash(F.col("iri"), F.col("label")).alias("hash"))
    return rows


def _bags(l):
    """HIER-17: word bags of two words or more with several names."""
    rows = l.select("label", T.word_bag(F.col("label")).alias("bag")).distinct()
    return rows.where(F.col("bag").contains(" ")).groupBy("bag").agg(F.count("*").alias("names"), F.min("label").alias("first")).where("names > 1")


def _stems(l):
    rows = l.select("label", T.name_stem(F.col("label")).alias("stem")).distinct().where(F.length("stem") >= 4)
    return rows.groupBy("stem").agg(F.count("*").alias("names"))


def _reuse(l, k=5, least=0.3):
    """TOP-1: for each distinct key, the k most similar other keys by Jaccard. Keys meet
    through their words, so only keys that share one are ever paired."""
    keys = l.select(T.label_key(F.col("label")).alias("key")).distinct().where("key <> ''").withColumn("words", F.split("key", " "))
    words = keys.select("key", F.explode("words").alias("w"))
    met = words.join(words.select(F.col("key").alias("other"), "w"), "w").where("key <> other").groupBy("key", "other").agg(F.count("*").alias("shared"))
    sized = met.join(keys.select("key", F.size("words").alias("n")), "key").join(keys.select(F.col("key").alias("other"), F.size("words").alias("m")), "other")
    scored = sized.withColumn("similarity", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 3)).where(F.col("similarity") >= least)
    best = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("key", "other", "similarity", "place")


def _with_bare(spark, d):
    """The triples, and orders as individuals that hold the parts of their discounted lines."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = lambda df, s, p, o: df.select(s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), F.lit("orders").alias("source"))
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_discount > 0.05")
    return A.triples(spark, d).unionAll(made(orders, name("order:", "o_orderkey"), G.TYPE, F.lit("Order"))).unionAll(made(lines, name("order:", "l_orderkey"), "holds", name("part:", "l_partkey")))


def _ck_a1(spark, d):
    """Customers divisible by 13 exclude the region after their own; the straddling
    ones among them are under it."""
    excluded = table(spark, d, "customer").where("c_custkey % 13 = 0").join(table(spark, d, "nation"), F.col("n_nationkey") == (F.col("c_nationkey") + 6) % 25)
    pairs = excluded.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("class"), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("other"))
    return D.ck_a1(graph.closure(A.straddling_taxonomy(spark, d)), pairs)


def _ck_a3(spark, d):
    t = A.triples(spark, d)
    return D.ck_a3(G.subclass_edges(t), G.restrictions(t), A.region_disjointness(spark, d), "n:")


def _ck_b2(spark, d):
    """Parts as acts, their suppliers as assessors, the suppliers' nations as grants."""
    line, supplier = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return D.ck_b2(line.select(F.col("l_partkey").alias("act"), F.col("l_suppkey").alias("assessor")), supplier.select(F.col("s_suppkey").alias("assessor"), F.col("s_nationkey").alias("grant")))


def _ck_c3(spark, d):
    """Suppliers serve nations; the signature wants suppliers of region 1 and nations of region 2."""
    supplier = table(spark, d, "supplier")
    rel = supplier.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("s"), F.lit("serves").alias("p"), F.concat(F.lit("n:"), ((F.col("s_nationkey") + 3) % 25).cast("string")).alias("o"))
    sig = spark.createDataFrame([("serves", "r:1", "r:2")], "p STRING, domain STRING, range STRING")
    return D.ck_c3(rel, sig, graph.closure(A.taxonomy(spark, d)))


def _acts(spark, d, flag, column="l_suppkey"):
    return table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("act"), F.col(column).alias("condition"))


def _ck_d3(spark, d):
    """Suppliers are paths that repair parts; a path excludes the supplier three on."""
    paths = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("act"))
    suppliers = table(spark, d, "supplier")
    excl = suppliers.select(F.col("s_suppkey").alias("path"), (F.col("s_suppkey") + 3).alias("other")).unionAll(suppliers.where("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 3), F.col("s_suppkey")))
    return D.ck_d3(paths, excl)


def _ka_a1(spark, d):
    """Orders as individuals: of their customer's nation, and of the nation of the next customer."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    typed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("individual"), F.explode(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + F.col("o_orderkey") % 3) % 25)).alias("n"))
    typed = typed.select("individual", F.concat(F.lit("n:"), F.col("n").cast("string")).alias("class"))
    return D.ka_a1(typed, graph.closure(A.taxonomy(spark, d)), A.region_disjointness(spark, d))


def _criteria(spark, d):
    line, nation = table(spark, d, "customer"), table(spark, d, "nation")
    crit = line.select(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("class"), F.lit("segment").alias("property"), F.concat_ws("/", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("filler"))
    pairs = nation.select("n_nationkey", "n_regionkey").join(nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")), (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") < F.col("k")))
    named = pairs.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("a"), F.concat(F.lit("n:"), F.col("k").cast("string")).alias("b"))
    return D.shared_criteria(named, crit)


def _justify(spark, d):
    sub = A.straddling_taxonomy(spark, d)
    return D.justification(graph.closure(sub), A.region_disjointness(spark, d), sub)


def _merge(spark, d):
    """Nations of an even key are merged into the one after them."""
    nation = table(spark, d, "nation").where("n_nationkey % 2 = 0 and n_nationkey < 24")
    renamed = nation.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("old"), F.concat(F.lit("n:"), (F.col("n_nationkey") + 1).cast("string")).alias("new"))
    return G.merge_terms(A.triples(spark, d), renamed).groupBy("p").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"))


def _purge(spark, d):
    terms = table(spark, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("term"))
    return G.purge(A.triples(spark, d), terms).groupBy("p").agg(F.count("*").alias("triples"))


def _precedence(spark, d):
    """Line items as modules: part and flag, the supplier as value, the line number as rank."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_suppkey").alias("o"), F.col("l_linenumber").alias("rank"))
    return G.module_precedence(rows)


def _world(spark, d):
    touched = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("individual"))
    return G.reduced_world(A.triples(spark, d), touched).groupBy("p").agg(F.count("*").alias("triples"))


def _canonical(spark, d):
    """Regions and nations are canonical; orders are individuals of their customer."""
    t, sub = A.triples(spark, d), A.taxonomy(spark, d)
    nodes = sub.select(F.col("parent").alias("class")).where("class <> 'entity'").distinct()
    typed = table(spark, d, "orders").select(F.col("o_orderkey").alias("individual"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("class"))
    return G.canonical_coverage(nodes, graph.closure(sub), typed, G.restrictions(t))


def _gates(spark, d):
    one = G.census(A.triples(spark, d))
    metrics = one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("classes", "labelled", "restrictions", "properties")])))
    return G.quality_gates(metrics, spark.createDataFrame([("classes", 100.0, None), ("labelled", None, 50.0), ("restrictions", 20.0, 30.0), ("never_measured", 1.0, None)], "metric STRING, least DOUBLE, most DOUBLE"))


def _misuse(spark, d):
    return G.realizable_misuse(G.restrictions(A.triples(spark, d)), graph.closure(A.taxonomy(spark, d)), "r:1", "r:2")


QUERIES = {
    "report_reduced_world": _world,
    "report_canonical_coverage": _canonical,
    "report_quality_gates": _gates,
    "rm_misuse": _misuse,
    "census_metrics": _t(G.census),
    "census_relation_usage": _t(G.relation_usage),
    "census_undeclared": _t(G.undeclared),
    "census_visibility": _t(G.visibility),
    "census_punned": _t(G.punned),
    "census_restrictions": _t(G.restrictions),
    "census_shared_fillers": _t(G.shared_fillers),
    "census_shared_labels": _t(lambda t: G.shared_labels(G.labels(t))),
    "census_isolated": lambda spark, d: G.isolated(_with_bare(spark, d)),
    "census_validate": _t(G.validate),
    "label_norm_keys": _l(_keys),
    "label_synonym_clusters": _l(G.synonym_clusters),
    "label_wordbag_clusters": _l(_bags),
    "label_stem_variants": _l(_stems),
    "label_reuse_topk": _l(_reuse),
    "ck_a1_excluded_parent": _ck_a1,
    "ck_a3_vacuous": _ck_a3,
    "ck_b2_authority": _ck_b2,
    "ck_c1_both_roots": lambda spark, d: D.ck_c1(graph.closure(A.straddling_taxonomy(spark, d)), "r:1", "r:2"),
    "ck_c3_domain_range": _ck_c3,
    "ck_d1_dispersion": lambda spark, d: D.ck_d1(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_quantity").alias("rate"))),
    "ck_d2_self_defeat": lambda spark, d: D.ck_d2(_acts(spark, d, "A"), _acts(spark, d, "R")),
    "ck_d3_competing_paths": _ck_d3,
    "ka_a1_individuals": _ka_a1,
    "just_straddles": _justify,
    "icd_shared_criteria": _criteria,
    "rewrite_merge_terms": _merge,
    "rewrite_purge": _purge,
    "rewrite_declarations": _t(G.declaration_repairs),
    "rewrite_module_precedence": _precedence,
}

T_ = f"WITH {TRIPLES}"
SQL = {
    "report_reduced_world": f"""{T_}, n AS (SELECT * FROM t WHERE s IN (SELECT 'part:' || p_partkey FROM part WHERE p_partkey % 100 = 0)),
        w AS (SELECT * FROM t WHERE p = 'rdfs:subClassOf' OR (p = 'rdf:type' AND regexp_matches(o, '^(rdf|rdfs|owl):')) OR s_kind = 'bnode' UNION SELECT * FROM n UNION SELECT * FROM t WHERE s IN (SELECT o FROM n WHERE o_kind = 'iri')) SELECT p, count(*) AS triples FROM w GROUP BY 1""",
    "report_canonical_coverage": f"""{TREE}, c AS (SELECT DISTINCT parent AS class FROM sub WHERE parent <> 'entity')
        SELECT class, (SELECT count(*) FROM reach WHERE ancestor = class) AS subclasses, (SELECT count(DISTINCT o_orderkey) FROM orders JOIN reach ON node = 'c:' || o_custkey AND ancestor = class) AS instances,
        (SELECT count(*) FROM nation WHERE 'r:' || n_regionkey = class) AS restrictions FROM c""",
    "report_quality_gates": f"""{T_}, m AS (SELECT count(DISTINCT s) FILTER (WHERE o = 'owl:Class')::DOUBLE AS c, count(DISTINCT s) FILTER (WHERE p = 'rdfs:label')::DOUBLE AS l, count(*) FILTER (WHERE o = 'owl:Restriction')::DOUBLE AS r FROM t)
        SELECT 'classes' AS gate, c AS value, 100.0::DOUBLE AS bound, c >= 100 AS passed FROM m UNION ALL SELECT 'labelled', l, 50.0, l <= 50 FROM m UNION ALL SELECT 'restrictions', r, 20.0, r BETWEEN 20 AND 30 FROM m UNION ALL SELECT 'never_measured', NULL, 1.0, false""",
    "rm_misuse": f"{TREE} SELECT 'n:' || n_nationkey AS class, 'locatedIn' AS property, 'r:' || n_regionkey AS filler FROM nation WHERE 'n:' || n_nationkey IN (SELECT node FROM reach WHERE ancestor = 'r:1') AND 'r:' || n_regionkey NOT IN (SELECT node FROM reach WHERE ancestor = 'r:2')",
    "census_metrics": f"""{T_} SELECT count(*) AS triples, count(DISTINCT s) FILTER (WHERE p = 'rdf:type' AND o = 'owl:Class') AS classes, count(DISTINCT s) FILTER (WHERE p = 'rdf:type' AND NOT regexp_matches(o, '^(rdf|rdfs|owl):')) AS individuals,
        count(DISTINCT s) FILTER (WHERE p = 'rdf:type' AND o LIKE '%Property') AS properties, count(*) FILTER (WHERE p = 'rdfs:subClassOf') AS subclass_axioms, count(*) FILTER (WHERE o = 'owl:Restriction') AS restrictions,
        count(DISTINCT s) FILTER (WHERE p = 'rdfs:label') AS labelled, count(*) FILTER (WHERE o_kind = 'lit') AS literals FROM t""",
    "census_relation_usage": f"{T_} SELECT p, count(*) AS uses, count(DISTINCT s) AS subjects FROM t GROUP BY 1",
    "census_undeclared": f"""{T_}, dec AS (SELECT DISTINCT s AS property FROM t WHERE p = 'rdf:type' AND o LIKE '%Property'), used AS (SELECT DISTINCT p AS property FROM t WHERE NOT regexp_matches(p, '^(rdf|rdfs|owl):'))
        SELECT property, 'undeclared' AS problem FROM used WHERE property NOT IN (SELECT property FROM dec) UNION ALL SELECT property, 'unused' FROM dec WHERE property NOT IN (SELECT property FROM used) AND property NOT IN (SELECT o FROM t WHERE p = 'owl:onProperty')""",
    "census_visibility": f"""{T_}, {RESTR}, v AS (SELECT count(*) AS visible FROM (SELECT DISTINCT class, property, filler FROM x)), i AS (SELECT count(*) AS bare FROM t WHERE NOT regexp_matches(p, '^(rdf|rdfs|owl):') AND o_kind = 'iri' AND s IN (SELECT s FROM t WHERE p = 'rdf:type' AND o = 'owl:Class'))
        SELECT visible, visible + bare AS intended, CASE WHEN visible + bare = 0 THEN 1.0::DOUBLE ELSE round(visible / (visible + bare), 6) END AS ratio FROM v, i""",
    "census_punned": f"{T_} SELECT s AS iri FROM t WHERE p = 'rdf:type' AND o = 'owl:Class' INTERSECT SELECT s FROM t WHERE p = 'rdf:type' AND NOT regexp_matches(o, '^(rdf|rdfs|owl):')",
    "census_restrictions": f"{T_}, {RESTR} SELECT * FROM x",
    "census_shared_fillers": f"{T_}, {RESTR} SELECT filler, count(DISTINCT class) AS classes FROM x GROUP BY 1 HAVING count(DISTINCT class) > 1",
    "census_shared_labels": f"{T_} SELECT o AS label, count(DISTINCT s) AS iris FROM t WHERE p = 'rdfs:label' AND o <> '' GROUP BY 1 HAVING count(DISTINCT s) > 1",
    "census_isolated": f"""{T_}, b AS (SELECT s, 'iri' AS s_kind, p, o, o_kind FROM t UNION ALL SELECT 'order:' || o_orderkey, 'iri', 'rdf:type', 'Order', 'iri' FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'iri', 'holds', 'part:' || l_partkey, 'iri' FROM lineitem WHERE l_discount > 0.05), r AS (SELECT * FROM b WHERE NOT regexp_matches(p, '^(rdf|rdfs|owl):')) SELECT DISTINCT s AS individual FROM b WHERE p = 'rdf:type' AND s_kind = 'iri' AND NOT regexp_matches(o, '^(rdf|rdfs|owl):')
        AND s NOT IN (SELECT s FROM r) AND s NOT IN (SELECT o FROM r WHERE o_kind = 'iri')""",
    "census_validate": f"""{T_}, c AS (SELECT DISTINCT s FROM t WHERE p = 'rdf:type' AND o = 'owl:Class' AND s_kind = 'iri')
        SELECT 'untyped_anonymous' AS rule, count(DISTINCT s) AS violations FROM t WHERE s_kind = 'bnode' AND s NOT IN (SELECT s FROM t WHERE p = 'rdf:type')
        UNION ALL SELECT 'ungrounded_class', count(*) FROM c WHERE s NOT IN (SELECT s FROM t WHERE p = 'rdfs:subClassOf') UNION ALL SELECT 'class_without_label', count(*) FROM c WHERE s NOT IN (SELECT s FROM t WHERE p = 'rdfs:label')
        UNION ALL SELECT 'restriction_without_filler', count(*) FROM t WHERE o = 'owl:Restriction' AND s NOT IN (SELECT s FROM t WHERE p = 'owl:someValuesFrom')""",
    "label_norm_keys": f"""WITH {LABELS} SELECT iri, {key_sql("label")} AS norm,
        array_to_string(list_transform(string_split(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[1:length(w) - 1] ELSE w END), ' ') AS reserved,
        (SELECT CASE WHEN k LIKE '%ies' AND length(k) > 5 THEN k[1:length(k) - 3] || 'y' WHEN k LIKE '%es' AND length(k) > 4 THEN k[1:length(k) - 2] WHEN k LIKE '%s' AND length(k) > 3 THEN k[1:length(k) - 1] ELSE k END FROM (SELECT regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS k)) AS term,
        trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS plain, ' ' || trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) || ' ' AS search, substr(sha256(trim(iri) || chr(1) || trim(label)), 1, 10) AS hash FROM l""",
    "label_synonym_clusters": f"WITH {LABELS} SELECT {key_sql('label')} AS key, count(*) AS members, min(iri) AS first FROM l GROUP BY 1 HAVING count(*) > 1",
    "label_wordbag_clusters": f"WITH {LABELS}, b AS (SELECT DISTINCT label, {BAG_SQL} AS bag FROM l) SELECT bag, count(*) AS names, min(label) AS first FROM b WHERE bag LIKE '% %' GROUP BY 1 HAVING count(*) > 1",
    "label_stem_variants": f"WITH {LABELS}, b AS (SELECT DISTINCT label, {STEM_SQL} AS stem FROM l) SELECT stem, count(*) AS names FROM b WHERE length(stem) >= 4 GROUP BY 1",
    "label_reuse_topk": f"""WITH {LABELS}, k AS (SELECT DISTINCT {key_sql('label')} AS key FROM l), w AS (SELECT key, string_split(key, ' ') AS v FROM k WHERE key <> ''),
        p AS (SELECT a.key, b.key AS other, round(len(list_intersect(a.v, b.v)) / (len(a.v) + len(b.v) - len(list_intersect(a.v, b.v))), 3) AS similarity FROM w a JOIN w b ON a.key <> b.key),
        r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, other)::INT AS place FROM p WHERE similarity >= 0.3) SELECT key, other, similarity, place FROM r WHERE place <= 5""",
    "ck_a1_excluded_parent": f"{STRADDLE} SELECT DISTINCT 'CK' AS family, 'K-A1' AS code, 'c:' || c_custkey AS subject, 'under and outside r:' || n_regionkey AS detail FROM customer JOIN nation ON n_nationkey = (c_nationkey + 6) % 25 JOIN reach r ON r.node = 'c:' || c_custkey AND r.ancestor = 'r:' || n_regionkey WHERE c_custkey % 13 = 0",
    "ck_a3_vacuous": f"""{T_}, {RESTR}, e AS (SELECT s, bool_and(o LIKE 'n:%') AS upper_only FROM t WHERE p = 'rdfs:subClassOf' AND s_kind = 'iri' AND o_kind = 'iri' GROUP BY 1)
        SELECT 'CK' AS family, 'K-A3' AS code, class AS subject, 'filler is the class' AS detail FROM x WHERE class = filler UNION SELECT 'CK', 'K-A3', s, 'vacuous' FROM e WHERE upper_only AND s NOT IN (SELECT class FROM x)""",
    "ck_b2_authority": "SELECT 'CK' AS family, 'K-B2' AS code, l_partkey AS subject, concat(count(DISTINCT l_suppkey), '/', count(DISTINCT s_nationkey)) AS detail FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT s_nationkey) >= 2",
    "ck_c1_both_roots": f"{STRADDLE} SELECT 'CK' AS family, 'K-C1' AS code, node AS subject, 'under r:1 and r:2' AS detail FROM reach WHERE ancestor IN ('r:1', 'r:2') GROUP BY node HAVING count(DISTINCT ancestor) = 2",
    "ck_c3_domain_range": f"""{TREE}, rel AS (SELECT 's:' || s_suppkey AS s, 'n:' || ((s_nationkey + 3) % 25) AS o FROM supplier)
        SELECT DISTINCT 'CK' AS family, 'K-C3' AS code, s AS subject, 'domain of serves' AS detail FROM rel WHERE s NOT IN (SELECT node FROM reach WHERE ancestor = 'r:1') UNION SELECT 'CK', 'K-C3', o, 'range of serves' FROM rel WHERE o NOT IN (SELECT node FROM reach WHERE ancestor = 'r:2')""",
    "ck_d1_dispersion": "SELECT 'CK' AS family, 'K-D1' AS code, l_suppkey AS subject, concat_ws(' ', count(*), round(round(stddev_samp(l_quantity), 6), 3)) AS detail FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 30 AND round(stddev_samp(l_quantity), 6) >= 5",
    "ck_d2_self_defeat": "SELECT 'CK' AS family, 'K-D2' AS code, act AS subject, 'requires and excludes ' || condition AS detail FROM (SELECT l_partkey AS act, l_suppkey AS condition FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')",
    "ck_d3_competing_paths": """WITH p AS (SELECT DISTINCT l_suppkey AS path, l_partkey AS act FROM lineitem), x AS (SELECT s_suppkey AS path, s_suppkey + 3 AS other FROM supplier UNION SELECT s_suppkey + 3, s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
        SELECT 'CK' AS family, 'K-D3' AS code, a.act AS subject, concat_ws(' ', x.path, CASE WHEN EXISTS (SELECT 1 FROM x y WHERE y.path = x.other AND y.other = x.path) THEN '<>' ELSE '>' END, x.other) AS detail FROM x JOIN p a ON a.path = x.path JOIN p b ON b.path = x.other AND b.act = a.act""",
    "ka_a1_individuals": f"""{TREE}, o AS (SELECT o_orderkey AS i, c_nationkey AS n, (c_nationkey + o_orderkey % 3) % 25 AS m FROM orders JOIN customer ON c_custkey = o_custkey),
        ty AS (SELECT i, 'n:' || n AS class FROM o UNION SELECT i, 'n:' || m FROM o), al AS (SELECT * FROM ty UNION SELECT i, ancestor FROM ty JOIN reach ON node = class)
        SELECT DISTINCT 'KA' AS family, 'K-A1' AS code, a.i AS subject, a.class || ' and ' || b.class AS detail FROM al a JOIN al b ON a.i = b.i AND a.class < b.class WHERE a.class LIKE 'r:%' AND b.class LIKE 'r:%'""",
    "just_straddles": f"""{STRADDLE}, g AS (SELECT DISTINCT x.node, d.a, d.b FROM disjoint d JOIN reach x ON x.ancestor = d.a JOIN reach y ON y.node = x.node AND y.ancestor = d.b)
        SELECT g.node, (SELECT string_agg(DISTINCT parent, ' ' ORDER BY parent) FROM sub WHERE child = g.node) AS parents, count(*) AS pairs, min(a || ' ' || b) AS first_pair FROM g GROUP BY g.node""",
    "icd_shared_criteria": """WITH c AS (SELECT DISTINCT 'n:' || c_nationkey AS class, c_mktsegment || '/' || floor(c_acctbal / 1000)::BIGINT AS filler FROM customer), p AS (SELECT 'n:' || a.n_nationkey AS a, 'n:' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
        m AS (SELECT m, count(*) AS n FROM (SELECT a AS m FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
        SELECT p.a, p.b, (SELECT count(*) FROM c x JOIN c y ON x.filler = y.filler WHERE x.class = p.a AND y.class = p.b) AS shared, ma.n + mb.n AS participation FROM p JOIN m ma ON ma.m = p.a JOIN m mb ON mb.m = p.b""",
    "rewrite_merge_terms": f"""{T_}, r AS (SELECT 'n:' || n_nationkey AS old, 'n:' || (n_nationkey + 1) AS new FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey < 24),
        m AS (SELECT DISTINCT coalesce(a.new, s) AS s, CASE WHEN p = 'rdfs:label' AND a.new IS NOT NULL THEN 'skos:altLabel' ELSE p END AS p, CASE WHEN o_kind = 'lit' THEN o ELSE coalesce(b.new, o) END AS o FROM t LEFT JOIN r a ON a.old = s LEFT JOIN r b ON b.old = o)
        SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects FROM m WHERE NOT (p = 'rdfs:subClassOf' AND s = o) GROUP BY 1""",
    "rewrite_purge": f"""{T_}, g AS (SELECT 'r:' || r_regionkey AS term FROM region WHERE r_regionkey < 2 UNION SELECT s FROM t WHERE p = 'owl:someValuesFrom' AND o IN (SELECT 'r:' || r_regionkey FROM region WHERE r_regionkey < 2))
        SELECT p, count(*) AS triples FROM t WHERE s NOT IN (SELECT term FROM g) AND o NOT IN (SELECT term FROM g) GROUP BY 1""",
    "rewrite_declarations": f"""{T_}, dec AS (SELECT DISTINCT s FROM t WHERE p = 'rdf:type' AND o LIKE '%Property') SELECT p AS property, CASE WHEN bool_and(o_kind = 'lit') THEN 'owl:DatatypeProperty' ELSE 'owl:ObjectProperty' END AS kind FROM t WHERE NOT regexp_matches(p, '^(rdf|rdfs|owl):') AND p NOT IN (SELECT s FROM dec) GROUP BY 1""",
    "rewrite_module_precedence": """WITH b AS (SELECT l_partkey AS s, l_returnflag AS p, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2)
        SELECT b.s, b.p, b.rank, min(l_suppkey) AS o, count(DISTINCT l_suppkey) > 1 AS conflict FROM b JOIN lineitem ON l_partkey = b.s AND l_returnflag = b.p AND l_linenumber = b.rank GROUP BY 1, 2, 3""",
}
