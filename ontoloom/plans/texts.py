"""Queries over quotes, texts and norm tuples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grounding, norms
from ..sources.tables import table

TEXT = "concat_ws(' ', coalesce(action, ''), coalesce(source_quote, ''), coalesce(array_to_string(conditions, ' '), ''))"


def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.CONTENT_STOP)
    cases = " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in T.SYNONYMS.items())
    stem = f"CASE {cases} ELSE regexp_replace(w, '^(.{{4,}}?)(?:{'|'.join(T.ENDINGS)})$', '\\1') END"
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({stop})), lambda w: {stem}))"


def kinds_sql() -> str:
    form = dict(T.PATHWAYS)["form"]
    party = "trim(regexp_replace(lower(trim(coalesce(counterparty, ''))), '^(the|a|an)\\s+', ''))"
    parts = [f"CASE WHEN regexp_matches(lower(txt), '{p}') THEN '{k}' END" for k, p in T.PATHWAYS if k != "form"]
    parts.append(f"CASE WHEN regexp_matches(lower(txt), '{form}') AND (lower(modality) = 'duty' OR regexp_matches(lower(coalesce(array_to_string(conditions, ' '), '')), '{form}')) THEN 'form' END")
    parts.append("CASE WHEN coalesce(deadline, '') <> '' THEN 'deadline' END")
    parts.append(f"CASE WHEN {party} NOT IN ({', '.join(repr(v) for v in T.VAGUE)}) THEN 'recipient' END")
    return f"list_sort(list_filter([{', '.join(parts)}], lambda k: k IS NOT NULL))"


NORMS = f"""n0 AS (SELECT DISTINCT *, {TEXT} AS txt FROM norm_tuples WHERE tuple_id IS NOT NULL),
n AS (SELECT tuple_id, corpus_id, lower(modality) AS modality, bearer_role, coalesce(external_reference, false) AS ext, {tokens_sql("coalesce(action, '')")} AS need, {tokens_sql("txt")} AS tokens,
    {tokens_sql("coalesce(counterparty, '')")} AS party, {tokens_sql("coalesce(bearer_role, '')")} AS actor, regexp_replace(regexp_replace(lower(trim(source_locator)), '\\(.*$', ''), '^[ .,;]+|[ .,;]+$', '', 'g') AS root, {kinds_sql()} AS kinds FROM n0),
p AS (SELECT c.tuple_id, unnest(CASE WHEN c.tuple_id = t.tuple_id THEN list_filter(t.kinds, lambda k: k NOT IN ('recipient', 'order')) ELSE t.kinds END) AS kind FROM n c JOIN n t ON t.corpus_id IS NOT DISTINCT FROM c.corpus_id
    WHERE c.modality IN ('power', 'permission') AND NOT c.ext AND (c.tuple_id = t.tuple_id OR (c.corpus_id IS NOT NULL AND len(c.need) > 0 AND len(list_intersect(c.need, t.tokens)) >= 0.5 * len(c.need))
        OR (c.corpus_id IS NOT NULL AND c.root <> '' AND c.root = t.root AND c.bearer_role <> '' AND (coalesce(c.bearer_role = t.bearer_role, false) OR (len(c.actor) > 0 AND len(list_intersect(c.actor, t.party)) = len(c.actor)))))),
k AS (SELECT tuple_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM p GROUP BY 1),
cap AS (SELECT n.tuple_id, n.corpus_id, coalesce(n.bearer_role, '') AS role, CASE WHEN ext THEN 'external' WHEN k.kinds IS NOT NULL THEN 'pathway_found' ELSE 'no_pathway' END AS verdict, k.kinds FROM n LEFT JOIN k USING (tuple_id) WHERE n.modality IN ('power', 'permission'))"""


def _quotes(spark, d):
    return table(spark, d, "claims").where("claim_key is not null").dropDuplicates(["claim_key"])


def _pairs(spark, d):
    """Claims with a quote, and the chunk their section names; JOIN-9 as an equi-join."""
    chunks = table(spark, d, "chunks").where("section is not null").groupBy("section").agg(F.min("text").alias("passage"))
    return _quotes(spark, d).where("source_quote is not null").join(chunks, "section").select(F.col("claim_key").alias("key"), F.col("source_quote").alias("quote"), "passage")


def _leaks(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lit("K-A1 of"), F.concat(F.lit("stratum "), F.substring("p_brand", -1, 1)), F.concat(F.lit("CT-"), F.col("p_size").cast("string")), F.lit("app.kernel.audit")).alias("t"))
    return rows.select(F.explode(T.leaks(F.col("t"))).alias("l")).groupBy("l.discloses", "l.matched").agg(F.count("*").alias("hits"))


def _celex(spark, d):
    """Citations written from order keys, in the four styles."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("see Regulation (EU) 20"), F.lpad((F.col("o_orderkey") % 25).cast("string"), 2, "0"), F.lit("/"), (F.col("o_orderkey") % 1000 + 1).cast("string"), F.lit(" on it"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Directive (EC) No 1999/"), (F.col("o_orderkey") % 90 + 1).cast("string"))).otherwise(F.concat(F.lit("under DIRECTIVE 93/"), (F.col("o_orderkey") % 50 + 10).cast("string"), F.lit("/EEC and so on"))).alias("t"))
    return rows.groupBy(T.celex(F.col("t")).alias("celex")).agg(F.count("*").alias("citations"))


def _norms(operator):
    return lambda spark, d: operator(table(spark, d, "norm_tuples"))


def _docs(operator):
    return lambda spark, d: operator(table(spark, d, "documents"))


QUERIES = {
    "lex_clause_kind": lambda spark, d: _quotes(spark, d).where("source_quote is not null").groupBy(T.clause_kind(F.col("source_quote")).alias("kind")).agg(F.count("*").alias("quotes")),
    "lex_modal_words": lambda spark, d: _quotes(spark, d).select(F.explode(T.modal_words(F.col("source_quote"))).alias("modal")).groupBy("modal").agg(F.count("*").alias("uses")),
    "lex_genre": _docs(lambda x: x.select("doc_id", T.genre(F.col("text")).alias("genre"))),
    "lex_celex": _celex,
    "lex_leaks": _leaks,
    "txt_sentences": _norms(lambda n: n.dropDuplicates(["tuple_id"]).select("tuple_id", F.size(T.sentences(F.coalesce("source_quote", F.lit("")))).alias("sentences"))),
    "mlc_coverage": _norms(norms.chain_coverage),
    "norm_capacities": _norms(norms.capacities),
    "norm_kd3_findings": _norms(norms.kd3),
    "ground_verbatim": lambda spark, d: grounding.ground_verbatim(_pairs(spark, d)),
    "ground_snapped": lambda spark, d: grounding.ground(_pairs(spark, d)),
    "ground_units": lambda spark, d: grounding.located(_pairs(spark, d)),
    "seg_chunks": _docs(lambda x: grounding.chunks(x, 1200, 100)),
    "seg_units": _docs(grounding.units),
    "seg_unit_chunks": _docs(lambda x: grounding.unit_chunks(x, 1200)),
    "seg_locator_asof": _docs(grounding.lines_with_heading),
}


def typography_sql(c: str) -> str:
    return f"trim(regexp_replace(translate({c}, '‘’‚‛“”„«»–—‑', '''''''''\"\"\"\"\"---'), '[\\s\\x{{00A0}}\\x{{2007}}\\x{{202F}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")


C = "c AS (SELECT DISTINCT * FROM claims WHERE claim_key IS NOT NULL)"
SQL = {
    "lex_clause_kind": f"WITH {C} SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(source_quote), '{p}') THEN '{k}'" for k, p in T.CLAUSE_KINDS) + " ELSE 'other' END AS kind, count(*) AS quotes FROM c WHERE source_quote IS NOT NULL GROUP BY 1",
    "lex_modal_words": f"WITH {C} SELECT unnest(regexp_extract_all(lower(source_quote), '{T.MODALS}')) AS modal, count(*) AS uses FROM c GROUP BY 1",
    "lex_celex": """WITH t AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '320' || lpad((o_orderkey % 25)::VARCHAR, 2, '0') || 'R' || lpad((o_orderkey % 1000 + 1)::VARCHAR, 4, '0') WHEN o_orderkey % 3 = 1 THEN '31999L' || lpad((o_orderkey % 90 + 1)::VARCHAR, 4, '0') ELSE '31993L' || lpad((o_orderkey % 50 + 10)::VARCHAR, 4, '0') END AS celex FROM orders) SELECT celex, count(*) AS citations FROM t GROUP BY 1""",
    "lex_leaks": """WITH t AS (SELECT unnest([['kernel primitive code', 'K-A1'], ['stratum letter', 'stratum ' || right(p_brand, 1)], ['classificatory type code', 'CT-' || p_size], ['dotted module path', 'app.kernel.audit']]) AS l FROM part)
        SELECT l[1] AS discloses, l[2] AS matched, count(*) AS hits FROM t WHERE l[1] <> 'stratum letter' OR regexp_matches(l[2], '[A-Da-d]$') GROUP BY 1, 2""",
    "txt_sentences": "WITH n AS (SELECT DISTINCT * FROM norm_tuples) SELECT tuple_id, (len(regexp_extract_all(coalesce(source_quote, ''), '[.!?]\\s+')) + 1)::INT AS sentences FROM n",
    "mlc_coverage": f"""WITH n0 AS (SELECT DISTINCT * FROM norm_tuples WHERE tuple_id IS NOT NULL), n AS (SELECT *, coalesce(source_quote, '') AS q, regexp_replace(coalesce(nullif(source_locator, ''), 'unknown'), '[/(].*$', '') AS article FROM n0), k AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{c}'" for c, p in T.CLAUSE_KINDS)} ELSE 'other' END AS clause FROM n),
        m AS (SELECT k.*, coalesce((SELECT bool_or(s.clause = 'condition') FROM k s WHERE s.corpus_id = k.corpus_id AND s.article = k.article), false) AS sc, coalesce((SELECT bool_or(s.clause = 'remedy' OR regexp_matches(s.q, '{norms.CHAIN_WORDS["remedy"]}')) FROM k s WHERE s.corpus_id = k.corpus_id), false) AS ar FROM k WHERE clause IN ('norm', 'conferral', 'remedy', 'time_limit')),
        u AS (SELECT unnest([{{'node': 'source', 'ok': corpus_id IS NOT NULL}}, {{'node': 'norm', 'ok': q <> ''}}, {{'node': 'addressee', 'ok': coalesce(bearer, '') <> ''}}, {{'node': 'position', 'ok': coalesce(lower(modality), 'none') NOT IN ('', 'none')}}, {{'node': 'conduct', 'ok': regexp_matches(q, '{norms.CHAIN_WORDS["conduct"]}')}},
            {{'node': 'condition', 'ok': sc OR regexp_matches(q, '{norms.CHAIN_WORDS["condition"]}')}}, {{'node': 'breach', 'ok': regexp_matches(q, '{norms.CHAIN_WORDS["breach"]}')}}, {{'node': 'remedy', 'ok': ar OR regexp_matches(q, '{norms.CHAIN_WORDS["remedy"]}')}}]) AS u FROM m)
        SELECT u.node AS node, count(*) FILTER (WHERE u.ok) AS present, count(*) FILTER (WHERE NOT u.ok) AS missing FROM u GROUP BY 1""",
    "norm_capacities": f"WITH {NORMS} SELECT * FROM cap",
    "norm_kd3_findings": f"WITH {NORMS} SELECT tuple_id, 'K-D3' AS code, CASE WHEN role <> '' THEN 0.8::DOUBLE ELSE 0.6 END AS confidence FROM cap WHERE verdict = 'no_pathway'",
    "ground_verbatim": f"WITH {C}, h AS (SELECT section, min(text) AS passage FROM chunks WHERE section IS NOT NULL GROUP BY 1) SELECT claim_key AS key, coalesce(source_quote <> '' AND instr({typography_sql('passage')}, {typography_sql('source_quote')}) > 0, false) AS found FROM c JOIN h USING (section) WHERE source_quote IS NOT NULL",
    "seg_locator_asof": """WITH s AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
        h AS (SELECT doc_id, i, nullif(regexp_extract(line, '^\\s*(?:Article|Section|Rule|Art\\.|§)\\s*(\\d+)', 1), '') AS head FROM u), w AS (SELECT doc_id, (i - 1)::INT AS line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading FROM h)
        SELECT doc_id, line_no, heading FROM w""",
}
