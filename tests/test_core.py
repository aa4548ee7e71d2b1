import json

import pytest
from pyspark.sql import functions as F

from ontoloom.functions import text as T
from ontoloom.operators import drift, graph, grounding, logs, measures, nested
from ontoloom.operators import triples as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child STRING, parent STRING")


def test_closure_is_exact_on_cycles(spark):
    reach = graph.closure(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", None), ("a", "b")]))
    got = {(r.node, r.ancestor): r.depth for r in reach.collect()}
    assert got[("a", "a")] == 3 and got[("d", "c")] == 3 and len(got) == 12
    assert {r.node for r in graph.cyclic_nodes(reach).collect()} == {"a", "b", "c"}
    assert {r.component for r in graph.cycle_components(reach).collect()} == {"a"}
    assert graph.closure(edges(spark, [("a", "b")]).limit(0)).count() == 0


def test_redundant_parents_and_straddles(spark):
    e = edges(spark, [("Court", "Institution"), ("Institution", "object"), ("Court", "object"), ("Trial", "process"), ("Court", "process")])
    reach = graph.closure(e)
    assert [tuple(r) for r in graph.redundant_parents(e, reach).collect()] == [("Court", "object")]
    pairs = spark.createDataFrame([("process", "object")], "a STRING, b STRING")
    assert [tuple(r) for r in graph.straddles(reach, pairs).collect()] == [("Court", "object", "process")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "src BIGINT, dst BIGINT")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63


def test_proposals_keep_places(spark):
    proposal = {"proposal_id": "p", "entities": [None, {"label": "A", "possible_relations": ["x", None, '{"s": 1}']}, '{"label": "B"}'], "relations": {"s": "a"}, "open_questions": "why?"}
    rows = [(1, "propose", json.dumps({"proposal": proposal})), (1, "propose", json.dumps({"proposal": proposal})), (2, "propose", json.dumps({"proposal": json.dumps(proposal)})), (7, "propose", json.dumps(json.dumps({"proposal": proposal}))), (3, "propose", "{bad"), (4, "propose", None), (5, "query", "{}"), (6, "propose", '{"proposal": null}')]
    log = spark.createDataFrame([(*r, 0) for r in rows], "event_id BIGINT, event_type STRING, payload STRING, pos INT")
    want = {("entities", 1, -1), ("entities", 2, -1), ("possible_relations", 1, 0), ("possible_relations", 1, 2), ("relations", 0, -1), ("open_questions", 0, -1)}
    got = {(r.event_id, r.child, r.pos, r.sub_pos) for r in nested.bridge(log).where("child <> 'proposals'").collect()}
    assert got == {(e, *w) for e in (1, 2, 7) for w in want}
    stored = nested.objects(log)
    assert stored.count() == 7 and {r.places for r in stored.collect()} == {3}
    assert nested.identity({"a": 1, "b": [1]}) == nested.identity({"b": "[1]", "a": 1}) != nested.identity({"a": 1, "b": [2]})
    assert nested.flat(log, "open_questions").first().question == "why?"
    assert nested.bridge(log.limit(0)).count() == 0


def test_several_proposals_and_deep_objects(spark):
    entity = {"label": "A", "evidence": [{"page": 1}, None, {"page": 1}], "possible_relations": [{"s": 1}]}
    body = {"proposal": [{"proposal_id": "p", "entities": [entity]}, None, {"proposal_id": "q", "entities": [entity, 7]}]}
    deep = "[" * 100000
    log = spark.createDataFrame([(1, "propose", json.dumps(body)), (1, "propose", json.dumps(body)), (2, "propose", deep), (None, "propose", json.dumps(body))], "event_id BIGINT, event_type STRING, payload STRING")
    rows = nested.bridge(log).collect()
    by_path = {r.path: r for r in rows}
    assert len(by_path) == len(rows) == 2 + 3 + 4 + 2
    assert all(r.parent_path == "" or by_path[r.parent_path].node == r.parent for r in rows)
    assert {(r.proposal_pos, r.pos) for r in rows if r.child == "entities"} == {(0, 0), (2, 0), (2, 1)}
    assert {(r.path, r.proposal_pos) for r in rows if r.child == "entities.evidence"} == {(f"proposal[{p}].entities[0].evidence[{i}]", p) for p in (0, 2) for i in (0, 2)}
    stored = {r.content: r for r in nested.objects(log).collect()}
    assert stored['{"page": 1}'].places == 4 and len([c for c in stored if '"$node"' in c]) == 1
    assert {tuple(r) for r in nested.children(log).collect()} == {(1, "entities", 0, -1), (1, "entities", 1, -1), (1, "possible_relations", 0, 0)}
    assert [r.rest for r in nested.flat(log, "entities").where("pos = 1").collect()] == ["7"]


def test_unified_keeps_every_value(spark):
    big = 9007199254740993
    jobs = [{"n": 1, "b": True, "x": 1, "y": big, "z": 2**70}, {"n": "three", "b": 0, "x": 1.5, "y": 0.5, "z": 1}, {"n": [1], "b": None, "x": 2, "y": 1, "z": 1}]
    rows = [("s", 1, json.dumps({"job_id": f"j{i}", "big": big, **j}), 0) for i, j in enumerate(jobs)]
    got = {r.job_job_id: r for r in drift.unified(spark.createDataFrame(rows + rows[:1], "stream STRING, file_no INT, record STRING, types INT")).collect()}
    assert [got[f"j{i}"].job_n for i in range(3)] == ["1", "three", "[1]"] and [got[f"j{i}"].job_b for i in range(3)] == ["true", "0", None]
    assert [got[f"j{i}"].job_x for i in range(3)] == [1.0, 1.5, 2.0] and {r.job_big for r in got.values()} == {big}
    assert got["j0"].job_y == str(big) and got["j0"].job_z == str(2**70)


def test_long_rename_chains(spark):
    rows = [("s", i + 1, "job", f"f{i}", f"f{i + 1}") for i in range(1, 80)] + [("t", 2, "job", "a", "b"), ("t", 3, "job", "b", "a")]
    got = {(r.stream, r.since, r.field): r["first"] for r in drift.first_names(spark.createDataFrame(rows, "stream STRING, file_no INT, level STRING, field STRING, new_field STRING")).collect()}
    assert got["s", 80, "f80"] == "f1" and got["t", 3, "a"] == "a" and len(got) == 81


def test_drift(spark):
    def job(i, **more):
        claims = [{"id": 0, "claim": "c", "source_quote": f"q{i}", "proposal": {"proposal_id": "p", "gate_outcome": "ok"}}]
        return {"job_id": f"j{i}", "name": f"n{i}", "status": f"s{i}", "claims": claims} | more

    def renamed(i):
        j = job(i, state=f"s{i}")
        del j["status"]
        j["claims"] = json.dumps(j["claims"] and [{**j["claims"][0], "id": "0", "new": None}])
        return j

    files = {1: [job(1), job(2)], 3: [renamed(2), renamed(3)], 4: [{**renamed(3), "claims": {"0": {"id": "0", "claim": "c", "source_quote": {"text": "q"}, "new": 1, "proposal": {"proposal_id": "p"}}}}]}
    rows = [("s", f, n, json.dumps(j)) for f, jobs in files.items() for n, j in enumerate(jobs)] + [("s", 1, 9, '{"cut'), ("s", 3, 0, json.dumps(renamed(2))), ("t", 1, 0, "[]"), (None, 1, 0, "{}")]
    exports = spark.createDataFrame([(*r, "z") for r in rows], "stream STRING, file_no INT, line_no INT, record STRING, level STRING")
    got = {tuple(r) for r in drift.drift(exports)[1].collect()}
    assert got == {
        ("s", 3, "job", "status", "renamed"), ("s", 3, "job", "claims", "retyped"), ("s", 3, "claim", "id", "retyped"), ("s", 3, "claim", "new", "added"),
        ("s", 4, "job", "claims", "retyped"), ("s", 4, "claim", "source_quote", "retyped"), ("s", 4, "proposal", "gate_outcome", "removed"),
    }
    table = drift.unified(exports)
    assert table.count() == 5 and "job_state" not in table.columns and table.where("job_status is not null").count() == 5
    assert drift.drift(exports.limit(0))[1].count() == 0


def test_promotion_lattice():
    assert drift.promote({"number"}) == "DOUBLE" and drift.promote({"number", "string"}) == "STRING" and drift.promote({"array"}) == "STRING" and drift.promote({"boolean"}) == "BOOLEAN"


def test_label_keys(spark):
    row = spark.createDataFrame([("LegalPersonalityRole (reuse)", "The act of a Tax-Authority")], "a STRING, b STRING").select(
        T.label_key(F.col("a")).alias("k"), T.word_bag(F.lit("ActOfCourtsActABC")).alias("bag"), T.name_stem(F.lit("EmpathyProcess")).alias("stem"), T.name_stem(F.lit("Act")).alias("none"), T.reservation_key(F.lit("Empathy  Deficits consciousness")).alias("r"),
        T.term_key(F.lit("Remedies")).alias("t"), T.rule_root(F.lit("Rule 27(a)(1)")).alias("root"), T.celex(F.lit("Regulation (EU) 2016/679 on")).alias("celex"), T.clause_kind(F.lit("It means any act")).alias("kind"), T.content_hash(F.lit(" a "), F.lit(None).cast("string")).alias("h"),
    ).first()
    assert (row.k, row.bag, row.stem, row.none, row.r, row.t, row.root, row.celex, row.kind) == ("personality", "abc act act courts", "empathy", None, "empathy deficit consciousness", "remedy", "Rule 27", "32016R0679", "definition")
    assert len(row.h) == 10


def test_wilson_vectors(spark):
    low, high = T.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(3, 60), (2, 2), (1, 3), (0, 0)], "k INT, n INT").select(F.round(low, 2), F.round(high, 2)).collect()
    assert [tuple(r) for r in rows] == [(0.02, 0.14), (0.34, 1.0), (0.06, 0.79), (None, None)]


def test_percentiles_round_half_to_even(spark):
    t = spark.createDataFrame([(i, 1, "propose", float(v)) for i, v in enumerate([100, 200, 300, 400, 200])], "seq BIGINT, run BIGINT, phase STRING, ms DOUBLE")
    assert measures.percentiles(t, 50, 95).first()[1:] == (200.0, 400.0)


def test_dispersion_gates(spark):
    smear = spark.createDataFrame([(l, c) for l in range(7) for c in range(10)], "locus INT, class INT")
    clean = spark.createDataFrame([(c % 7, c) for c in range(70)], "locus INT, class INT")
    assert not any(r.passed for r in measures.gates(smear).collect()) and all(r.passed for r in measures.gates(clean).collect())


def test_grounding_vectors():
    passage = "Consent should be given by a clear affirmative act establishing a freely given, specific indication. It must be asked for in plain words."
    assert grounding.snap("a clear  affirmative act", passage)[0] == "verbatim"
    status, text, ratio, _, _ = grounding.snap("Consent should be given by clear affirmative act establishing a freely given", passage)
    assert status == "snapped" and text.startswith("Consent should be given by a clear") and ratio >= 0.85
    for bad in ("", "...", "Consent ... act", "agreement needs words", "specific indication. It must be asked for in plain sentences"):
        assert grounding.snap(bad, passage)[0] == "unverified"


def test_segmentation():
    text = "(1) Whereas one.\n\nHAVE ADOPTED THIS\nArticle 4\nDefinitions\n1. First rule:\n(a) a point;\n(b) another.\n2. Second rule.\nArticle 5\nScope.\n"
    assert [u[0] for u in grounding.split_units(text)] == ["rec_1", "unknown", "art_4", "art_4/par_1", "art_4/par_1/pnt_a", "art_4/par_1/pnt_b", "art_4/par_2", "art_5"]
    assert grounding.split_units("no structure at all")[0][0] == "unknown" and grounding.split_units("") == []
    body = "\n\n".join(f"Paragraph {i}. " + "word " * 30 for i in range(40))
    chunks = grounding.chunk_text(body, 500, 50)
    assert max(map(len, chunks)) <= 500 and all(f"Paragraph {i}." in "".join(chunks) for i in range(40)) and grounding.chunk_text("") == []
    assert max(map(len, grounding.chunk_text("x" * 3000, 500, 50))) <= 500


def test_hash_chain(spark):
    log = spark.createDataFrame([("f", i, f"line {i}") for i in range(5)] + [("g", 1, "a")], "file STRING, line_no INT, line STRING")
    chained = logs.chained(log)
    assert all(r.first_break is None for r in logs.chain_breaks(chained).collect())
    broken = {r.file: r.first_break for r in logs.chain_breaks(chained.where("not (file = 'f' and line_no = 2)")).collect()}
    assert broken == {"f": 3, "g": None}


def test_debt_rules(spark):
    rows = [("A", "defect", 2.0, "L1", s, "source", "x y z") for s in range(4)] + [("B", "defect", 2.0, "L1", s, "source", "d") for s in range(8)] + [("C", "coverage", 9.0, "L1", 1, "source", "d"), ("D", "defect", 5.0, "L1", 1, "translation", "d")]
    f = spark.createDataFrame(rows, "code STRING, kind STRING, weight DOUBLE, locus STRING, subject INT, attribution STRING, detail STRING")
    registry = spark.createDataFrame([("A", "defect", 2.0), ("B", "defect", 2.0), ("C", "coverage", 9.0), ("D", "defect", 5.0)], "code STRING, kind STRING, weight DOUBLE")
    got = {r.code: (r.saturated, r.debt, r.translation) for r in measures.debt(f, registry, 10).collect()}
    assert got == {"A": (False, 8.0, 0), "B": (True, 0.0, 0), "C": (False, 0.0, 0), "D": (False, 0.0, 1)}
    more = {r.code: (r.findings, r.undetermined) for r in measures.debt(f, registry, 10, spark.createDataFrame([("A", 5)], "code STRING, total BIGINT")).collect()}
    assert more["A"] == (5, 1)
    with pytest.raises(Exception, match="unknown code B"):
        measures.debt(f, registry.where("code <> 'B'"), 10).collect()


def test_bnodes_and_malformed(spark):
    t = spark.createDataFrame([("_:a", "bnode", "p", "x", "lit", None, "s"), ("_:b", "bnode", "q", "_:a", "bnode", None, "s"), ("c", "iri", "r", "_:k", "bnode", None, "s"), ("_:k", "bnode", "p", "x", "lit", None, "s")], "s STRING, s_kind STRING, p STRING, o STRING, o_kind STRING, o_lang STRING, source STRING")
    assert {r.s for r in G.orphan_bnodes(t).collect()} == {"c", "_:k"}
    swapped = t.replace({"_:k": "_:other"})
    one, two = (sorted(tuple(r) for r in G.canonical_bnodes(x.where("s in ('c', '_:k', '_:other')")).collect()) for x in (t, swapped))
    assert one == two
    names = spark.createDataFrame([("http://x/working#rdfs:subClassOf",), ("http://x/a b",), ("http://x/working#BFO_0000015",), ("http://x/working#Fine",)], "iri STRING")
    assert {r.kind for r in G.malformed(names).collect()} == {"curie_in_fragment", "illegal_character", "upper_id_in_local_namespace"}


def test_flat_keeps_every_field(spark):
    entity = {"label": "a", "definition_status": "draft", "distinct_from": "b", "illustrative": True, "odd": [1]}
    body = {"proposal": {"entities": [entity, "bare"], "relations": ["loose", {"s": "x", "extra": 2}]}}
    log = spark.createDataFrame([(1, "propose", json.dumps(body))], "event_id BIGINT, event_type STRING, payload STRING")
    one, two = nested.flat(log, "entities").orderBy("pos").collect()
    assert (one.label, one.definition_status, one.distinct_from, one.illustrative, json.loads(one.rest)) == ("a", "draft", "b", "true", {"odd": [1]})
    assert two.label is None and json.loads(two.rest) == "bare"
    assert [json.loads(r.rest) for r in nested.flat(log, "relations").orderBy("pos").collect()] == ["loose", {"extra": 2}]
