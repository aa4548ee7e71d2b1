"""Vectors of the operators that have no twin, or whose twin cannot show them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ontoloom.functions import text as T
from ontoloom.operators import audit, catalog, extraction, graph, grounding, lint, norms, rewrites, terms
from ontoloom.operators import triples as G
from ontoloom.sources import corpus, rdf

CLEAN = """@prefix : <https://onto.example/working#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix obo: <http://purl.obolibrary.org/obo/> .
obo:BFO_0000055 a owl:ObjectProperty .
:JudgeRole a owl:Class ; rdfs:subClassOf obo:BFO_0000023 ; owl:disjointWith :Trial ; obo:IAO_0000115 "A role of a judge."@en ; rdfs:label "Judge role" .
:Trial a owl:Class ; rdfs:subClassOf obo:BFO_0000015 , [ a owl:Restriction ; owl:onProperty obo:BFO_0000055 ; owl:someValuesFrom :JudgeRole ] ; obo:IAO_0000115 '''A process
of "trying".''' .
:Hearing a owl:Class ; rdfs:subClassOf :Trial ; obo:IAO_0000115 "A trial that is heard." ; :weight 3, 2.5, true . # a comment
"""
BROKEN = CLEAN + """:Trial obo:BFO_0000055 :JudgeRole . :Hearing rdfs:subClassOf obo:BFO_0000015 ; <https://onto.example/working#rdfs:subClassOf> :Trial .
<https://onto.example/working#ro:RO_0000052> a owl:Class . :Verdict a owl:Class ; rdfs:label "Verdict (reuse)" ; :definitionStatus "absent-in-source" .
"""
OWN = {"https://onto.example/working#": "working:"}


def read(spark, tmp_path, text):
    (tmp_path / "a.ttl").write_text(text)
    return rdf.read_turtle(spark, str(tmp_path / "a.ttl"), OWN)


def test_turtle_to_audit(spark, tmp_path):
    t = read(spark, tmp_path, CLEAN).cache()
    assert {(r.o, r.o_dt) for r in t.where("p = 'working:weight'").collect()} == {("3", "xsd:integer"), ("2.5", "xsd:decimal"), ("true", "xsd:boolean")}
    assert [tuple(r) for r in G.restrictions(t).collect()] == [("working:Trial", "obo:BFO_0000055", "some", "working:JudgeRole")]
    got = {r.metric: r.value for r in audit.metrics(t).collect()}
    assert got["visibility_ratio"] == 1.0 and got["local_disjointness"] == 1 and got["classes"] == 3 and got["definition_coverage"] == 1.0
    assert {got[m] for m in ("malformed_iris", "mangled_standard_predicates", "punned_triples", "meta_labels", "unanchored", "redundant_parents")} == {0}
    assert rdf.preview(t).first().classes == 3


def test_faults_are_found(spark, tmp_path):
    got = {r.metric: r.value for r in audit.metrics(read(spark, tmp_path, BROKEN)).collect()}
    assert all(got[m] >= 1 for m in ("malformed_iris", "mangled_standard_predicates", "punned_triples", "meta_labels", "redundant_parents")) and got["visibility_ratio"] == 0.5
    assert got["definition_coverage"] == 0.6 and got["definition_coverage_faithful"] == 0.8


def test_broken_turtle_and_xml_base(spark, tmp_path):
    assert read(spark, tmp_path, "<a> <b> .").where("s_kind = 'broken'").count() == 1
    (tmp_path / "b.owl").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x#" xml:base="http://b"><rdf:Description rdf:about="#A"><x:n rdf:datatype="http://www.w3.org/2001/XMLSchema#int">1</x:n></rdf:Description></rdf:RDF>')
    assert [(r.s, r.p, r.o, r.o_dt) for r in rdf.read_rdf_xml(spark, str(tmp_path / "b.owl")).collect()] == [("http://b#A", "http://x#n", "1", "xsd:int")]


def test_long_lists(spark):
    rows = [(f"c{i}", "rdf:first", f"m{i}", "iri") for i in range(100)] + [(f"c{i}", "rdf:rest", f"c{i + 1}" if i < 99 else "rdf:nil", "bnode" if i < 99 else "iri") for i in range(100)]
    got = {r.pos: r.member for r in rdf.list_members(spark.createDataFrame(rows, "s STRING, p STRING, o STRING, o_kind STRING")).where("head = 'c0'").collect()}
    assert got == {i: f"m{i}" for i in range(100)}


def test_equal_structures_get_equal_names(spark):
    def deep(tag):
        return [(f"A{tag}", "iri", "p", f"_:{tag}0", "bnode")] + [(f"_:{tag}{i}", "bnode", "q", f"_:{tag}{i + 1}", "bnode") for i in range(6)] + [(f"_:{tag}6", "bnode", "r", "end", "lit")]

    t = spark.createDataFrame(deep("x") + deep("y") + [("_:l", "bnode", "q", "_:l", "bnode")], "s STRING, s_kind STRING, p STRING, o STRING, o_kind STRING")
    out = G.canonical_bnodes(t)
    assert out.where("s_kind = 'bnode'").select("s").distinct().count() == 8 and out.count() == 2 + 7 + 1


def test_catalogue():
    clash = set(catalog.clash_rows())
    assert ("BFO_0000019", "BFO_0000016") in clash and ("BFO_0000034", "BFO_0000016") not in clash and ("BFO_0000015", "BFO_0000040") in clash
    assert len(catalog.UPPER) == 36 and all((b, a) in clash for a, b in clash)


E = "pid STRING, pos INT, label STRING, iri STRING, bfo_type STRING, parent_class STRING, kind STRING, is_new BOOLEAN, existing_iri STRING, definition STRING, definition_status STRING, source_span STRING, distinct_from STRING, locus STRING"
R = "pid STRING, pos INT, s STRING, p STRING, o STRING, quantifier STRING"


def proposal(spark, entities, relations=()):
    rows = [("p", i, *(e.get(c.split()[0]) for c in E.split(", ")[2:])) for i, e in enumerate(entities)]
    return spark.createDataFrame(rows, E), spark.createDataFrame([("p", i, *r, None) for i, r in enumerate(relations)], R)


def codes(df):
    return {r.code for r in df.collect()}


def test_gate_rules_on_known_faults(spark):
    new = {"kind": "class", "is_new": True, "bfo_type": "BFO_0000019"}
    e, r = proposal(
        spark,
        [new | {"label": "LossOfTenure", "iri": "w:LossOfTenure", "parent_class": "bfo:BFO_0000015"}, new | {"label": "Permit (reuse)", "iri": "w:Permit", "locus": "act"}, new | {"label": "A", "iri": "w:A", "bfo_type": None, "parent_class": "BFO_0000050"}, new | {"label": "Remedy", "iri": "w:Remedy"}, new | {"label": "Unspecified other", "iri": "w:X", "bfo_type": "BFO_0000023"}, new | {"label": "RoleRelation", "iri": "w:RoleRelation"}],
        [("w:A", "working:rdfs:subClassOf", "w:Permit"), ("w:A", "RO_0000052", "w:Permit"), ("w:A", "rdf:type", "not (bfo:BFO_0000196 some w:Permit)"), ("w:A", "rdfs:subClassOf", "the one that is held by the other one"), ("w:A", "includes", "w:P"), ("w:A", "excludes", "w:P"), ("w:B", "subClassOf", "w:Q"), ("w:C", "subClassOf", "w:Q"), ("w:Permit", "obo:RO_0000087", "w:X"), ("w:X", "RO_0000091", "w:X")],
    )
    assert codes(lint.naming(e)) == {"PC-1", "PC-2", "PC-17"} and codes(lint.typing(e, r)) == {"PC-3", "PC-5", "PC-6"}
    assert codes(lint.lexical(e, r)) >= {"PC-7", "PC-8", "PC-18"} and codes(lint.chain_rules(e)) == {"PC-9", "PC-10", "PC-12"} and codes(lint.source_rules(r)) == {"PC-11", "PC-13"}
    assert codes(lint.straddling(e)) == {"GS-1"} and codes(lint.bearing(r, e)) == {"GS-3"}
    assert lint.needs_reasoner(e, r, e).first().needed


def test_clean_proposals_pass(spark):
    e, r = proposal(spark, [{"label": "Judge", "iri": "w:Judge", "bfo_type": "BFO_0000023", "kind": "class", "is_new": True, "definition": "A role that judges.", "source_span": "x"}, {"label": "Court", "iri": "w:Court", "bfo_type": "BFO_0000030", "kind": "class", "is_new": True, "definition": "An object.", "source_span": "y"}], [("w:Judge", "bfo:BFO_0000197", "w:Court")])
    for part in (lint.naming(e), lint.typing(e, r), lint.lexical(e, r), lint.chain_rules(e), lint.source_rules(r), lint.defining(e, True), lint.straddling(e), lint.signed(r, e), lint.bearing(r, e)):
        assert part.count() == 0
    assert not lint.needs_reasoner(e, r, e).first().needed
    assert [tuple(x)[1:] for x in lint.scaffolds(e, spark.createDataFrame([("p", 0, "w:Judge", "BFO_0000054", "w:Trial", None)], R)).collect()] == [("Judge", "role", "BFO_0000054", "w:Trial")]
    assert lint.naming(e.limit(0)).count() == 0


@pytest.mark.parametrize("text,op", [("not w:A", "not"), ("owl:complementOf w:A", "not"), ("not (bfo:p some w:A)", "not_some"), ("bfo:p some w:A", "some"), ("_:x p A", "some"), ("A B", None), ("", None), (None, None)])
def test_expressions(spark, text, op):
    e = spark.createDataFrame([(text,)], "t STRING").select(lint.expression(F.col("t")).alias("e")).first().e
    assert (e and e["op"]) == op


def test_grounding_vectors():
    passage = "(3) Consent should be given by a clear affirmative act, such as a written statement. The controller shall keep a record."
    assert grounding.snap("given by a clear affirmative act", passage)[0] == "verbatim"
    status, text, ratio, begin, end = grounding.snap("Consent should be given by a clear act, such as a written statement", passage)
    assert status == "snapped" and text == passage[begin:end] and text.startswith("Consent") and ratio >= 0.85
    for quote in ("Consent must be unambiguous and informed at all times", "Consent should … written statement", "given by act", "written statement. The controller shall keep record of it", ""):
        assert grounding.snap(quote, passage)[0] == "unverified"
    assert grounding.sentence_at(passage, 30, 40).startswith("Consent should be given") and grounding.sentence_at(passage, 30, 40).endswith("statement.")


def test_segmentation_vectors():
    assert grounding.chunk_text("One a.\nTwo b.", 100) == ["One a.\nTwo b."] and grounding.chunk_text("") == []
    assert grounding.chunk_text("One a. Two b. " + "x" * 30, 16, 4)[0] == "One a. Two b."
    assert [u[0] for u in grounding.split_units("1. First.\n2. Second.\n(a) point")] == ["par_1", "par_2", "par_2/pnt_a"]
    assert [u[0] for u in grounding.split_units("(18)\nNatural persons.\nHAVE ADOPTED THIS REGULATION:\nArticle 4\nDefinitions\n1. For it:\n(7) controller means x")] == ["rec_18", "unknown", "art_4", "art_4/par_1", "art_4/par_1/pnt_7"]
    assert [u[0] for u in grounding.split_units("plain text")] == ["unknown"]
    text = "Preface\nArticle 1\n" + "a " * 30 + "\nArticle 2\nshort\n"
    cut = grounding.chunk_units(text, 50)
    assert "".join(c for c, _, _ in cut) == text and all(text[o : o + len(c)] == c and len(c) <= 50 for c, o, _ in cut) and cut[-1][2] in ("art_1", "art_2")
    assert grounding.locate("one two", [("a", "zero one"), ("b", "two three")]) == "a" and grounding.locate("nine", [("a", "x")]) is None
    assert grounding.trim_front("Contents\nRule 9\nRules\nRule 1 Scope")[0].startswith("Rule") and grounding.anchored_clauses("x\nI. A\none\n12\nII. B\ntwo", [("a", "^I\\."), ("b", "^II\\.")]) == [("a", "I. A one"), ("b", "II. B two")]
    with pytest.raises(ValueError):
        grounding.anchored_clauses("x", [("a", "^I\\.")])


def test_citations(spark):
    rows = [("Regulation (EU) 2016/679", "32016R0679"), ("under DIRECTIVE 93/13/EEC", "31993L0013"), ("Regulation No 1408/71/EEC", "31971R1408"), ("no act", None)]
    df = spark.createDataFrame(rows, "t STRING, c STRING")
    assert all(r.g == r.c for r in df.select(T.celex(F.col("t")).alias("g"), "c").collect())


def test_json_salvage():
    assert extraction.salvaged('x ```[{"a": 1}, {"b": 2}]```') == ([{"a": 1}, {"b": 2}], True)
    assert extraction.salvaged('[{"a": 1}, {"b": {"c": 2}}, {"d": ') == ([{"a": 1}, {"b": {"c": 2}}], False)
    assert extraction.salvaged("none") == ([], False) and extraction.salvaged("[" * 100000)[0] == []
    assert extraction.legacy_restriction("p some F") == ("p", "some", "F") and extraction.legacy_restriction("_:p_only_F") == ("p", "only", "F") and extraction.legacy_restriction(None) is None
    assert extraction.gate_passed("a >= 0.5", {"a": 0.5}) and not extraction.gate_passed("a < 0.5", {"a": 0.5})


def test_terms_by_rule(spark):
    docs = spark.createDataFrame([(i, "The revised inspection notice shall be sent. A written notice is kept.", 1) for i in range(3)] + [(9, None, 1)], "doc_id BIGINT, text STRING, uses INT")
    got = {r.term: r for r in extraction.terms(docs).collect()}
    assert got["revised inspection notice"].confidence == "high" and got["revised inspection notice"].rules == 3 and got["written notice"].rules == 0
    passages = spark.createDataFrame([("c1", "On fees", "a written notice is kept"), ("c2", "Written notices", "x")], "passage STRING, heading STRING, text STRING")
    assert [tuple(r) for r in extraction.provenance(spark.createDataFrame([("WrittenNotice",), ("Absent",)], "label STRING"), passages).collect()] == [("WrittenNotice", "c1", "label in text")]


def test_envelopes(spark):
    assert corpus.envelope_faults(None) and corpus.envelope_faults("[1]") == [("object", "is no object")]
    bad = json.dumps({"version": 2, "job": {}, "claims": [{"id": 1}, {"id": 1}, {"id": "x", "claim": "y" * 30000}]})
    assert {r for r, _ in corpus.envelope_faults(bad)} == {"version", "job", "claim", "id", "text"}


def test_scheduled_texts(spark, tmp_path):
    raw = b'<ECFR><DIV6 N="A"><DIV8 N="404.1"><HEAD>Scope.</HEAD><P>One  two.</P></DIV8></DIV6><DIV9 N="App"><HEAD>Listings</HEAD><P>lead</P><HD1>Part A</HD1><P>body</P></DIV9></ECFR>'
    (tmp_path / "a.xml").write_bytes(raw)
    (tmp_path / "b.xml").write_text("<x")
    got = {r.chunk_id: (r.subpart, r.heading, r.text, r.chars) for r in corpus.read_scheduled(spark, str(tmp_path)).collect()}
    assert got == {"404.1": ("A", "Scope.", "One two.", 8), "App#0": (None, "Listings", "lead", 4), "App#1": (None, "Part A", "body", 4)}
    one = corpus.read_corpus(spark, str(tmp_path / "b.xml"), lambda t: (t[1:], 1, len(t))).first()
    assert (one.text, one.start, one.prepared) == ("x", 1, True)


def test_delta_and_guards(spark):
    cols = "s STRING, s_kind STRING, p STRING, o STRING, o_kind STRING"
    t = spark.createDataFrame([("a", "iri", "rdfs:subClassOf", "b", "iri"), ("b", "iri", "rdfs:subClassOf", "c", "iri"), ("a", "iri", "owl:disjointWith", "c", "iri"), ("p", "iri", "rdf:type", "owl:ObjectProperty", "iri"), ("b", "iri", "rdfs:subClassOf", "p", "iri")], cols)
    plus, minus = t.limit(1), t.where("s = 'p'")
    after = rewrites.apply_delta(t, plus, minus)
    assert after.count() == 4 and rewrites.rollback(after, t, plus, minus).exceptAll(t).count() == 0
    assert {tuple(r) for r in rewrites.without_kin_disjointness(rewrites.without_property_parents(t)).select("s", "o").collect()} == {("a", "b"), ("b", "c"), ("p", "owl:ObjectProperty")}
    types = spark.createDataFrame([("x", "A", 1), ("x", "R", 2), ("y", "R", 1)], "s STRING, type STRING, rank INT")
    assert {tuple(r)[:2] for r in rewrites.collision_repair(types, spark.createDataFrame([("A", "R")], "a STRING, b STRING")).collect()} == {("x", "A"), ("y", "R")}
    moved = rewrites.reparented(t.where("o <> 'p'"), spark.createDataFrame([("b",)], "term STRING"))
    assert {(r.s, r.o) for r in moved.where("p = 'rdfs:subClassOf'").collect()} == {("a", "c")}


def test_surface_forms(spark):
    got = spark.createDataFrame([("WrittenNotice",)], "t STRING").select(terms.surface_forms(F.col("t")).alias("f")).first().f
    assert got == ["written notice", "written notices", "written", "writtens", "notice", "notices"]


def test_vector_clusters(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.05]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (2, [0.99, 0.05])]
    got = audit.vector_clusters(spark.createDataFrame(rows, "vec_id BIGINT, v ARRAY<DOUBLE>"), 0.92, 0.96).collect()
    assert {(r.vec_id, r.cluster, r.confidence) for r in got} == {(1, 1, "high"), (2, 1, "high")}

def test_capacities_meet_tuples_in_blocks(spark, monkeypatch):
    """Needs meet blocks of tuples: however blocks are cut the kinds are the same, and no
    pair of a need and a tuple becomes a row of a join."""
    rng = random.Random(5)
    words = "annotate seal record permit licence warrant exhibit notice order form motion".split()
    schema = "tuple_id STRING, corpus_id STRING, source_locator STRING, bearer_role STRING, modality STRING, action STRING, conditions ARRAY<STRING>, deadline STRING, counterparty STRING, source_quote STRING, external_reference BOOLEAN"
    rows = [
        (f"t{i:03}", rng.choice(["a", "a", "b", None]), rng.choice(["Rule 1(a)", "Rule 2", "", None]), rng.choice(["grantor", "the clerk", "", None]), rng.choice(["power", "Permission", "duty"]), rng.choice([" ".join(rng.sample(words, rng.randint(1, 7))), None, "of the"]),
         [], rng.choice([None, "3 days"]), rng.choice([None, "the clerk of records", "grantor", "anyone"]), rng.choice([None, " ".join(rng.sample(words, 3))]), rng.random() < 0.1)
        for i in range(160)
    ]
    table = spark.createDataFrame([*rows, rows[3]], schema)
    tuples = {r.tuple_id: r for r in norms.tuples(table).collect()}
    actor = {r.bearer_role: set(r.a) for r in table.select("bearer_role", norms.content_tokens(F.coalesce("bearer_role", F.lit(""))).alias("a")).collect()}
    want = {}
    for c in tuples.values():
        if c.modality not in norms.CAPACITIES:
            continue
        kinds = set()
        for t in tuples.values() if not c.external_reference else []:
            half = len(c.need) > 0 and 2 * len(set(c.need) & set(t.tokens)) >= len(c.need)
            place = bool(c.root and c.bearer_role) and c.root == t.root and (c.bearer_role == t.bearer_role or (actor[c.bearer_role] and actor[c.bearer_role] <= set(t.party)))
            if t.tuple_id == c.tuple_id:
                kinds |= {k for k in t.kinds if k not in ("recipient", "order")}
            elif c.corpus_id is not None and c.corpus_id == t.corpus_id and (half or place):
                kinds |= set(t.kinds)
        want[c.tuple_id] = ",".join(sorted(kinds)) or None
    assert any(v is None for v in want.values()) and len(set(want.values())) > 5
    for block in (8192, 7):
        monkeypatch.setattr(norms, "BLOCK", block)
        out = norms.capacities(table)
        assert {r.tuple_id: r.kinds for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(tokens" not in plan


def test_kd3_joins_no_tuple_with_a_need(spark):
    """The findings come from counts by need: no join of the plan carries token arrays."""
    schema = "tuple_id STRING, corpus_id STRING, source_locator STRING, bearer_role STRING, modality STRING, action STRING, conditions ARRAY<STRING>, deadline STRING, counterparty STRING, source_quote STRING, external_reference BOOLEAN"
    row = lambda i, role, quote, ext=False: (i, "a", "Rule 1", role, "power", "seal the record", [], None, None, quote, ext)
    table = spark.createDataFrame([row("t1", "grantor", None), row("t2", None, "x"), row("t3", "clerk", None, True)], schema)
    out = norms.kd3(table)
    assert {tuple(r) for r in out.collect()} == {("t1", "K-D3", 0.8), ("t2", "K-D3", 0.6)}
    assert "explode(tokens" not in out._jdf.queryExecution().optimizedPlan().toString()
    more = norms.kd3(table.unionAll(spark.createDataFrame([row("t4", "x", "seal a record by motion")], schema)))
    assert more.count() == 0


def test_metrics_are_sums_over_one_row_a_subject(spark, tmp_path):
    """No metric groups or joins the triples anew where a flag of the subject tells it, and
    the parents of a child are not joined with each other."""
    hub = CLEAN + "".join(f":Hub rdfs:subClassOf :P{i} . :P{i} a owl:Class . " for i in range(30)) + ":Hub a owl:Class . :P1 rdfs:subClassOf :P0 .\n"
    out = audit.metrics(read(spark, tmp_path, hub))
    got = {r.metric: r.value for r in out.collect()}
    assert got["redundant_parents"] == 1 and got["multi_parents"] == 1 and got["max_fan_out"] >= 1 and got["classes"] == 34
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 24, plan.count("Join ")


def test_metrics_close_no_cycle(spark, tmp_path, monkeypatch):
    """Classes that are all under each other are one component: their pairs are never made."""
    ring = CLEAN + "".join(f":R{i} rdfs:subClassOf :R{(i + 1) % 40} . :R{i} a owl:Class . " for i in range(40)) + ":R7 rdfs:subClassOf :Top . :Low rdfs:subClassOf :R3 , :R9 , :Top . :Low a owl:Class .\n"
    closed, whole = [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda edges: closed.append((out := whole(edges)).count()) or out)
    got = {r.metric: r.value for r in audit.metrics(read(spark, tmp_path, ring)).collect()}
    assert got["redundant_parents"] == 4 and got["multi_parents"] == 2 and got["unanchored"] == 41  # R7's Top, and all three of Low
    assert closed and sum(closed) < 100


def test_condensed_as_closure(spark):
    """Cycles within and beside each other, loops, and parents implied inside and outside."""
    pairs = "a-b b-c c-a c-d d-e e-f f-d a-d a-e a-a x-a x-d x-b y-d y-y y-z w-z w-w obo:p-obo:q obo:q-obo:p e-obo:p v-obo:p v-obo:q u-v u-obo:q k-l l-m m-n k-n k-m k-o".split()
    edges = spark.createDataFrame([tuple(p.split("-")) for p in pairs] + [("a", None), (None, "a"), ("a", "b")], "child STRING, parent STRING")
    rows, full = graph.condensed(edges), graph.closure(edges)
    reach = graph.condensed_reach(rows)
    names = {}
    for r in rows.collect():
        names.setdefault(r.lower, set()).add(r.child)
    assert sorted("".join(sorted(n)) for n in names.values() if len(n) > 1) == ["abc", "def", "obo:pobo:q"]
    assert sorted(map(tuple, graph.condensed_redundant(rows, reach).collect())) == sorted(map(tuple, graph.redundant_parents(edges, full).collect()))
    assert {r.child for r in graph.condensed_under(rows, reach, "obo:").collect()} == {r.node for r in full.where("ancestor like 'obo:%'").collect()}


def test_capacities_write_narrow_tables(spark, monkeypatch):
    """What capacities write and shuffle holds no text and no words that nothing compares,
    and what was written on the way is deleted."""
    schema = "tuple_id STRING, corpus_id STRING, source_locator STRING, bearer_role STRING, modality STRING, action STRING, conditions ARRAY<STRING>, deadline STRING, counterparty STRING, source_quote STRING, external_reference BOOLEAN"
    row = lambda i, modality, deadline: (i, "a", "Rule 1", "clerk", modality, "seal the record", [], deadline, None, "kept", False)
    table = spark.createDataFrame([row("t1", "power", None), row("t2", "duty", "3 days"), row("t3", "duty", None)], schema)
    packed = {r.tuple_id: r for r in norms._packed(table.unionAll(table)).collect()}
    assert len(packed) == 3 and not {"action", "source_quote"} & set(packed["t1"].asDict())
    assert [(r.need is None, r.tokens is None) for _, r in sorted(packed.items())] == [(False, True), (True, False), (True, True)]
    made, settled = [], norms.settled
    monkeypatch.setattr(norms, "settled", lambda build: made.append(settled(build)) or made[-1])
    assert {(r.tuple_id, r.kinds) for r in norms.capacities(table).collect()} == {("t1", "deadline")}
    assert len(made) == 2 and not [n for n, kind in made[0].dtypes if kind.startswith("array")]
