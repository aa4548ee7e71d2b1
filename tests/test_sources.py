import json

from pyspark.sql import functions as F

from ontoloom.operators import triples as G
from ontoloom.sources import rdf
from ontoloom.streaming import live

DOC = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:lang="en">
<owl:Class rdf:about="http://x#Trial"><rdfs:label>Trial</rdfs:label><rdfs:subClassOf rdf:resource="http://x#Process"/>
<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x#has"/><owl:someValuesFrom rdf:resource="http://x#Judge"/></owl:Restriction></rdfs:subClassOf></owl:Class>
<owl:AllDisjointClasses><owl:members rdf:parseType="Collection"><rdf:Description rdf:about="http://x#A"/><rdf:Description rdf:about="http://x#B"/><rdf:Description rdf:about="http://x#C"/></owl:members></owl:AllDisjointClasses>
</rdf:RDF>"""


def test_rdf_xml(spark, tmp_path):
    (tmp_path / "a.owl").write_text(DOC)
    (tmp_path / "b.owl").write_text("<broken")
    t = rdf.read_rdf_xml(spark, str(tmp_path)).cache()
    assert t.where("s_kind = 'broken'").count() == 1
    assert {(r.s, r.o, r.o_lang) for r in t.where("p like '%label'").collect()} == {("http://x#Trial", "Trial", "en")}
    assert t.where("p like '%subClassOf' and o_kind = 'bnode'").count() == 1
    members = {r.pos: r.member for r in rdf.list_members(t).collect()}
    assert members == {0: "http://x#A", 1: "http://x#B", 2: "http://x#C"}
    group = rdf.list_members(t).select(F.col("head").alias("group"), F.col("member").alias("class"))
    assert G.disjoint_pairs(t, group).count() == 3


def test_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://a> <http://p> "v \\"q\\""@en .\n_:b <http://p> <http://c> .\nnonsense\n')
    got = {(r.s, r.s_kind, r.o, r.o_kind, r.o_lang) for r in rdf.read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    assert got == {("http://a", "iri", 'v \\"q\\"', "lit", "en"), ("_:b", "bnode", "http://c", "iri", None)}


def test_markup(spark):
    html = "<html><head><style>x{}</style></head><body><p>One&amp;two</p><script>no()</script><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    assert rdf.markup_text(html) == "One&two\n\na b" and rdf.markup_text("plain & text") == "plain & text" and rdf.markup_text(None) is None
    assert rdf.markup_text("<act><title>T</title><p>body") and rdf.markup_text("<akn><num>1</num><p>x</p></akn>") == "1\nx"
    raw = spark.createDataFrame([(1, html), (2, "<akomaNtoso/>"), (3, "text"), (4, None)], "id BIGINT, raw STRING")
    assert [r[0] for r in raw.orderBy("id").select(rdf.markup_format(F.col("raw"))).collect()] == ["xhtml", "akn", "text", "text"]
    assert rdf.to_text(raw).count() == 4


def test_csv_and_logs(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Adjudicator,x,Rate\nj1,1, 45%\nj2,2,none\n")
    assert [tuple(r) for r in rdf.read_rates(spark, str(tmp_path / "r.csv"), ["judge", "adjudicator"], ["rate"]).collect()] == [("j1", 45.0)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbad line\n{"a": 2}\n')
    assert rdf.read_log(spark, str(tmp_path / "l.jsonl"), "a INT").count() == 2


def test_streams_resume_and_match_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rows = [{"event_id": i, "ts": f"2026-01-01T0{i % 3}:00:00", "session_id": f"s{i % 2}", "event_type": "commit" if i % 2 else "propose", "payload": json.dumps({"proposal_id": f"p{i // 4}", "committed": True} if i % 2 else {"proposal": {"proposal_id": f"p{i // 4}", "reasoner_verdict": "inconsistent"}})} for i in range(12)]
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in rows[:6]) + "\nbad\n")
    run = lambda: live.run_once(live.counters(live.tail(spark, str(folder))), str(tmp_path / "cp"), name="counts")
    run()
    assert spark.table("counts").selectExpr("sum(events)").first()[0] == 6
    (folder / "2.json").write_text("\n".join(json.dumps(r) for r in rows[4:]))
    run()
    assert spark.table("counts").selectExpr("sum(events)").first()[0] == 12
    live.run_once(live.claim_states(live.tail(spark, str(folder))), str(tmp_path / "cp2"), name="states")
    batch = live.claim_states(spark.read.schema(live.SCHEMA).json(str(folder)).where("event_id is not null"))
    assert {tuple(r) for r in spark.table("states").collect()} == {tuple(r) for r in batch.collect()}
    assert live.checkpoints(spark.read.schema(live.SCHEMA).json(str(folder)), 2).count() >= 2
