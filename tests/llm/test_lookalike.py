import pytest

from ontoloom.llm import lookalike as L

SAME = [
    ("court", "cоurt"), ("court", "ｃｏｕｒｔ"), ("office", "oﬃce"), ("a b", "a b"), ("a b", "a　b"), ("court", "co​urt"), ("café", "café"), ("мястото", "мястотo"), ("Artісlе 7", "Article 7"),
    ("Κανένας", "Kανένας"), ("a\nb", "a\r\nb"), ("well-known", "well‑known"), ("na­me", "name"), ("𝐂ourt", "Court"), ("ᎪᏟT", "ACT"), ("ᴄlause", "clause"), ("ёж", "ёж"),
]
OTHER = [("court", "Court"), ("resume", "résumé"), ("a b", "a  b"), ("a b", "a\nb"), ("1", "l"), ("0", "O"), ("I", "l"), ("rn", "m"), ("½", "1⁄2"), ("𝔄𝔠𝔱", "Act"), ("a.", "a;")]


@pytest.fixture(scope="module")
def own(spark):
    return L.Spelling(L.confusables(spark))


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(own, a, b):
    assert own.form(a) == own.form(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(own, a, b):
    assert own.form(a) != own.form(b)


def test_spelling_is_in_one_script(own):
    assert own.form("cоurt") == "court"
    assert own.form("мястотo") == "мястото"
    assert own.form("Kανένας") == "Κανένας"
    assert own.form("договор а") == "договор а" and own.form("the а of it") == "the a of it"
    assert own.form("σοφός ο νόμος") == "σοφός ο νόμος"
    assert own.form(None) is None and own.form("") == ""


def test_script_sets(own):
    assert own.shared("court") == {"LATIN"} and own.shared("СОР") > {"LATIN", "CYRILLIC"} and own.shared("прaво") == {"CYRILLIC"} and not own.shared("жz")
    assert own.report("the court of СОР and cоurt") == ("LATIN", 1, 1)
    assert own.report("прaво на договор") == ("CYRILLIC", 1, 0)
    assert own.form("жzо") == "жzo"
    assert len(own.alike) > 200 and {"Ꭺ", "ꓐ", "Ⲟ", "ᴄ"} <= set(own.alike) and not {"ı", "σ", "α"[:0]} & set(own.alike)


@pytest.mark.parametrize("text", [a for pair in SAME + OTHER for a in pair])
def test_forms_are_stable(own, text):
    assert own.form(own.form(text)) == own.form(text)


def test_pairs(spark):
    rows = [(1, "cоurt"), (2, "court"), (3, "court"), (4, "Court"), (5, "​"), (6, "  "), (7, None), (8, ""), (9, "x" * 50_000), (10, "х" + "x" * 49_999), (2, "court")]
    docs = spark.createDataFrame([(*r, "f", b"k") for r in rows], "doc_id BIGINT, text STRING, form STRING, exact BINARY")
    assert {tuple(r) for r in L.same_look(docs).collect()} == {(1, 2), (1, 3), (9, 10)}
    assert L.same_look(docs.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in L.forms(docs).collect()}[7] is None
    assert {(r.doc_id, r.group_id, r.texts) for r in L.look_groups(docs).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 1), (9, 9, 2), (10, 9, 2)}
    assert {(r.doc_id, r.mixed_tokens) for r in L.script_report(docs).where("mixed_tokens > 0").distinct().collect()} == {(1, 1), (10, 1)}
