import json

import pytest

from ontoloom.llm import pairs

Q = "Who may decide on liability before the Teistsox Standards Office?"
A = "It is the delegate who settles liability for Teistsox, and the settlement is recorded as a process."


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, " \n\t", "empty"), (Q, "​", "empty"), (Q, "N/A", "empty"), (Q, "(no answer)", "empty"), (Q, "[empty]", "empty"), (Q, "...", "empty"), (Q, [], "empty"), (Q, {}, "empty"),
        (Q, Q, "copied_question"), (Q, Q.rstrip("?") + ".", "copied_question"), (Q, f"You asked: «{Q}»", "copied_question"), (Q, f"{Q}\n{Q}", "copied_question"), (Q, Q.lower(), "copied_question"), (Q, Q.replace("may", "then may"), "copied_question"),
        (Q, "I'm sorry, but I must decline to comment on liability. Please consult a qualified expert.", "refusal"), (Q, "The working ontology does not contain enough information to answer.", "refusal"),
        ("Wann endet die Haftung der Behörde in Prag?", "Leider kann ich diese Frage nicht beantworten.", "refusal"), ("Qui décide de la créance à Metz ?", "Désolé, je ne peux pas répondre à cette question.", "refusal"),
        (Q, "La responsabilité de Teistsox relève du rôle, car elle n'existe que par le vérificateur.", "other_language"), (Q, "Η υποχρέωση του γραφείου εξαρτάται από το μητρώο.", "other_language"),
        (Q, A[:60], "truncated"), (Q, A[:70] + "…", "truncated"), (Q, "It is linked to three classes: (1) ActRole (BFO_0000023); (2) RuleAct (BFO_0000015)", "truncated"), (Q, "The office (under the", "truncated"), (Q, "See the code:\n```\nx = 1", "truncated"), (Q, "It rests on two: (1) the act; (2)", "truncated"),
        (Q, "<ul><li>One.</li>", "truncated"), (Q, 'He wrote: "It is so.', "truncated"), (Q, "It is held (as the act says.", "truncated"), (Q, "<p>It is held.</p>", None), (Q, 'He wrote: "It is so."', None),
        (Q, " ".join([Q] * 5), "copied_question"), (Q, "the " * 5000, "truncated"),
        (Q, A, None), (Q, f"{Q} {A}", None), (Q, "LiabilityProcess (BFO_0000015)", None), (Q, "- ActRole\n- RuleAct", None), (Q, "It is linked to three classes: (1) ActRole (BFO_0000023); (2) RuleAct (BFO_0000015); (3) OwnerRole (BFO_0000023)", None),
        (Q, "The ontology does not state an exact date, but it does record that the reliance ends.", None), (Q, "No. Teistsox does not lose its liability merely because the officer declined to comment.", None), (Q, "The phrase 'ultra vires' is used here: the registration binds the interpreter.", None),
        (Q, A + " See https://onto.example/working#Act", None), (Q, 5, None), (None, A, None), (Q, A * 3000, None),
    ],
)
def test_classify(question, answer, defect):
    assert pairs.classify(question, answer) == defect


def test_tiles_take_the_longest_run_first():
    a, b = pairs.tiles("a b c d x".split(), "x a b c d".split())
    assert a == [True] * 4 + [False] and b == [False] + [True] * 4


def test_the_parser_decides_on_truncation(monkeypatch):
    monkeypatch.setattr(pairs.Pushdown, "left", lambda self: "")
    assert pairs.classify(Q, A[:60]) is None


@pytest.mark.parametrize("text,left", [("It is (so", "("), ("```\nx.", "```"), ("<b>x.", "<b>"), ("It is so", "sentence"), ("It is so,", "clause"), ("There are two parts: (1) a. (2) b.", ""), ("See sec.", "clause"), ("«It is.»", ""), ("It is. [a]", "")])
def test_what_is_left_open(text, left):
    assert pairs.Pushdown(text).left() == left


def test_query_counts_repeats_once_and_skips_invalid(spark):
    rows = [(1, "query", json.dumps({"question": Q, "answer": None})), (1, "query", json.dumps({"question": Q, "answer": None})), (2, "query", "{bad"), (3, "query", None), (4, "query", "[1]"), (5, "propose", "{}"), (None, "query", "{}"), (6, "query", json.dumps({"question": Q, "answer": A}))]
    log = spark.createDataFrame([(*r, "x") for r in rows], "event_id BIGINT, event_type STRING, payload STRING, defect STRING")
    assert [tuple(r) for r in pairs.broken_pairs(log).collect()] == [(1, "empty")]
    assert {tuple(r)[:2] for r in pairs.defect_counts(log).collect()} == {("empty", 1), ("sound", 1)}
    assert pairs.broken_pairs(log.limit(0)).count() == 0
