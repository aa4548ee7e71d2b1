import pytest

from ontoloom.llm import truncation

WHOLE = ["The fee was paid.", "It is held.”", "(as amended.)", "Rule 43 Removal of the Certifier", "§ 26.8 Duties of the Board Member", "the fee is paid; or", "the fee is paid;", "See para. 11.", "Is it so?", "done. \n"]
CUT = ["The clerk must inf", "provided tha…", "the stat...", "trans�", "Subject to Art.", "rests on the [", "adjudicator jointly -", "to settle by the record,", "renewal &am", "Article 5 Duties of the", "they must seal the "]


def rows(spark, quotes, source="s"):
    return spark.createDataFrame([(i, source, q, "x") for i, q in enumerate(quotes)], "claim_key BIGINT, job_id STRING, source_quote STRING, chars STRING")


def found(df):
    return {int(r.record_id) for r in truncation.truncated(df).collect()}


def test_ends(spark):
    quotes = WHOLE + CUT + [None, "", "  "]
    df = truncation.features(rows(spark, quotes), "claim", "claim_key", "job_id", "source_quote")
    assert found(df) == set(range(len(WHOLE), len(WHOLE) + len(CUT)))


def test_spikes_decide_on_cited_numbers(spark):
    cut = "word " * 18 + "see sec. 3."
    quotes = [cut[-40:]] * 12 + [f"A sentence of its own length {'x' * i}." for i in range(8)] + ["see sec. 3."]
    df = truncation.features(rows(spark, quotes), "claim", "claim_key", "job_id", "source_quote")
    assert found(df) == set(range(12))
    share = truncation.truncation_shares(df).first()
    assert (share.texts, share.truncated, share.at_spike, share.spike_chars) == (21, 12, 12, 40)


def test_repeats_nulls_and_empty_tables(spark):
    df = rows(spark, ["cut of", "whole."])
    twice = truncation.features(df.unionAll(df), "claim", "claim_key", "job_id", "source_quote")
    assert truncation.truncation_shares(twice).first().texts == 2
    assert truncation.truncated(truncation.features(df.limit(0), "claim", "claim_key", "job_id", "source_quote")).count() == 0
    long = rows(spark, ["word " * 300_000 + "end.", "Rule 1 " + "Of " * 300_000], None)
    assert found(truncation.features(long, "claim", "claim_key", "job_id", "source_quote")) == {1}
