"""Texts cut off by field limits or in transfer.

Per source, histograms of the lengths in characters and in UTF-8 bytes are tested
for a spike at a maximum: a length that holds at least ``LEAST`` values and at
least ``RATIO`` times as many as the mean of the lengths near it, with almost none
above. Two kinds of cuts are told apart:

* ``field_limit``: a value at a spike length whose end is no end of a sentence.
  There the length is the evidence, so neither the look of a heading nor a full
  stop after the number of a citation makes it whole.
* ``transfer``: a value of any other length. There the end alone is the evidence:
  an ellipsis, a replacement character, an opened bracket, a dash, a cut entity or
  a comma, an abbreviation whose number is missing, or no terminal punctuation in
  what is no heading.

List items that end with a semicolon, also followed by "and" or "or", are whole.
The tests of the end look at the last 200 characters; no pattern reaches further.
Null and empty texts are no cases. Rows repeated with the same key count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

LEAST, RATIO, NEAR, TAIL = 8, 6.0, 10, 0.02

# What may follow the sign of a heading, abbreviations before a number.
HEADING = (
    r"^(?:§+|(?:article|art\.|artikel|artículo|άρθρο|член|rule|section|sec\.|chapter|part|title|annex|schedule|paragraph|para\.|no\.|appendix|clause|regulation)\b)"
    r"\s*[§\dIVXLC][\w.()/-]*[.:]?(?:\s+\S+)*$"
)
SMALL_WORDS = r"(?:of|the|to|and|for|in|on|at|by|or|a|an|with|from|under|before|after|payable|over|between|as|made|held|given|due|against|within|upon|about)"
ABBREVIATED = r"(?i)(?:^|[\s(])(?:sec|secs|art|arts|no|nos|para|paras|cf|ch|pt|reg|fig|vol|p|pp|vs|viz|e\.g|i\.e)\.$"
CITED = r"(?i)(?:\b(?:sec|art|para|no|rule|ch)\b\.?|§)\s*\d+\.?$"
CLOSED = r"[.!?。！？؟][\"'’”»“)\]}]*$"
CUT_MARK = r"(?:…|\.\.\.|�|[,(\[{–—&-]|&[a-zA-Z]{1,6})$"


def heading(text: Column) -> Column:
    """A sign or word of a numbered heading, and capitalised words after it. One
    that stops at a small word has been cut."""
    lower_words = F.regexp_replace(text, rf"(?<=\s){SMALL_WORDS}(?=\s)", "")
    return (
        (F.length(text) <= 160)
        & text.rlike("(?i)" + HEADING)
        & ~lower_words.rlike(r"\s\p{Ll}")
        & ~text.rlike(rf"\s{SMALL_WORDS}$")
    )


def features(rows: DataFrame, kind: str, key: str, source: str, text: str) -> DataFrame:
    """Narrow rows: lengths and three tests of the end, without the text."""
    value = F.regexp_replace(F.col(text), r"[\s ​﻿]+$", "")
    end = F.substring(value, -200, 200)  # what the tests of the end look at
    marked = end.rlike(CUT_MARK) | end.rlike(ABBREVIATED)
    ended = end.rlike(CLOSED) | end.rlike(r"(?i);(?:\s+(?:and|or))?$")
    return (
        rows.where(F.col(key).isNotNull())
        .select(
            F.lit(kind).alias("record_kind"), F.col(key).cast("string").alias("record_id"), F.col(source).alias("source"),
            F.when(value != "", F.length(text)).alias("chars"), F.when(value != "", F.octet_length(text)).alias("bytes"),
            F.coalesce(marked, F.lit(False)).alias("marked"),
            F.coalesce(ended, F.lit(True)).alias("ended"),
            F.coalesce(heading(value), F.lit(False)).alias("heading"),
            F.coalesce(end.rlike(CITED), F.lit(False)).alias("cited"),
        )
        .dropDuplicates(["record_kind", "record_id"])
    )


def spikes(lengths: DataFrame) -> DataFrame:
    """(record_kind, source, at_chars, at_bytes): the lengths at which a source cuts,
    of both units in one histogram. Windows run over the histogram of a source, whose
    rows are lengths, not records."""
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")]))
    counted = lengths.where(F.col("chars").isNotNull()).groupBy("record_kind", "source", "chars", "bytes").agg(F.count("*").alias("n"))
    histogram = counted.select("record_kind", "source", "n", units.alias("u")).groupBy("record_kind", "source", "u.unit", "u.length").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("record_kind", "source", "unit")
    near = F.sum("n").over(by.orderBy("length").rangeBetween(-NEAR, NEAR)) - F.col("n")
    above = F.sum("n").over(by.orderBy("length").rangeBetween(1, Window.unboundedFollowing))
    tested = histogram.withColumns({"near": near / (2 * NEAR), "above": F.coalesce(above, F.lit(0)), "total": F.sum("n").over(by)})
    found = tested.where((F.col("n") >= LEAST) & (F.col("n") >= RATIO * F.col("near")) & (F.col("above") <= TAIL * F.col("total")))
    at = lambda u: F.collect_list(F.when(F.col("unit") == u, F.col("length"))).alias(f"at_{u}")
    return found.groupBy("record_kind", "source").agg(at("chars"), at("bytes"))


def judged(rows: DataFrame) -> DataFrame:
    """``features`` with spike and cut, which is the kind of cut or null. The features
    are written once; spikes are at most a few lengths a source."""
    known = written(rows.withColumn("source", F.coalesce("source", F.lit(""))))
    flagged = known.join(spikes(known), ["record_kind", "source"], "left")
    spike = F.coalesce(F.array_contains("at_chars", F.col("chars")) | F.array_contains("at_bytes", F.col("bytes")), F.lit(False))
    cut = F.when(spike & (F.col("marked") | ~F.col("ended") | F.col("cited")), "field_limit").when(~spike & (F.col("marked") | (~F.col("ended") & ~F.col("heading"))), "transfer")
    return flagged.select("record_kind", "record_id", "source", "chars", "bytes", spike.alias("spike"), F.when(F.col("chars").isNotNull(), cut).alias("cut"))


def quotes(claims: DataFrame, norm_tuples: DataFrame) -> DataFrame:
    return features(claims, "claim", "claim_key", "job_id", "source_quote").unionAll(features(norm_tuples, "norm", "tuple_id", "corpus_id", "source_quote"))


def truncated(rows: DataFrame) -> DataFrame:
    return judged(rows).where("cut is not null").select("record_kind", "record_id")


def truncation_shares(rows: DataFrame) -> DataFrame:
    """How often each source truncates: texts, cut texts by kind, share, spike lengths."""
    return (
        judged(rows).where(F.col("chars").isNotNull()).groupBy("record_kind", F.nullif("source", F.lit("")).alias("source"))
        .agg(
            F.count("*").alias("texts"), F.count("cut").alias("truncated"), F.round(F.count("cut") / F.count("*"), 6).alias("share"),
            F.count_if(F.col("cut") == "field_limit").alias("by_limit"), F.count_if(F.col("cut") == "transfer").alias("in_transfer"),
            F.count_if("spike").alias("at_spike"), F.max(F.when(F.col("spike"), F.col("chars"))).alias("spike_chars"), F.max(F.when(F.col("spike"), F.col("bytes"))).alias("spike_bytes"),
        )
    )
