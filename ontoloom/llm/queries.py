"""Queries of the llm operators: ``QUERIES`` and their SQL twins ``SQL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import encode, lookalike, mix, neardup, pairs, split, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "session_log"))


def p1_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defect_counts(table(spark, sf_dir, "session_log"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_ = neardup.similar_pairs(table(spark, sf_dir, "claims"), "claim_key", neardup.text_of("claim", "source_quote"), 0.7)
    return pairs_.toDF("claim_key_a", "claim_key_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, "claims"), "claim_key", neardup.text_of("claim", "source_quote"), 0.7)


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.quotes(table(spark, sf_dir, "claims"), table(spark, sf_dir, "norm_tuples"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_quotes(spark, sf_dir))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_shares(_quotes(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_ids(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.decoded(encode.token_ids(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.forms(table(spark, sf_dir, "documents"))


def p9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_groups(table(spark, sf_dir, "documents"))


def p9_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.script_report(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of the shared folder, in pieces of 2000 characters."""
    return split.split_corpus(table(spark, sf_dir, "documents"), 2000, 200)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


QUERIES = {
    "p1_found": p1_found,
    "p1_defect_counts": p1_defect_counts,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_files": p3_files,
    "p5_found": p5_found,
    "p5_shares": p5_shares,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_forms": p9_forms,
    "p9_groups": p9_groups,
    "p9_scripts": p9_scripts,
}

SQL: dict[str, str] = {
    # The cut kinds, straight from their definition.
    "p3_found": r"""
        WITH sized AS (
            SELECT DISTINCT c.chunk_id, c.text, coalesce(l.chunk_chars, d.chunk_chars) AS most
            FROM chunks c LEFT JOIN chunk_limits l ON l.subpart = c.subpart AND l.subpart <> '*'
            CROSS JOIN (SELECT chunk_chars FROM chunk_limits WHERE subpart = '*') d
            WHERE c.chunk_id IS NOT NULL)
        SELECT chunk_id,
            CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]'), lambda x: length(x))) > most
                THEN 'forced' ELSE 'natural' END AS cut
        FROM sized WHERE length(text) > most""",
    # Decoding the ids must give the text back; null texts come back empty.
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
