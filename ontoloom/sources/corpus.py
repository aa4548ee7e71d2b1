"""Readers and writers of corpora and job envelopes: chunk folders, scheduled texts,
whole texts with a record of how they were prepared, versioned job envelopes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id STRING, section STRING, subpart STRING, heading STRING, text STRING, chars INT, source_sha256 STRING, chunk_sha256 STRING"
CHUNKS = [c.split()[0] for c in CHUNK.split(", ")]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: a folder of JSON files with a chunk each; other files give no rows."""
    rows = spark.read.schema(CHUNK).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.where("chunk_id is not null")


def scheduled_chunks(raw: bytes) -> list[tuple]:
    """SRC-9: the sections (DIV8) of a scheduled text and, of each appendix (DIV9), the
    blocks that a first-level heading opens, as rows of CHUNK."""
    source, root, rows = hashlib.sha256(raw).hexdigest(), ElementTree.fromstring(raw), []
    words = lambda e: " ".join("".join(e.itertext()).split())

    def chunk(name: str, subpart: str | None, head: str, parts: list[str]) -> None:
        text = "\n\n".join(p for p in parts if p)
        if text:
            rows.append((name, name, subpart, head, text, len(text), source, hashlib.sha256(text.encode()).hexdigest()))

    def walk(e: ElementTree.Element, subpart: str | None) -> None:
        subpart = e.get("N", subpart) if e.tag == "DIV6" else subpart
        if e.tag == "DIV8":
            head = e.find("HEAD")
            chunk(e.get("N", ""), subpart, words(head) if head is not None else "", [words(c) for c in e if c.tag != "HEAD"])
        elif e.tag == "DIV9":
            name, title, parts, turn = e.get("N", ""), "", [], 0
            for c in e:
                if c.tag == "HD1":
                    chunk(f"{name}#{turn}", subpart, title, parts)
                    title, parts, turn = words(c), [], turn + 1
                elif c.tag == "HEAD":
                    title = words(c)
                else:
                    parts.append(words(c))
            chunk(f"{name}#{turn}", subpart, title, parts)
        else:
            for c in e:
                walk(c, subpart)

    walk(root, None)
    return rows


def read_scheduled(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9 over a folder; a file that is no XML gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    out += scheduled_chunks(bytes(content))
                except ElementTree.ParseError:
                    continue
            yield pd.DataFrame(out, columns=CHUNKS)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, CHUNK)


def read_corpus(spark: SparkSession, path: str, prepare: Callable[[str], tuple[str, int, int]] | None = None) -> DataFrame:
    """SRC-10: (path, text, sha256, start, end, prepared): whole UTF-8 texts with the hash of
    what was read and the span that ``prepare`` retained."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, content in zip(batch["path"], batch["content"]):
                raw = bytes(content).decode("utf-8", "replace")
                text, start, end = prepare(raw) if prepare else (raw, 0, len(raw))
                out.append((at, text, hashlib.sha256(bytes(content)).hexdigest(), start, end, prepare is not None))
            yield pd.DataFrame(out, columns=["path", "text", "sha256", "start", "end", "prepared"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path STRING, text STRING, sha256 STRING, start INT, end INT, prepared BOOLEAN")


# The version of an envelope and how much one may hold.
VERSION, MOST_CLAIMS, MOST_TEXT = 1, 20_000, 20_000
CLAIM_FIELDS = ["id", "claim", "source_quote", "confidence", "note", "section", "chunk_index", "approved", "status", "proposal_id", "verdict"]


def export_jobs(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """SNK-5: (job_id, part, envelope): a job as JSON with its claims in the order of their
    ids, ``MOST_CLAIMS`` of them a part; fields without a value are left out."""
    rows = claims.where("job_id is not null").dropDuplicates(["job_id", "id"])
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("job_id").orderBy("id")) - 1
    part = F.floor(turn / MOST_CLAIMS).cast("int")
    grouped = rows.withColumn("part", part).groupBy("job_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.struct(*CLAIM_FIELDS).alias("c")))), lambda x: x["c"]).alias("claims"))
    head = jobs.where("job_id is not null").dropDuplicates(["job_id"])
    joined = head.join(grouped, "job_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    body = F.struct(F.lit(VERSION).alias("version"), F.col("part"), F.struct("job_id", "name", "status", "session_id").alias("job"), F.col("claims"))
    return joined.select("job_id", "part", F.to_json(body).alias("envelope"))


def envelope_faults(text: str | None) -> list[tuple[str, str]]:
    """SRC-13: the rules that an envelope breaks, as (rule, detail); none if it is sound."""
    try:
        value = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return [("json", "is no JSON")]
    if not isinstance(value, dict):
        return [("object", "is no object")]
    faults, claims = [], value.get("claims", [])
    if value.get("version") != VERSION:
        faults.append(("version", str(value.get("version"))))
    if not isinstance(value.get("job"), dict) or not value["job"].get("job_id"):
        faults.append(("job", "has no job_id"))
    if not isinstance(claims, list):
        return [*faults, ("claims", "are no list")]
    if len(claims) > MOST_CLAIMS:
        faults.append(("size", str(len(claims))))
    ids = [c.get("id") for c in claims if isinstance(c, dict)]
    if len(ids) < len(claims) or any(not isinstance(i, int) or isinstance(i, bool) for i in ids):
        faults.append(("claim", "is no object with a number"))
    if len(set(map(str, ids))) < len(ids):
        faults.append(("id", "occurs twice"))
    if any(len(str(v)) > MOST_TEXT for c in claims if isinstance(c, dict) for v in c.values()):
        faults.append(("text", "is too long"))
    return faults


def import_faults(envelopes: DataFrame) -> DataFrame:
    """SRC-13: (job_id, part, rule, detail) of ``envelopes(job_id, part, envelope)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(j, p, *f) for j, p, e in zip(batch["job_id"], batch["part"], batch["envelope"]) for f in envelope_faults(e)]
            yield pd.DataFrame(rows, columns=["job_id", "part", "rule", "detail"])

    return envelopes.select("job_id", "part", "envelope").mapInPandas(run, "job_id STRING, part INT, rule STRING, detail STRING")


def import_claims(envelopes: DataFrame) -> DataFrame:
    """SRC-13: (job_id, ...) the claims of the envelopes that break no rule."""
    bad = import_faults(envelopes).select("job_id", "part").distinct()
    fields = "id BIGINT, claim STRING, source_quote STRING, confidence STRING, note STRING, section STRING, chunk_index INT, approved BOOLEAN, status STRING, proposal_id STRING, verdict STRING"
    rows = envelopes.join(bad, ["job_id", "part"], "left_anti").select("job_id", F.explode(F.from_json("envelope", f"claims ARRAY<STRUCT<{fields}>>")["claims"]).alias("c"))
    return rows.select("job_id", "c.*")


# Code, stratum, kind, weight of the primitives.
PRIMITIVES = [(f"K-{s}{i}", s, "coverage" if s == "B" and i == 3 else "defect", 1.0) for s in "ABCD" for i in (1, 2, 3)]


def primitives(spark: SparkSession) -> DataFrame:
    """SRC-14: the registry as a table."""
    return spark.createDataFrame(PRIMITIVES, "code STRING, stratum STRING, kind STRING, weight DOUBLE")
