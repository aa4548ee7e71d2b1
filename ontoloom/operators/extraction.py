"""What stands between a model's output and tables: salvaged JSON, validated tuples,
terms found by rule and their provenance, clauses as a coverage model."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODALITIES = ["duty", "prohibition", "permission", "power", "liability", "exemption"]
CONFIDENCES = ["high", "medium", "low"]


def salvaged(text: str) -> tuple[list[dict], bool]:
    """JSON-1: the objects of a JSON array within a text, and whether the array is whole.
    Fences and what stands before the array are skipped; of a broken array the objects
    that are complete are kept."""
    start = text.find("[")
    if start < 0:
        return [], False
    decoder = json.JSONDecoder()
    try:
        value = decoder.raw_decode(text[start:])[0]
        return [v for v in value if isinstance(v, dict)], True
    except (ValueError, RecursionError):
        found, at = [], start + 1
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            at += 1
            continue
        found.append(value)
        at = end
    return found, False


def salvage(outputs: DataFrame) -> DataFrame:
    """JSON-1 over ``outputs(id, text)``: (id, pos, object, whole)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                found, whole = salvaged(text or "")
                rows += [(key, i, json.dumps(v, ensure_ascii=False, sort_keys=True), whole) for i, v in enumerate(found)]
            yield pd.DataFrame(rows, columns=["id", "pos", "object", "whole"])

    return outputs.select("id", "text").mapInPandas(run, "id STRING, pos INT, object STRING, whole BOOLEAN")


def validated(objects: DataFrame) -> DataFrame:
    """JSON-2: (id, pos, bearer, modality, action, confidence) of ``objects(id, pos,
    object)``: without a known modality, a bearer or an action an object is dropped; a
    confidence that is none is low."""
    field = lambda c: F.nullif(F.trim(F.get_json_object("object", f"$.{c}")), F.lit(""))
    modality = F.regexp_replace(F.lower(field("modality")), " ", "_")
    confidence = F.lower(field("confidence"))
    rows = objects.select("id", "pos", field("bearer").alias("bearer"), modality.alias("modality"), field("action").alias("action"), F.when(confidence.isin(*CONFIDENCES), confidence).otherwise("low").alias("confidence"))
    return rows.where(F.col("modality").isin(*MODALITIES) & F.col("bearer").isNotNull() & F.col("action").isNotNull())


# Restrictions as they were once written, and blank-node labels.
LEGACY = re.compile(r"^\s*(?P<prop>[\w:.-]+)\s+(?P<how>some|only|value|exactly\s+\d+|min\s+\d+|max\s+\d+)\s+(?P<filler>[\w:.-]+)\s*$")
BLANK = re.compile(r"^_:(?P<prop>[A-Za-z]\w*?)_(?P<how>some|only)_(?P<filler>[A-Za-z]\w*)$")


def legacy_restriction(text: str | None) -> tuple[str, str, str] | None:
    """EXPR-2: (property, quantifier, filler) of a restriction's text or of the label of a
    blank node."""
    m = LEGACY.match(text or "") or BLANK.match(text or "")
    return (m["prop"], " ".join(m["how"].split()), m["filler"]) if m else None


GATE = re.compile(r"^\s*(\w+)\s*(<=|>=|==|<|>)\s*([-+]?\d+(?:\.\d+)?)\s*$")


def gate_passed(expression: str, metrics: dict[str, float]) -> bool:
    """EXPR-3: a gate ``name op number``; an unknown name or another form raises."""
    m = GATE.match(expression)
    if not m or m[1] not in metrics:
        raise ValueError(f"no gate: {expression!r}")
    value, bound = metrics[m[1]], float(m[3])
    return {"<=": value <= bound, ">=": value >= bound, "==": value == bound, "<": value < bound, ">": value > bound}[m[2]]


# ---------------------------------------------------------------- terms by rule

# Heads of noun phrases and the category each stands for; words that end
# the walk to the left; verbs that make a phrase a rule, no term.
HEADS = {"notice": "content", "order": "content", "record": "content", "certificate": "content", "permit": "role", "licence": "role", "assessor": "role", "officer": "role", "hearing": "process", "transfer": "process", "renewal": "process", "review": "process", "tenure": "status", "liability": "status", "custody": "status"}
STOPS = frozenset("the a an of to in on at by for with from under before after and or that which who is are was were be shall must may can not no any each every this these those if unless where when".split())
DEONTIC = re.compile(r"\b(?:shall|must|may not|is bound to)\b", re.IGNORECASE)
DEFINED = re.compile(r"['‘“\"]([^'’”\"]+)['’”\"]\s+means\b|\bmeans\b")


def terms_of(text: str) -> list[tuple[str, str, str, bool, int]]:
    """EXT-1: (term, head, category, deontic, offset): each head of HEADS with the words to
    its left up to a stop word or mark, and whether its sentence is a rule."""
    found, at = [], 0
    for sentence in re.split(r"(?<=[.;:!?])\s+", text):
        place, at = text.find(sentence, at), at + len(sentence)
        rule = bool(DEONTIC.search(sentence))
        words = list(re.finditer(r"[^\W\d_]+(?:-[^\W\d_]+)*|[^\w\s]", sentence))
        for i, m in enumerate(words):
            category = HEADS.get(m[0].lower())
            if category is None:
                continue
            low = i
            while low > 0 and words[low - 1][0][0].isalpha() and words[low - 1][0].lower() not in STOPS and i - low < 4:
                low -= 1
            found.append((" ".join(w[0].lower() for w in words[low : i + 1]), m[0].lower(), category, rule, place + words[low].start()))
    return found


TERMS = "doc_id BIGINT, term STRING, head STRING, category STRING, deontic BOOLEAN, place INT"


def terms(documents: DataFrame) -> DataFrame:
    """EXT-1, AGG-27: (term, head, category, documents, uses, rules, confidence, first): each
    term once with its counts; one that is used in three texts or more, or defined by
    several words, is sure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *t) for d, text in zip(batch["doc_id"], batch["text"]) for t in terms_of(text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TERMS.split(", ")])

    rows = documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, TERMS)
    per_doc = rows.groupBy("term", "head", "category", "doc_id").agg(F.count("*").alias("uses"), F.count_if("deontic").alias("rules"), F.min("place").alias("place"))
    merged = per_doc.groupBy("term", "head", "category").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum("rules").alias("rules"), F.min(F.struct("doc_id", "place")).alias("f"))
    sure = (F.col("documents") >= 3) & F.col("term").contains(" ")
    return merged.select("term", "head", "category", "documents", "uses", "rules", F.when(sure, "high").when(F.col("documents") >= 3, "medium").otherwise("low").alias("confidence"), F.col("f.doc_id").alias("first_doc"))


def provenance(labels: DataFrame, passages: DataFrame) -> DataFrame:
    """EXT-2: (label, passage, how): the first passage of ``passages(passage, heading, text)``
    that holds a label as whole words: in its heading before its text; the label itself
    before its plural forms and runs of its words, longer ones first.

    Forms and passages meet by words: each form is posted under its rarest word, so no
    label is compared with all passages."""
    from ..functions.text import search_norm
    from .terms import surface_forms

    forms = labels.select("label").distinct().select("label", F.posexplode(surface_forms(F.col("label"))).alias("rank", "form")).where(F.length("form") > 3)
    texts = passages.select("passage", F.inline(F.array(F.struct(F.lit(0).alias("late"), F.col("heading").alias("t")), F.struct(F.lit(1).alias("late"), F.col("text").alias("t"))))).where("t is not null").select("passage", "late", search_norm(F.col("t")).alias("t"))
    words = texts.select("passage", "late", "t", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    posted = forms.select("label", "rank", "form", F.explode(F.split("form", " ")).alias("w")).join(df, "w").groupBy("label", "rank", "form").agg(F.min(F.struct("df", "w")).alias("r"), F.count("*").alias("n"))
    posted = posted.where(F.col("n") >= F.size(F.array_distinct(F.split("form", " ")))).select("label", "rank", "form", F.col("r.w").alias("w"))
    hits = posted.join(words, "w").where(F.contains("t", F.concat(F.lit(" "), "form", F.lit(" "))))
    best = hits.groupBy("label").agg(F.min(F.struct("rank", "late", "passage")).alias("b"))
    return best.select("label", "b.passage", F.concat(F.when(F.col("b.rank") == 0, "label").otherwise("variant"), F.when(F.col("b.late") == 0, " in heading").otherwise(" in text")).alias("how"))


# ---------------------------------------------------------------- coverage model

def coverage_rows(clauses: DataFrame) -> DataFrame:
    """X-9, X-10: (clause_id, row, subject, object) of ``clauses(clause_id, kind, subject,
    object)``: grants, exclusions, carve-backs, disjointness and facts; a clause of
    another kind, or without its subject, is a row ``skipped``."""
    kinds = {"grant": "grant", "coverage": "grant", "exclusion": "exclusion", "exception": "carveback", "carveback": "carveback", "disjoint": "disjoint", "fact": "fact"}
    row = F.lit(None).cast("string")
    for kind, name in kinds.items():
        row = F.when(F.lower("kind") == kind, name).otherwise(row)
    known = row.isNotNull() & (F.coalesce("subject", F.lit("")) != "")
    return clauses.select("clause_id", F.when(known, row).otherwise("skipped").alias("row"), "subject", "object")


def coverage_facts(rows: DataFrame) -> DataFrame:
    """(subject, granted, excluded, restored) of coverage rows, for the coverage rule."""
    has = lambda name: F.bool_or(F.col("row") == name)
    return rows.where("row in ('grant', 'exclusion', 'carveback')").groupBy("subject").agg(has("grant").alias("granted"), has("exclusion").alias("excluded"), has("carveback").alias("restored"))


def routed(corpora: DataFrame, routes: DataFrame) -> DataFrame:
    """X-19: (corpus_id, extractor): each corpus by ``routes(corpus_id, extractor)``, one or
    several; without a route the one named ``*``."""
    own = corpora.select("corpus_id").distinct().join(F.broadcast(routes), "corpus_id", "left")
    rest = routes.where("corpus_id = '*'").select(F.col("extractor").alias("usual"))
    return own.join(F.broadcast(rest), F.col("extractor").isNull(), "left").select("corpus_id", F.coalesce("extractor", "usual").alias("extractor"))


def lacking_fields(rows: DataFrame, required: list[str]) -> DataFrame:
    """X-16: rows with the required fields that they lack; none if a template is filled."""
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required]))
    return rows.withColumn("lacking", lacking)


def acquisition(expected: DataFrame, acquired: DataFrame) -> DataFrame:
    """X-20: (source, rows, status): whether each expected source of world data is there."""
    counted = acquired.groupBy("source").agg(F.count("*").alias("rows"))
    n = F.coalesce("rows", F.lit(0))
    return expected.join(counted, "source", "left").select("source", n.alias("rows"), F.when(n == 0, "missing").when(n < 30, "too few").otherwise("acquired").alias("status"))


def client_rows(rows: DataFrame, fields: list[str], hidden: Column) -> DataFrame:
    """FLT-9: only the listed fields, of rows in which nothing internal shows."""
    return rows.where(~hidden).select(*fields)


def policies(runs: DataFrame) -> DataFrame:
    """X-7: by policy of ``runs(policy, run, seq, clashed, outcome)``: runs, those that
    clashed, and of these those whose last event accepts."""
    last = runs.groupBy("policy", "run").agg(F.bool_or("clashed").alias("clashed"), F.max_by("outcome", "seq").alias("outcome"))
    return last.groupBy("policy").agg(F.count("*").alias("runs"), F.count_if("clashed").alias("clashes"), F.count_if(F.col("clashed") & (F.col("outcome") == "accept")).alias("recovered"))


def attach_fractions(rows: DataFrame) -> DataFrame:
    """WIN-3: (quartile, working, upper, other): the shares of what parents are attached to,
    by quartile of ``rows(seq, target)``; the last quartile takes the remainder. The
    place of a row is its rank over ranges of the sequence, in two levels."""
    from pyspark.sql import Window

    width = 1000
    cells = rows.groupBy(F.floor(F.col("seq") / width).alias("cell")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("cell", before.alias("start"))
    inner = F.row_number().over(Window.partitionBy("cell").orderBy("seq")) - 1
    placed = rows.withColumn("cell", F.floor(F.col("seq") / width)).withColumn("inner", inner).join(starts, "cell").withColumn("i", F.col("start") + F.col("inner"))
    total = rows.count()
    quartile = F.least(F.floor(F.col("i") / max(1, total // 4)), F.lit(3)) + 1
    share = lambda test: F.round(F.count_if(test) / F.count("*"), 6)
    working, upper = F.col("target").startswith("working:"), F.col("target").rlike("^(?:bfo|obo):")
    return placed.groupBy(quartile.cast("int").alias("quartile")).agg(share(working).alias("working"), share(upper).alias("upper"), share(~working & ~upper).alias("other"))


def session_costs(claims: DataFrame) -> DataFrame:
    """LOG-2: (status, claims) of all jobs, for the cost line of a feed."""
    return claims.groupBy("status").agg(F.count("*").alias("claims"))


def flush_marks(claims: DataFrame) -> DataFrame:
    """STR-4: (job_id, watermark, refed): the highest id below which no claim of a job is
    pending, and the committed claims above it, which a restart would feed again."""
    low = claims.groupBy("job_id").agg(F.min(F.when(F.col("status") == "pending", F.col("id"))).alias("open"), F.max("id").alias("top"))
    mark = F.coalesce(F.col("open") - 1, "top")
    marked = low.select("job_id", mark.alias("watermark"))
    again = claims.join(marked, "job_id").where("status = 'committed' and id > watermark").groupBy("job_id").agg(F.count("*").alias("refed"))
    return marked.join(again, "job_id", "left").select("job_id", "watermark", F.coalesce("refed", F.lit(0)).alias("refed"))


def axiom_text(triples: DataFrame) -> DataFrame:
    """FOL-1: (s, formula): subclass, disjointness and domain axioms as first-order text."""
    name = lambda c: F.regexp_replace(F.col(c), r"[^A-Za-z0-9_]", "_")
    body = (
        F.when(F.col("p") == "rdfs:subClassOf", F.concat(F.lit("all x ("), name("s"), F.lit("(x) -> "), name("o"), F.lit("(x)).")))
        .when(F.col("p") == "owl:disjointWith", F.concat(F.lit("all x -("), name("s"), F.lit("(x) & "), name("o"), F.lit("(x)).")))
        .when(F.col("p") == "rdfs:domain", F.concat(F.lit("all x all y ("), name("s"), F.lit("(x,y) -> "), name("o"), F.lit("(x)).")))
    )
    return triples.where("s_kind = 'iri' and o_kind = 'iri'").select("s", body.alias("formula")).where("formula is not null")
