"""Readers that turn files and markup into tables: RDF/XML, N-Triples, structured
legal markup, logs, first-matching CSV columns.

Files are read as one row each (``binaryFile`` or text), parsed by the standard
library in Arrow batches, and given as triples in the shape of
``operators.triples``. A file that cannot be parsed gives no triples and one row of
``broken``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML = "{http://www.w3.org/XML/1998/namespace}"
TRIPLE = "s STRING, s_kind STRING, p STRING, o STRING, o_kind STRING, o_lang STRING, o_dt STRING, source STRING"
#: The namespaces whose names the operators know in their compact form.
COMPACT = {
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf:", "http://www.w3.org/2000/01/rdf-schema#": "rdfs:", "http://www.w3.org/2002/07/owl#": "owl:",
    "http://www.w3.org/2004/02/skos/core#": "skos:", "http://purl.org/dc/elements/1.1/": "dc:", "http://purl.obolibrary.org/obo/": "obo:", "http://www.w3.org/2001/XMLSchema#": "xsd:",
}


def compact(iri: str, more: dict[str, str] | None = None) -> str:
    """A name in its compact form, if its namespace has one."""
    for space, prefix in (COMPACT | (more or {})).items():
        if iri.startswith(space):
            return prefix + iri[len(space) :]
    return iri


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def parse_rdf_xml(text: str | bytes, base: str = "") -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_lang, o_dt) of an RDF/XML document: typed nodes,
    rdf:about, ID, nodeID, resource, parseType Resource, Collection and Literal,
    property attributes, languages, datatypes, xml:base."""
    rows: list[tuple] = []
    count = 0

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:b{count}"

    def full(iri: str) -> str:
        return base + iri if iri.startswith("#") or not iri else iri

    def node(e: ElementTree.Element, lang: str | None) -> tuple[str, str]:
        lang = e.get(XML + "lang", lang)
        if (about := e.get(RDF + "about")) is not None:
            s, kind = full(about), "iri"
        elif (name := e.get(RDF + "ID")) is not None:
            s, kind = f"{base}#{name}", "iri"
        else:
            name = e.get(RDF + "nodeID")
            s, kind = (f"_:{name}", "bnode") if name else (blank(), "bnode")
        if e.tag != RDF + "Description":
            rows.append((s, kind, _iri(RDF + "type"), _iri(e.tag), "iri", None, None))
        for key, value in e.attrib.items():
            if not key.startswith((RDF, XML)) or key == RDF + "type":
                rows.append((s, kind, _iri(key), value, "iri" if key == RDF + "type" else "lit", None if key == RDF + "type" else lang, None))
        properties(e, s, kind, lang)
        return s, kind

    def properties(e: ElementTree.Element, s: str, kind: str, lang: str | None) -> None:
        for child in e:
            own, p = child.get(XML + "lang", lang), _iri(child.tag)
            how = child.get(RDF + "parseType")
            if (resource := child.get(RDF + "resource")) is not None:
                rows.append((s, kind, p, full(resource), "iri", None, None))
            elif (name := child.get(RDF + "nodeID")) is not None:
                rows.append((s, kind, p, f"_:{name}", "bnode", None, None))
            elif how == "Collection":
                items = [node(c, own) for c in child]
                cells = [blank() for _ in items]
                head = (cells + ["nil"])[0]
                rows.append((s, kind, p, head if cells else _iri(RDF + "nil"), "bnode" if cells else "iri", None, None))
                for i, (o, o_kind) in enumerate(items):
                    rows.append((cells[i], "bnode", _iri(RDF + "first"), o, o_kind, None, None))
                    last = i + 1 == len(items)
                    rows.append((cells[i], "bnode", _iri(RDF + "rest"), _iri(RDF + "nil") if last else cells[i + 1], "iri" if last else "bnode", None, None))
            elif how == "Resource":
                o = blank()
                rows.append((s, kind, p, o, "bnode", None, None))
                properties(child, o, "bnode", own)
            elif how == "Literal":
                rows.append((s, kind, p, "".join(child.itertext()), "lit", None, "rdf:XMLLiteral"))
            elif len(child):
                for inner in child:
                    o, o_kind = node(inner, own)
                    rows.append((s, kind, p, o, o_kind, None, None))
            else:
                dt = child.get(RDF + "datatype")
                rows.append((s, kind, p, child.text or "", "lit", None if dt else own, dt))

    root = ElementTree.fromstring(text)
    base = root.get(XML + "base", base).rstrip("#")
    for e in root if root.tag == RDF + "RDF" else [root]:
        node(e, root.get(XML + "lang"))
    return rows


TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?)(?![\w:]))
    |(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%:-]|\.(?=[\w%:-]))*|\w+)|(?P<mark>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def unescaped(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text, flags=re.DOTALL)


class Turtle:
    """A reader of Turtle: prefixes, base, predicate and object lists, blank nodes,
    collections, literals. ``rows`` are as those of ``parse_rdf_xml``; what cannot be
    read raises ValueError."""

    def __init__(self, text: str, base: str = "") -> None:
        self.rows: list[tuple] = []
        self.prefixes, self.base, self.blanks = {"xsd": "http://www.w3.org/2001/XMLSchema#"}, base, 0
        self.tokens, at = [], 0
        while at < len(text):
            m = TURTLE.match(text, at)
            if m is None:
                raise ValueError(f"no Turtle at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        while self.at < len(self.tokens):
            self.statement()

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted is not None and self.tokens[self.at][1] != wanted:
            raise ValueError(f"{wanted or 'more'} expected")
        self.at += 1
        return self.tokens[self.at - 1]

    def ahead(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def statement(self) -> None:
        word = self.ahead().lower()
        if word in ("@prefix", "prefix"):
            self.take()
            name = self.take()[1].rstrip(":")
            self.prefixes[name] = self.take()[1][1:-1]
        elif word in ("@base", "base"):
            self.take()
            self.base = self.take()[1][1:-1]
        else:
            subject = self.term()
            if self.ahead() != ".":
                self.predicates(subject)
            word = "@"
        if word.startswith("@"):
            self.take(".")

    def fresh(self) -> tuple[str, str, None, None]:
        self.blanks += 1
        return f"_:t{self.blanks}", "bnode", None, None

    def predicates(self, subject: tuple) -> None:
        while self.ahead() not in (".", "]", ""):
            if self.ahead() == ";":
                self.take()
                continue
            p = self.term()[0]
            while True:
                o = self.term()
                self.rows.append((*subject[:2], p, *o))
                if self.ahead() != ",":
                    break
                self.take()

    def term(self) -> tuple:
        """(value, kind, language, datatype)."""
        kind, token = self.take()
        if kind == "iri":
            iri = unescaped(token[1:-1])
            return (iri if re.match(r"^[A-Za-z][\w+.-]*:", iri) else self.base + iri), "iri", None, None
        if kind == "blank":
            return token, "bnode", None, None
        if kind in ("text", "long"):
            value, lang, dt = unescaped(token[3:-3] if kind == "long" else token[1:-1]), None, None
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                lang = self.take()[1][1:]
            elif self.ahead() == "^^":
                self.take()
                dt = self.term()[0]
            return value, "lit", lang, dt
        if kind == "number":
            name = "double" if re.search("[eE]", token) else "decimal" if "." in token else "integer"
            return token, "lit", None, self.prefixes["xsd"] + name
        if token == "[":
            node = self.fresh()
            self.predicates(node)
            self.take("]")
            return node
        if token == "(":
            items = []
            while self.ahead() != ")":
                items.append(self.term())
            self.take(")")
            rdf, cells = RDF[1:-1], [self.fresh() for _ in items]
            end = (rdf + "nil", "iri", None, None)
            for i, item in enumerate(items):
                self.rows.append((*cells[i][:2], rdf + "first", *item))
                self.rows.append((*cells[i][:2], rdf + "rest", *(cells[i + 1] if i + 1 < len(cells) else end)))
            return cells[0] if cells else end
        if token == "a":
            return RDF[1:-1] + "type", "iri", None, None
        if token in ("true", "false"):
            return token, "lit", None, self.prefixes["xsd"] + "boolean"
        prefix, colon, rest = token.partition(":")
        if not colon or prefix not in self.prefixes:
            raise ValueError(f"unknown name {token!r}")
        return self.prefixes[prefix] + rest, "iri", None, None


def _parse(turtle: bool):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in TRIPLE.split(", ")]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = Turtle(bytes(content).decode("utf-8")).rows if turtle else parse_rdf_xml(content)
                    out += [(*row, path) for row in rows]
                except (ElementTree.ParseError, ValueError):
                    out.append((None, "broken", None, None, None, None, None, path))
            yield pd.DataFrame(out, columns=columns)

    return parse


def compacted(column: Column, prefixes: dict[str, str] | None = None) -> Column:
    """Names in their compact form, in the JVM."""
    out = column
    for space, prefix in (COMPACT | (prefixes or {})).items():
        out = F.when(column.startswith(space), F.concat(F.lit(prefix), F.substring(column, F.lit(len(space) + 1), F.length(column)))).otherwise(out)
    return out


def _read(spark: SparkSession, path: str, turtle: bool, prefixes: dict[str, str] | None) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_parse(turtle), TRIPLE)
    name = lambda c, k: F.when(F.col(k) == "bnode", F.concat(F.col(c), F.lit("@"), F.xxhash64("source").cast("string"))).when(F.col(k) == "iri", compacted(F.col(c), prefixes)).otherwise(F.col(c))
    return raw.select(name("s", "s_kind").alias("s"), "s_kind", compacted(F.col("p"), prefixes).alias("p"), name("o", "o_kind").alias("o"), "o_kind", "o_lang", compacted(F.col("o_dt"), prefixes).alias("o_dt"), "source").distinct()


def read_rdf_xml(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """SRC-1: the triples of the RDF/XML files under ``path``, in the names the operators
    know; blank nodes are named by file. ``prefixes`` adds namespaces to compact."""
    return _read(spark, path, False, prefixes)


def read_turtle(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """SRC-1: the triples of the Turtle files under ``path``, as ``read_rdf_xml``."""
    return _read(spark, path, True, prefixes)


def preview(triples: DataFrame) -> DataFrame:
    """SRC-12: counts of what a file would bring, nothing committed."""
    from ..operators.triples import census

    return census(triples.where("s_kind <> 'broken'"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples by regular expression, all in the JVM; other lines are dropped."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    s, o = F.regexp_extract("value", line, 1), F.regexp_extract("value", line, 3)
    kind = lambda c: F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "bnode").otherwise("lit")
    bare = lambda c: F.when(c.startswith("<"), F.regexp_replace(c, "^<|>$", "")).when(c.startswith('"'), F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(c)
    short = lambda c, k: F.when(k == "iri", compacted(c)).otherwise(c)
    return rows.select(
        short(bare(s), kind(s)).alias("s"), kind(s).alias("s_kind"), compacted(F.regexp_extract("value", line, 2)).alias("p"), short(bare(o), kind(o)).alias("o"), kind(o).alias("o_kind"),
        F.nullif(F.regexp_extract(o, r'"@([\w-]+)$', 1), F.lit("")).alias("o_lang"), F.nullif(compacted(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1)), F.lit("")).alias("o_dt"),
    ).distinct()


def list_members(triples: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(head, pos, member): RDF lists unrolled by doubling jumps over rdf:rest: each cell
    learns the last cell of its list and how far it is, in rounds that grow with the
    logarithm of the length. A list that bites its tail raises."""
    from ..session import discard, written

    first = triples.where(F.col("p").isin("rdf:first", RDF[1:-1] + "first")).select(F.col("s").alias("cell"), F.col("o").alias("member"))
    rest = triples.where(F.col("p").isin("rdf:rest", RDF[1:-1] + "rest") & (F.col("o_kind") == "bnode")).select(F.col("s").alias("cell"), F.col("o").alias("next"))
    jumps = written(first.select("cell").distinct().join(rest, "cell", "left").select("cell", "next", F.col("cell").alias("last"), F.lit(0).cast("bigint").alias("far")))
    for _ in range(max_rounds):
        if jumps.where("next is not null").isEmpty():
            by = jumps.groupBy("last").agg(F.max_by("cell", "far").alias("head"), F.max("far").alias("length"))
            return jumps.join(by, "last").join(first, "cell").select("head", (F.col("length") - F.col("far")).cast("int").alias("pos"), "member")
        # A jump lands on a cell that knows its own way on; the last cell has no next.
        onward = jumps.select(F.col("cell").alias("next"), F.col("next").alias("beyond"), F.col("last").alias("end"), (F.col("far") + 1).alias("more"))
        after = jumps.join(onward, "next", "left").select("cell", F.col("beyond").alias("next"), F.coalesce("end", "last").alias("last"), F.when(F.col("end").isNotNull(), F.col("far") + F.col("more")).otherwise(F.col("far")).alias("far"))
        after = written(after)
        discard(jumps)
        jumps = after
    raise RuntimeError("list_members: a list has no end")


# ---------------------------------------------------------------- markup

def markup_format(raw: Column) -> Column:
    """SRC-8: akn, formex, jlt, xhtml or text, by the first 5000 characters."""
    head = F.lower(F.substring(F.ltrim(raw), 1, 5000))
    return (
        F.when(head.contains("akomantoso"), "akn").when(head.rlike(r"<(?:act|cons\.act|formex)[\s>]"), "formex").when(head.contains("<jlt"), "jlt")
        .when(head.rlike(r"<!doctype html|<html[\s>]|<body[\s>]|<div[\s>]"), "xhtml").otherwise("text")
    )


# Elements that stand on lines of their own, elements that are not read,
# and cells, which are parted by a blank.
LINES = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol title".split())
UNREAD, CELLS = frozenset("head script style".split()), frozenset("td th".split())
FOOTNOTE = re.compile(r"\b(?:foot)?note(?:-?ref)?\b|\bfn\b", re.IGNORECASE)


def visible_text(raw: str) -> str:
    """The text of HTML: one reader with a stack of open elements; what is below an unread
    element or a footnote mark is left out, elements of a line begin and end it."""
    open_, out = [], []
    silent = lambda: any(quiet for _, quiet in open_)

    def begin(tag: str, attributes: list) -> None:
        note = tag in ("sup", "a", "span") and any(k in ("class", "id") and v and FOOTNOTE.search(v) for k, v in attributes)
        out.append("\n" if tag in LINES else " " if tag in CELLS else "")
        if tag not in ("br", "hr", "img", "meta", "link", "input"):
            open_.append((tag, tag in UNREAD or note))

    def end(tag: str) -> None:
        place = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
        if place is not None:
            del open_[place:]
        out.append("\n" if tag in LINES else "")

    reader = HTMLParser(convert_charrefs=True)
    reader.handle_starttag, reader.handle_endtag = begin, end
    reader.handle_data = lambda data: out.append("" if silent() else data)
    reader.feed(raw)
    reader.close()
    return "".join(out)


def markup_text(raw: str | None) -> str | None:
    """SRC-7: the text of XML, else of HTML, else without anything in tags."""
    if raw is None:
        return None
    try:
        text = "\n".join(filter(None, (t.strip() for t in ElementTree.fromstring(raw.strip()).itertext()))) if not re.search(r"(?i)<html|<body|<div|<p>", raw[:5000]) else None
    except ElementTree.ParseError:
        text = None
    if text is None:
        try:
            text = visible_text(raw)
        except (AssertionError, ValueError):
            text = re.sub(r"<[^>]+>", " ", raw)
    return re.sub(r"\n{2,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\r]+", " ", text))).strip()


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "text": pd.Series([markup_text(r) for r in batch["raw"]], dtype=object)})


def to_text(raw: DataFrame) -> DataFrame:
    """SRC-7 over ``raw(id, raw)``."""
    return raw.where("id is not null").select("id", "raw").mapInPandas(_texts, "id BIGINT, text STRING")


# ---------------------------------------------------------------- logs and CSV

def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-3, 4: JSON lines; lines that are no JSON are skipped."""
    return json_rows(spark.read.text(path), schema)


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """The rows of ``lines(value)`` that are JSON objects, by ``schema``; for batches and
    streams alike."""
    valid = lines.where(F.expr("schema_of_variant(try_parse_json(value))").startswith("OBJECT"))
    return valid.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_rates(spark: SparkSession, path: str, ids: list[str], rates: list[str]) -> DataFrame:
    """SRC-6: (id, rate): the first of the candidate columns that a CSV has; percent
    signs are taken off, rows without a number dropped."""
    rows = spark.read.option("header", True).csv(path)
    pick = lambda names: next((c for want in names for c in rows.columns if c.lower() == want.lower()), None)
    key, rate = pick(ids), pick(rates)
    if key is None or rate is None:
        return spark.createDataFrame([], "id STRING, rate DOUBLE")
    value = F.expr(f"try_cast(btrim(`{rate}`, '% ') as double)")
    return rows.select(F.col(key).alias("id"), value.alias("rate")).where("rate is not null")


def append_log(rows: DataFrame, path: str) -> None:
    """SNK-1: appends as JSON lines."""
    rows.write.mode("append").json(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """SNK-2, 3: sorted and partitioned by predicate, so that a pattern with a bound
    predicate reads one folder."""
    triples.repartition("p").sortWithinPartitions("s", "o").write.mode("overwrite").partitionBy("p").parquet(path)
