"""Nested proposals as flat related tables, with Merkle subtree identities.

A payload is decoded once and every object of it is canonicalised and hashed once,
bottom-up: an object's hash covers its own fields and the hashes of what it holds,
so two objects have one identity exactly if their subtrees are equal. ``objects``
stores each identity once; ``bridge`` keeps every occurrence: the place (event,
path, ordinals) of each object at any depth, and the place and identity of the
object that holds it. ``flat`` gives the five tables of a proposal.

Defined cases: a null element is no record but keeps its ordinal; a single value
in place of an array is an array of one; a value encoded as a JSON string counts
as what it encodes, the payload itself included; a payload may hold several
proposals, which ``proposal_pos`` counts; a payload that is no JSON object (or is
nested beyond what the parser takes), or has no proposal, has no children; rows
repeated with the same event_id count once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILDREN = ("entities", "relations", "open_questions")
#: The arrays that become tables of their own, by the table that holds them.
TABLES = {"proposals": frozenset(CHILDREN), "entities": frozenset(("possible_relations",))}
PLACE = ["child", "proposal_pos", "pos", "sub_pos", "path", "parent_path", "parent", "node", "content"]
OCCURRENCE = "event_id BIGINT, child STRING, proposal_pos INT, pos INT, sub_pos INT, path STRING, parent_path STRING, parent STRING, node STRING, content STRING"


def decode(value: object) -> object:
    """What a JSON string encodes, as long as it encodes something."""
    while isinstance(value, str):
        head = value.strip()
        if not (head[:1] in ("{", "[", '"') or head == "null"):
            return value
        try:
            value = json.loads(head)
        except (ValueError, RecursionError):
            return value
    return value


def decoded(value: object) -> object:
    """A value with all that is encoded in it decoded."""
    value = decode(value)
    if isinstance(value, dict):
        return {k: decoded(v) for k, v in value.items()}
    return [decoded(v) for v in value] if isinstance(value, list) else value


def elements(value: object) -> list[tuple[int, object]]:
    """The records of an array with their places."""
    items = value if isinstance(value, list) else [value]
    return [(i, e) for i, e in enumerate(items) if e is not None]


def hashed(value: object, known: dict[int, str]) -> str:
    """The Merkle hash of a decoded subtree; ``known`` takes that of every container
    in it. The order of an object's keys is no part of it."""
    if isinstance(value, dict):
        body = "o" + "".join(f"{json.dumps(k)}:{hashed(v, known)};" for k, v in sorted(value.items()))
    elif isinstance(value, list):
        body = "a" + "".join(f"{hashed(v, known)};" for v in value)
    else:
        return hashlib.sha256(("s" + json.dumps(value, ensure_ascii=False)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    known[id(value)] = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()[:32]
    return known[id(value)]


def identity(value: object) -> str:
    """The Merkle hash of a value."""
    return hashed(decoded(value), {})


def linked(value: object, known: dict[int, str]) -> object:
    """A value in which objects are replaced by links to their identities."""
    if isinstance(value, dict):
        return {"$node": known[id(value)]}
    return [linked(v, known) for v in value] if isinstance(value, list) else value


def walk(payload: object, links: bool = False) -> Iterator[tuple]:
    """The rows of PLACE, parents first. The content of a record leaves its child
    tables out; with ``links`` the objects in it too are links."""
    body = decoded(payload)
    if not isinstance(body, dict) or body.get("proposal") is None:
        return
    known: dict[int, str] = {}
    hashed(body["proposal"], known)

    def inner(value: object, child: str, place: tuple, path: str, held: tuple) -> Iterator[tuple]:
        """The objects within a field that is no table."""
        if isinstance(value, dict):
            yield from record(value, child, place, path, held)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from inner(v, child, place, f"{path}[{i}]", held)

    def record(value: object, child: str, place: tuple, path: str, held: tuple) -> Iterator[tuple]:
        node = known.get(id(value)) or hashed(value, {})
        own, tables = value, TABLES.get(child, frozenset())
        if isinstance(value, dict):
            own = {k: linked(v, known) if links else v for k, v in value.items() if k not in tables}
        elif links:
            own = linked(value, known)
        yield (child, *place, path, *held, node, json.dumps(own, ensure_ascii=False, sort_keys=True))
        for name, field in value.items() if isinstance(value, dict) else ():
            at = f"{path}.{name}"
            if name not in tables:
                yield from inner(field, f"{child}.{name}", place, at, (path, node))
            elif field is not None:
                for i, element in elements(field):
                    spot = (place[0], place[1], i) if child == "entities" else (place[0], i, -1)
                    yield from record(element, name, spot, f"{at}[{i}]", (path, node))

    for at, proposal in elements(body["proposal"]):
        if isinstance(proposal, dict):
            yield from record(proposal, "proposals", (at, at, -1), f"proposal[{at}]", ("", ""))


def _walk(links: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(event, *row) for event, payload in zip(batch["event_id"], batch["payload"]) for row in walk(payload, links)]
            yield pd.DataFrame(rows, columns=["event_id", *PLACE])

    return run


def occurrences(session_log: DataFrame, links: bool = False) -> DataFrame:
    """One row for each object at each place, with its content."""
    rows = session_log.where((F.col("event_type") == "propose") & F.col("event_id").isNotNull()).select("event_id", "payload")
    return rows.mapInPandas(_walk(links), OCCURRENCE)


def bridge(session_log: DataFrame) -> DataFrame:
    """(event_id, path, child, proposal_pos, pos, sub_pos, parent_path, parent, node),
    each place once. Objects below the tables have the place of the record that
    holds them and a dotted ``child``."""
    rest = ["child", "proposal_pos", "pos", "sub_pos", "parent_path", "parent", "node"]
    one = occurrences(session_log).groupBy("event_id", "path").agg(F.min(F.struct(*rest)).alias("o"))
    return one.select("event_id", "path", *[F.col(f"o.{c}").alias(c) for c in rest])


def children(session_log: DataFrame) -> DataFrame:
    """(event_id, child, pos, sub_pos) of the child records of all proposals."""
    kinds = [*CHILDREN, "possible_relations"]
    return occurrences(session_log).where(F.col("child").isin(*kinds)).select("event_id", "child", "pos", "sub_pos").distinct()


def objects(session_log: DataFrame) -> DataFrame:
    """(node, content, kinds, places): each identical object once, with links to the
    objects in it, the kinds it occurs as and the number of its places."""
    rows = occurrences(session_log, links=True)
    once = rows.groupBy("event_id", "path").agg(F.min(F.struct("node", "child", "content")).alias("o"))
    kinds = F.array_join(F.array_sort(F.collect_set("o.child")), ",")
    return once.groupBy(F.col("o.node").alias("node")).agg(F.min("o.content").alias("content"), kinds.alias("kinds"), F.count("*").alias("places"))


# The fields of each flat table.
FIELDS = {
    "proposals": "proposal_id session_id utterance rationale_summary reasoner_verdict gate_outcome gate_tier",
    "entities": "label iri_suggestion bfo_type bfo_label kind parent_class rationale is_new existing_iri definition definition_status recognition_locus source_span distinct_from illustrative",
    "relations": "s p o rationale quantifier",
    "possible_relations": "s p o rationale quantifier",
}


def _rest(names: list[str]) -> object:
    @F.pandas_udf("string")
    def rest(content: pd.Series) -> pd.Series:
        def other(text: str) -> str | None:
            value = json.loads(text)
            if isinstance(value, dict):
                value = {k: v for k, v in value.items() if k not in names}
                if not value:
                    return None
            return json.dumps(value, ensure_ascii=False, sort_keys=True)

        return content.map(other)

    return rest


def flat(session_log: DataFrame, child: str) -> DataFrame:
    """The flat table of one kind: its place, its parent's identity (whose key is the
    event and ``proposal_pos``, for possible relations ``pos`` as well), its fields,
    and as ``rest`` the JSON of what has no column: the other fields of an object, or
    the whole of a record that is none."""
    keys = ["event_id", "proposal_pos", "pos", "sub_pos"]
    one = occurrences(session_log).where(F.col("child") == child).groupBy(*keys).agg(F.min(F.struct("parent", "node", "content")).alias("o"))
    rows = one.select(*keys, "o.parent", "o.node", "o.content")
    keys += ["parent", "node"]
    if child == "open_questions":
        text = F.when(F.col("content").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "content", F.lit("}")), "$.v")).otherwise(F.col("content"))
        return rows.select(*keys, text.alias("question"))
    names = FIELDS[child].split()
    return rows.select(*keys, F.json_tuple("content", *names).alias(*names), _rest(names)("content").alias("rest"))
