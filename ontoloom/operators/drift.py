"""Schemas that drift from file to file of a stream of exported job records.

1. Each record gives the fields it has at the levels job, claim and proposal, and
   their JSON types; batches are folded before they are shuffled, so that a file
   is a few rows whatever its size.
2. Consecutive files are compared field by field.
3. Where a level has both lost and won fields, the values of just those fields
   are compared over the jobs that both files hold: equal values are a rename.
4. All types that a field has anywhere are folded through a promotion lattice (null
   < boolean; null < integer < number; all others, and any other mix, are text), and
   all records are cast to the union of all fields under the name each field had
   first. No cast loses a value: integers stay integers up to 64 bits, those beyond
   53 bits are never made floating, and what has no common type is kept as its
   JSON text.

Defined cases: lines that are no JSON object are no records; a file without any
valid record still exists, but has no fields; claims may be an array, an object
of claims, a single claim or a JSON string of these; a field whose values are all
null has no type and is never retyped; a repeated line counts once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

FILE = ["stream", "file_no"]


def load(record: object) -> dict | None:
    try:
        value = json.loads(record) if isinstance(record, str) else None
        value = json.loads(value) if isinstance(value, str) else value
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def unwrap(value: object) -> object:
    while isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except ValueError:
            return value
    return value


def claim_list(value: object) -> list[dict] | None:
    """The claims a value holds in whatever form, or None if it holds none."""
    value = unwrap(value)
    if isinstance(value, dict):
        if value and all(v is None or isinstance(v, dict) for v in value.values()):
            value = list(value.values())
        elif any("claim" in k or k == "source_quote" for k in value) and "id" in value:
            value = [value]
        else:
            return None
    if not isinstance(value, list) or not value:
        return None
    found = [c for c in map(unwrap, value) if isinstance(c, dict)]
    return found if found and max(map(len, found)) >= 3 else None


def claims_of(job: dict) -> tuple[str | None, list[dict]]:
    """The field that holds the claims, and the claims."""
    named = sorted((("claim" not in k, k) for k in job))
    for _, key in named:
        if key != "meta" and (claims := claim_list(job[key])):
            return key, claims
    return None, []


def proposal_of(claim: dict) -> tuple[str | None, dict | None]:
    for key in sorted(claim, key=lambda k: ("proposal" not in k, k)):
        value = unwrap(claim[key])
        if isinstance(value, dict) and ("proposal" in key and not key.endswith("_id") or "proposal_id" in value):
            return key, value
    return None, None


def json_type(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def narrow_type(value: object) -> str | None:
    """The JSON type, numbers by size: what a double holds exactly, what 64 bits
    hold, and what neither does."""
    if isinstance(value, int) and not isinstance(value, bool):
        return "integer" if abs(value) <= 2**53 else "long" if -(2**63) <= value < 2**63 else "huge"
    return json_type(value)


def levels(job: dict) -> Iterator[tuple[str, str, dict]]:
    """(level, key of the entity within its job, fields) of all entities."""
    yield "job", "", job
    _, claims = claims_of(job)
    for at, claim in enumerate(claims):
        key = str(claim.get("id", at))
        yield "claim", key, claim
        _, proposal = proposal_of(claim)
        if proposal is not None:
            yield "proposal", key, proposal


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: dict[tuple, int] = {}
        for stream, file_no, record in zip(batch["stream"], batch["file_no"], batch["record"]):
            seen[(stream, file_no, "", "", None)] = 1
            job = load(record)
            for level, _, fields in levels(job) if job is not None else ():
                for name, value in fields.items():
                    seen[stream, file_no, level, name, narrow_type(value)] = 1
        yield pd.DataFrame(list(seen), columns=[*FILE, "level", "field", "type"])


def file_schemas(exports: DataFrame) -> DataFrame:
    """(stream, file_no, level, field, type, types): the folded schema of each file;
    a row with an empty level stands for the file. ``types`` are all narrow types
    of its values, ``type`` names all their JSON types; null, where all are null."""
    rows = exports.where(F.col("stream").isNotNull() & F.col("file_no").isNotNull()).select(*FILE, "record")
    seen = rows.mapInPandas(_fields, "stream STRING, file_no INT, level STRING, field STRING, type STRING")
    json_types = F.array_sort(F.collect_set(F.when(F.col("type").isin("integer", "long", "huge"), "number").otherwise(F.col("type"))))
    folded = seen.groupBy(*FILE, "level", "field").agg(F.collect_set("type").alias("types"), F.nullif(F.array_join(json_types, "|"), F.lit("")).alias("type"))
    return written(folded)


def file_pairs(schemas: DataFrame) -> DataFrame:
    """(stream, file_no, before): each file and the existing one before it. The
    window runs over one row for each file, not over its records."""
    files = schemas.where(F.col("level") == "").select(*FILE)
    return files.withColumn("before", F.lag("file_no").over(Window.partitionBy("stream").orderBy("file_no"))).where(F.col("before").isNotNull())


def raw_changes(schemas: DataFrame) -> DataFrame:
    """(stream, file_no, before, level, field, change), renames still apart."""
    pairs, fields = file_pairs(schemas), schemas.where(F.col("level") != "")
    after = fields.join(pairs, FILE).select(*FILE, "before", "level", "field", F.lit(1).alias("has"), F.col("type").alias("new_type"))
    earlier = fields.withColumnRenamed("file_no", "before").join(pairs, ["stream", "before"]).select(*FILE, "before", "level", "field", F.lit(1).alias("had"), F.col("type").alias("old_type"))
    both = after.join(earlier, [*FILE, "before", "level", "field"], "full")
    change = (
        F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("new_type") != F.col("old_type"), "retyped")
    )
    return both.select(*FILE, "before", "level", "field", change.alias("change")).where(F.col("change").isNotNull())


def _value(level: str, name: str, value: object, fields: dict) -> str | None:
    """A value as it is compared; containers of claims and proposals by what
    they hold, as their inner fields may change as well."""
    if value is None:
        return None
    if level == "job" and name == claims_of(fields)[0]:
        return f"claims {len(claims_of(fields)[1])}"
    if level == "claim" and name == proposal_of(fields)[0]:
        return f"proposal {proposal_of(fields)[1].get('proposal_id')}"
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["stream", "file_no", "level", "job", "entity", "side", "field", "value"]
    for batch in batches:
        out = []
        for stream, record, wanted in zip(batch["stream"], batch["record"], batch["wanted"]):
            job = load(record)
            if job is None or job.get("job_id") is None:
                continue
            for level, entity, fields in levels(job):
                for w in wanted:
                    if w["level"] == level:
                        for name in w["fields"]:
                            if name in fields:
                                out.append((stream, w["file_no"], level, str(job["job_id"]), entity, w["change"], name, _value(level, name, fields[name], fields)))
        yield pd.DataFrame(out, columns=columns)


def renames(exports: DataFrame, changes: DataFrame) -> DataFrame:
    """(stream, file_no, level, field, new_field)."""
    sides = changes.where(F.col("change").isin("added", "removed")).groupBy(*FILE, "before", "level", "change").agg(F.collect_set("field").alias("fields"))
    both = sides.groupBy(*FILE, "before", "level").agg(F.count("*").alias("sides")).where(F.col("sides") == 2).drop("sides")
    sides = sides.join(both, [*FILE, "before", "level"])
    # The removed fields are looked up in the file before, the added ones in the file itself.
    wanted = (
        sides.withColumn("at", F.when(F.col("change") == "removed", F.col("before")).otherwise(F.col("file_no")))
        .groupBy("stream", "at").agg(F.collect_list(F.struct("file_no", "level", "change", "fields")).alias("wanted"))
    )
    rows = exports.select("stream", F.col("file_no").alias("at"), "record").join(wanted, ["stream", "at"]).select("stream", "record", "wanted")
    cells = rows.mapInPandas(_cells, "stream STRING, file_no INT, level STRING, job STRING, entity STRING, side STRING, field STRING, value STRING").distinct()
    key = [*FILE, "level", "job", "entity"]
    old = cells.where(F.col("side") == "removed").select(*key, "field", "value")
    new = cells.where(F.col("side") == "added").select(*key, F.col("field").alias("new_field"), F.col("value").alias("new_value"))
    same = F.count_if((F.col("value") == F.col("new_value")) & F.col("value").isNotNull())
    apart = F.count_if(~F.col("value").eqNullSafe(F.col("new_value")))
    scored = old.join(new, key).groupBy(*FILE, "level", "field", "new_field").agg(same.alias("same"), apart.alias("apart"))
    scored = scored.where((F.col("same") > 0) & (F.col("apart") == 0))
    closeness = F.levenshtein(F.lower("field"), F.lower("new_field"))
    by_old = Window.partitionBy(*FILE, "level", "field").orderBy(F.desc("same"), closeness, "new_field")
    by_new = Window.partitionBy(*FILE, "level", "new_field").orderBy(F.desc("same"), closeness, "field")
    return scored.withColumns({"i": F.row_number().over(by_old), "j": F.row_number().over(by_new)}).where("i = 1 and j = 1").select(*FILE, "level", "field", "new_field")


def drift(exports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schemas, changes, renames) of all files of all streams."""
    schemas = file_schemas(exports)
    raw = written(raw_changes(schemas))
    renamed = written(renames(exports, raw))
    gone = renamed.select(*FILE, "level", "field", F.lit("removed").alias("change"))
    come = renamed.select(*FILE, "level", F.col("new_field").alias("field"), F.lit("added").alias("change"))
    kept = raw.drop("before").join(gone.unionAll(come), [*FILE, "level", "field", "change"], "left_anti")
    changes = kept.select(*FILE, "level", "field", "change").unionAll(renamed.select(*FILE, "level", "field", F.lit("renamed").alias("change")))
    return schemas, changes, renamed


# ---------------------------------------------------------------- one table

#: From the narrowest: what a kind of column holds without loss.
LATTICE = [("BOOLEAN", {"boolean"}), ("BIGINT", {"integer", "long"}), ("DOUBLE", {"integer", "number"})]


def promote(types: set[str]) -> str:
    """The least kind of the lattice that holds all of the types; the top is text."""
    return next((kind for kind, held in LATTICE if types <= held), "STRING")


def first_names(renamed: DataFrame) -> DataFrame:
    """(stream, since, level, field, first): the name a field had before all its
    renames, valid from file ``since``. Each rename points to the one before it;
    pointers are doubled until none is left, over the renames alone."""
    key = ["stream", "since", "level", "field"]
    steps = renamed.select("stream", F.col("file_no").alias("since"), "level", F.col("new_field").alias("field"), F.col("field").alias("first"))
    back = steps.select("stream", "level", F.col("field").alias("first"), F.col("since").alias("at"))
    names = written(steps.join(back, ["stream", "level", "first"], "left").groupBy(*key, "first").agg(F.max(F.when(F.col("at") < F.col("since"), F.col("at"))).alias("at")))
    while not names.where("at is not null").isEmpty():
        onward = names.select("stream", "level", F.col("since").alias("at"), F.col("field").alias("first"), F.col("first").alias("older"), F.col("at").alias("further"))
        names = written(names.join(onward, ["stream", "level", "at", "first"], "left").select(*key, F.coalesce("older", "first").alias("first"), F.col("further").alias("at")))
    return names.drop("at")


def _cast(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind == "DOUBLE":
        return float(value)
    if kind in ("BOOLEAN", "BIGINT"):
        return value
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


def unified(exports: DataFrame, max_columns: int = 5000) -> DataFrame:
    """One row for each claim of each job of each file (one without claim fields
    for a job that has none), under the union of all fields. The driver sees the
    names and types of the columns only, at most ``max_columns``."""
    schemas, _, renamed = drift(exports)
    names = first_names(renamed)
    at = schemas.where(F.col("level") != "").join(names, ["stream", "level", "field"], "left")
    first = F.max_by("first", F.when(F.col("since") <= F.col("file_no"), F.col("since")))
    named = at.groupBy(*FILE, "level", "field").agg(F.coalesce(first, F.col("field")).alias("name"), F.first("types").alias("types"))
    # A new field under a name that a renamed one still bears takes a column of its own.
    turn = F.row_number().over(Window.partitionBy(*FILE, "level", "name").orderBy(F.col("name") == F.col("field"), "field"))
    named = named.withColumn("turn", turn).withColumn("name", F.when(F.col("turn") > 1, F.concat_ws("__", "name", F.col("turn").cast("string"))).otherwise(F.col("name")))
    typed = named.select("level", "name", F.explode("types").alias("type")).groupBy("level", "name").agg(F.collect_set("type").alias("types")).limit(max_columns + 1).collect()
    if len(typed) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    kinds = {(r["level"], r["name"]): promote(set(r["types"])) for r in typed if (r["level"], r["name"]) != ("claim", "proposal")}
    order = {"job": 0, "claim": 1, "proposal": 2}
    columns = sorted(kinds, key=lambda k: (order[k[0]], k[1]))
    schema = "stream STRING, file_no INT, claim_pos INT, " + ", ".join(f"`{level}_{name}` {kinds[level, name]}" for level, name in columns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream, file_no, record, mapping in zip(batch["stream"], batch["file_no"], batch["record"], batch["mapping"]):
                job = load(record)
                if job is None:
                    continue
                to = {(m["level"], m["field"]): m["name"] for m in mapping if m is not None} if mapping is not None else {}
                rename = lambda level, fields: {(level, to.get((level, k), k)): v for k, v in fields.items()}  # noqa: E731, B023
                held, claims = claims_of(job)
                head = rename("job", {k: v for k, v in job.items() if k != held})
                for pos, claim in enumerate(claims or [None]):
                    cells = dict(head)
                    if claim is not None:
                        key, proposal = proposal_of(claim)
                        cells |= rename("claim", {k: v for k, v in claim.items() if k != key}) | rename("proposal", proposal or {})
                    out.append((stream, file_no, pos if claim is not None else -1, *(_cast(cells.get(c), kinds[c]) for c in columns)))
            frame = pd.DataFrame(out, columns=["stream", "file_no", "claim_pos", *(f"{a}_{b}" for a, b in columns)], dtype=object)
            yield frame

    mapping = named.where(F.col("name") != F.col("field")).groupBy(*FILE).agg(F.collect_list(F.struct("level", "field", "name")).alias("mapping"))
    lines = exports.where(F.col("stream").isNotNull() & F.col("file_no").isNotNull()).select(*FILE, "record").dropDuplicates().join(mapping, FILE, "left")
    return lines.mapInPandas(rows, schema)
