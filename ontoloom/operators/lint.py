"""The gate's rules over proposals as they are logged.

``entities(pid, pos, label, iri, bfo_type, parent_class, kind, is_new, existing_iri,
definition, definition_status, source_span, distinct_from, locus)`` and
``relations(pid, pos, s, p, o, quantifier)``. Each rule gives rows (pid, tier, code,
subject); what a rule records of the source rather than rejects has the tier
``finding``. Catalogues are broadcast; everything else meets by proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key
from . import catalog

# Name patterns of the construction rules.
PRIVATION = r"^(?:AbsenceOf|Absence|Lack|Loss|Missing|Failure|Broken|Invalid|Invalidity|Degraded|Collapsed|Residual|Partial)|^(?:No|Non|Un)[A-Z]"
CONNECTIVES = ["With", "For"]
RELATIONAL = ["Relation", "Dependency", "Alignment", "Grounding", "Support"]
META_LABEL = r"(?i)\((?:reuse|instance|class|example[^)]*)\)|^example\b"
ANTIPATTERN = r"(?:^|[#/:\s(])(?:AbsenceOf|Absence|Lack|Loss|Missing|Non|Un|Failure|Broken|Invalid|Degraded|Collapsed|Residual|Partial)[A-Z][A-Za-z]*"
CONSTRUCTS = r"complementOf|unionOf|intersectionOf|someValuesFrom|allValuesFrom"
RESIDUAL = ["other specified", "otherspecified", "unspecified", "not otherwise specified", "nototherwisespecified", "nos", "unclassified", "unclassifiable", "residual", "other disorders of", "otherdisordersof"]
CHAIN_NAMES = ["authority", "criteria", "criterion", "assessor", "recognitionact", "recognitionchain", "remedy", "presentingfacts", "sourceofauthority"]
EXCLUSION, INCLUSION = r"exclusion|excludes|notincluded|not included", r"inclusion|includes|criterion|criteria"
ANNOTATION = r"rdfs:(?:comment|label|seeAlso)|IAO_0000115|skos:|#comment$|#label$"
REASONER_ONLY = r"equivalentClass|disjointWith|complementOf"
UPPER_ID = r"^(?:BFO|RO|IAO)_\d+$"
#: A class expression in place of a name.
TERM = r"(?:https?://[^\s()]+|[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?)"
NOT_SOME = rf"^(?:not|(?:owl:)?complementOf)\s*\(\s*({TERM})\s+some\s+({TERM})\s*\)$"
NOT = rf"^(?:not|(?:owl:)?complementOf)\s+({TERM})$"
SOME = rf"^(?:_:\S+\s+)?({TERM})\s+(?:some\s+)?({TERM})$"
MOST_NAME_WORDS = 5


def expression(text: Column) -> Column:
    """EXPR-1: a class expression as (op, prop, cls): ``not_some``, ``not`` or ``some``;
    null for anything else."""
    t = F.trim(text)
    made = lambda op, prop, cls: F.struct(F.lit(op).alias("op"), prop.cast("string").alias("prop"), cls.alias("cls"))
    some = (t.startswith("_:") | t.rlike(r"\s+some\s+")) & t.rlike(SOME)
    return (
        F.when(t.rlike(NOT_SOME), made("not_some", F.regexp_extract(t, NOT_SOME, 1), F.regexp_extract(t, NOT_SOME, 2)))
        .when(t.rlike(NOT), made("not", F.lit(None), F.regexp_extract(t, NOT, 1)))
        .when(some, made("some", F.regexp_extract(t, SOME, 1), F.regexp_extract(t, SOME, 2)))
    )


def slug(name: Column) -> Column:
    """NORM-13: a label as one name; null if it is not label-like."""
    t = F.trim(name)
    words = F.split(t, r"\s+")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), r"[^A-Za-z0-9_.\-]", ""))), "")
    label_like = F.forall(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9'’\-]*$"))
    return F.when(t.rlike(r"^[A-Za-z_][\w.\-]*$"), t).when(label_like, joined)


def sentence_slot(text: Column) -> Column:
    """LEX-8: whether a slot holds free text in place of a name."""
    t = F.trim(text)
    name = F.when(t.rlike(r"^[A-Za-z]\w*:\S"), F.regexp_replace(t, "^[^:]*:", "")).otherwise(t)
    short = (F.size(F.split(F.trim(name), r"\s+")) <= MOST_NAME_WORDS) & slug(name).isNotNull()
    return F.coalesce(t.rlike(r"\s") & expression(t).isNull() & ~short, F.lit(False))


def local(ref: Column) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(ref, "#", -1), "/", -1), ":", -1)


def new_class() -> Column:
    return F.coalesce((F.col("kind") == "class") & F.col("is_new") & (F.coalesce("existing_iri", F.lit("")) == ""), F.lit(False))


def named(entities: DataFrame) -> DataFrame:
    """Entities with their name, the upper class of their type and of their parent."""
    iri = F.coalesce(F.nullif("iri", F.lit("")), F.col("label"))
    return entities.withColumns({"name": local(iri), "anchor": catalog.fragment(F.coalesce("bfo_type", F.lit(""))), "parent": catalog.fragment(F.coalesce("parent_class", F.lit("")))})


def rule(rows: DataFrame, code: str, subject: str, tier: str = "construction") -> DataFrame:
    return rows.select("pid", F.lit(tier).alias("tier"), F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.distinct()


def naming(entities: DataFrame) -> DataFrame:
    """PC-1, 2, 17: privations, relations and compounds as names of new classes; meta labels."""
    tokens = F.regexp_extract_all("name", F.lit("[A-Z][a-z0-9]*"), F.lit(0))
    relational = F.lit(False)
    for noun in RELATIONAL:
        relational = relational | (F.col("name").endswith(noun) & (F.col("name") != noun))
    new = named(entities).where(new_class())
    compound = F.arrays_overlap(tokens, F.array(*map(F.lit, CONNECTIVES))) | relational | (F.size(tokens) >= 4)
    return union(rule(new.where(F.col("name").rlike(PRIVATION)), "PC-1", "name"), rule(new.where(compound), "PC-2", "name"), rule(entities.where(F.col("label").rlike(META_LABEL)), "PC-17", "label"))


def typing(entities: DataFrame, relations: DataFrame, strict: bool = False) -> DataFrame:
    """PC-3, 4, 5, 6: entities without an upper class, new classes where the vocabulary is
    closed, predicates and parents that are none, continuants that occur."""
    spark = entities.sparkSession
    known = [f for f, _, _ in catalog.UPPER]
    properties = [catalog.property_name(n) for n in catalog.KERNEL_PROPERTIES]
    no_class = lambda c: (c != "") & (c.isin(*properties) | (c.rlike(UPPER_ID) & ~c.isin(*known)))
    rows = named(entities)
    untyped = rows.where((F.coalesce("existing_iri", F.lit("")) == "") & ~F.col("anchor").isin(*known) & ~F.col("parent").isin(*known))
    sides = F.broadcast(catalog.ancestors(spark).where(F.col("ancestor").isin("BFO_0000002", "BFO_0000003")).select("fragment", F.col("ancestor").alias("side")))
    both = rows.select("pid", "pos", "name", F.explode(F.array("anchor", "parent")).alias("fragment")).join(sides, "fragment")
    both = both.groupBy("pid", "pos", "name").agg(F.count_distinct("side").alias("n")).where("n = 2")
    p, o = F.coalesce("p", F.lit("")), F.coalesce("o", F.lit(""))
    meta = p.isin("a", "owl:disjointWith", "rdf:type", "rdfs:subClassOf") | F.substring_index(p, "#", -1).isin("type", "subClassOf", "disjointWith")
    invented = relations.where(~meta & ~catalog.fragment(p).isin(*properties))
    target = F.coalesce(expression(o)["cls"], o)
    bad_target = relations.where((p.contains("subClassOf") | p.contains("type")) & no_class(catalog.fragment(target))).withColumn("subject", local("s"))
    parts = [rule(untyped, "PC-3", "name"), rule(both, "PC-6", "name"), rule(invented, "PC-5", "p"), rule(bad_target, "PC-5", "subject"), rule(rows.where(no_class(F.col("parent"))), "PC-5", "name")]
    if strict:
        parts.append(rule(rows.where(new_class()), "PC-4", "name"))
    return union(*parts)


def lexical(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """PC-7, 8, 18: expressions and privations within names, sentences in slots."""
    iris = entities.select("pid", F.explode(F.array("iri", "existing_iri")).alias("iri")).unionAll(relations.select("pid", F.explode(F.array("s", "p", "o")).alias("iri"))).where("iri <> ''")
    fragment = F.when(F.col("iri").contains("#"), F.regexp_extract("iri", "#(.*)$", 1)).otherwise(F.lit(""))
    baked = F.col("iri").rlike(r"[\[\]]|\band\b.*\(|\bnot \(| some | only ") | fragment.rlike(CONSTRUCTS) | (fragment.contains(":") & ~fragment.startswith("_:"))
    slots = relations.where(~F.coalesce("p", F.lit("")).rlike(ANNOTATION)).select("pid", F.explode(F.array("s", "p", "o")).alias("iri")).where(sentence_slot(F.col("iri"))).withColumn("text", F.substring("iri", 1, 120))
    return union(rule(iris.where(baked), "PC-7", "iri"), rule(iris.where(F.col("iri").rlike(ANTIPATTERN)), "PC-8", "iri"), rule(slots, "PC-18", "text"))


def chain_rules(entities: DataFrame) -> DataFrame:
    """PC-9, 10, 12: a link whose anchor does not fit, residual categories (a finding),
    links of the chain minted as classes."""
    spark = entities.sparkSession
    rows = named(entities)
    fits = F.broadcast(catalog.admissible(spark).select("locus", F.col("fragment").alias("anchor")))
    placed = rows.where((F.col("locus") != "none") & (F.col("locus") != "") & (F.col("anchor") != ""))
    words = F.lower(F.concat_ws(" ", "label", "name"))
    squashed = F.regexp_replace(words, r"[ _\-]", "")
    residual = F.lit(False)
    for mark in RESIDUAL:
        residual = residual | words.contains(mark) | squashed.contains(mark.replace(" ", ""))
    tokens = F.regexp_extract_all("name", F.lit("[A-Z][a-z0-9]*"), F.lit(0))
    joined = F.lower(F.when(F.size(tokens) > 0, F.array_join(tokens, "")).otherwise(F.col("name")))
    return union(
        rule(placed.join(fits, ["locus", "anchor"], "left_anti"), "PC-9", "name"), rule(rows.where(residual), "PC-10", "name", "finding"),
        rule(rows.where(new_class() & joined.isin(*CHAIN_NAMES)), "PC-12", "name"),
    )


def source_rules(relations: DataFrame) -> DataFrame:
    """PC-11, 13: one pair included and excluded; siblings of which no two are disjoint.
    A sibling set is counted, not paired: no disjoint pair within it is what counts."""
    p = F.lower(local(F.coalesce("p", F.lit(""))))
    rows = relations.select("pid", local("s").alias("s"), p.alias("p"), local("o").alias("o")).where("s <> '' and o <> ''")
    role = F.when(F.col("p").rlike(EXCLUSION), "x").when(F.col("p").rlike(INCLUSION), "i")
    duty = rows.withColumn("role", role).groupBy("pid", "s", "o").agg(F.count_distinct("role").alias("n")).where("n = 2").withColumn("pair", F.concat_ws(" ", "s", "o"))
    held = rows.where(F.col("p").isin("subclassof", "is_a", "isa")).select("pid", F.col("o").alias("parent"), "s").distinct()
    apart = rows.where(F.col("p").contains("disjoint")).select("pid", "s", F.col("o").alias("t")).where("s <> t")
    split = held.join(apart, ["pid", "s"]).join(held.select("pid", "parent", F.col("s").alias("t")), ["pid", "parent", "t"]).select("pid", "parent").distinct()
    large = held.groupBy("pid", "parent").agg(F.count("*").alias("n")).where("n > 1").join(split, ["pid", "parent"], "left_anti")
    return union(rule(duty, "PC-11", "pair", "finding"), rule(large, "PC-13", "parent", "finding"))


def defining(entities: DataFrame, faithful: bool = False) -> DataFrame:
    """PC-14: a new class has a definition that names its genus, or says that the
    source has none; in faithful mode it shows the span it is drawn from."""
    rows = named(entities).where(new_class())
    text = F.trim(F.coalesce("definition", F.lit("")))
    labels = entities.select("pid", F.explode(F.array("iri", "existing_iri")).alias("ref"), F.col("label").alias("genus")).where("ref <> ''").groupBy("pid", "ref").agg(F.min("genus").alias("genus"))
    upper = F.broadcast(catalog.upper(entities.sparkSession).select(F.col("fragment").alias("upper"), F.col("label").alias("upper_label")))
    ref = F.coalesce(F.nullif("parent_class", F.lit("")), "bfo_type")
    joined = rows.withColumn("ref", ref).withColumn("upper", catalog.fragment(ref)).join(labels, ["pid", "ref"], "left").join(upper, "upper", "left")
    genus = F.coalesce("genus", "upper_label")
    key = F.array_remove(F.split(label_key(genus), " "), "")
    says = F.lower(text).contains(F.lower(genus)) | ((F.size(key) > 0) & (F.size(F.array_except(key, F.split(label_key(text), " "))) == 0))
    absent = F.coalesce(F.col("definition_status") == "absent-in-source", F.lit(False))
    parts = [rule(joined.where((text == "") & ~absent), "PC-14 missing", "label"), rule(joined.where((text != "") & genus.isNotNull() & ~says), "PC-14 genus", "label")]
    if faithful:
        parts.append(rule(joined.where((text != "") & (F.trim(F.coalesce("source_span", F.lit(""))) == "")), "PC-14 span", "label"))
    return union(*parts)


def reuse(entities: DataFrame, existing: DataFrame) -> DataFrame:
    """PC-15, 16: a new class whose key ``existing(label, canonical)`` has must reuse it,
    unless it is told apart with a span (never from a canonical one); one key in two
    categories without a span for each (a finding)."""
    rows = entities.where(new_class()).withColumn("key", label_key(F.col("label"))).where("key <> ''")
    held = existing.select(label_key(F.col("label")).alias("key"), "canonical").where("key <> ''").groupBy("key").agg(F.bool_or("canonical").alias("canonical"))
    spanned = F.trim(F.coalesce("source_span", F.lit(""))) != ""
    told = (F.trim(F.coalesce("distinct_from", F.lit(""))) != "") & spanned
    hits = rows.join(held, "key").where(F.col("canonical") | ~told)
    triads = rows.groupBy("pid", "key").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("bfo_type", F.lit(""))).alias("kinds"), F.bool_and(spanned).alias("all"))
    return union(rule(hits, "PC-15", "label"), rule(triads.where("n > 1 and kinds > 1 and not all"), "PC-16", "key", "finding"))


def anchored(entities: DataFrame) -> DataFrame:
    """(pid, ref, anchor): the upper class that each name of a proposal is anchored to."""
    rows = named(entities)
    known = [f for f, _, _ in catalog.UPPER]
    both = rows.select("pid", F.explode(F.array("iri", "existing_iri", "label")).alias("ref"), F.explode_outer(F.array_distinct(F.array("anchor", "parent"))).alias("anchor"))
    return both.where((F.col("ref") != "") & F.col("anchor").isin(*known)).distinct()


def straddling(entities: DataFrame) -> DataFrame:
    """GS-1: names under two clashing upper classes."""
    refs = anchored(entities).select(F.concat_ws("\x01", "pid", "ref").alias("class"), F.col("anchor").alias("fragment"))
    found = catalog.first_clash(refs, entities.sparkSession)
    return found.select(F.substring_index("class", "\x01", 1).alias("pid"), F.lit("lint").alias("tier"), F.lit("GS-1").alias("code"), F.substring_index("class", "\x01", -1).alias("subject"))


def signed(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """GS-2: relations of which an end clashes, in all its anchors, with the signature."""
    spark = entities.sparkSession
    plain = relations.where(~F.coalesce("o", F.lit("")).startswith("_:") & expression(F.col("o")).isNull()).withColumn("rel", catalog.fragment(F.col("p")))
    typed = plain.join(F.broadcast(catalog.signatures(spark).withColumnRenamed("p", "rel").drop("label")), "rel")
    clash = F.broadcast(catalog.clashes(spark).select(F.col("a").alias("anchor"), F.col("b").alias("wanted"), F.lit(True).alias("bad")))
    ends = typed.select("pid", "pos", F.inline(F.array(F.struct(F.lit("domain").alias("slot"), F.col("s").alias("ref"), F.col("domain").alias("wanted")), F.struct(F.lit("range").alias("slot"), F.col("o").alias("ref"), F.col("range").alias("wanted"))))).where("wanted is not null")
    met = ends.join(anchored(entities), ["pid", "ref"]).join(clash, ["anchor", "wanted"], "left")
    every = met.groupBy("pid", "pos", "slot", "ref").agg(F.bool_and(F.coalesce("bad", F.lit(False))).alias("every")).where("every").withColumn("name", local("ref"))
    return rule(every, "GS-2", "name", "lint").distinct()


def bearing(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """GS-3: what is itself dependent bears a realizable; a relation of bearing whose
    filler is another kind of realizable."""
    spark = entities.sparkSession
    wanted = F.broadcast(spark.createDataFrame(catalog.BEARING, "rel STRING, wanted STRING"))
    rows = relations.withColumn("rel", catalog.fragment(F.col("p"))).join(wanted, "rel").where(~F.coalesce("o", F.lit("")).startswith("_:") & expression(F.col("o")).isNull())
    refs, up = anchored(entities), F.broadcast(catalog.ancestors(spark).select(F.col("fragment").alias("anchor"), "ancestor"))
    under = refs.join(up, "anchor").groupBy("pid", "ref", "anchor").agg(F.bool_or(F.col("ancestor") == "BFO_0000020").alias("dependent"))
    bears = rows.join(under.withColumnRenamed("ref", "s"), ["pid", "s"]).groupBy("pid", "pos", "s").agg(F.bool_and("dependent").alias("every")).where("every").withColumn("name", local("s"))
    kinds = refs.join(up, "anchor").where(F.col("ancestor").isin(*[k for _, k in catalog.BEARING])).select("pid", F.col("ref").alias("o"), F.col("ancestor").alias("kind"))
    clash = F.broadcast(catalog.clashes(spark).select(F.col("a").alias("wanted"), F.col("b").alias("kind")))
    wrong = rows.join(kinds, ["pid", "o"]).join(clash, ["wanted", "kind"]).withColumn("name", local("o"))
    return union(rule(bears, "GS-3", "name", "lint"), rule(wrong, "GS-3", "name", "lint"))


def needs_reasoner(proposals: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """GS-4: (pid, needed, why): expressions, equivalence and disjointness, and names
    that are anchored nowhere, are left to a reasoner; never accepted here."""
    known = anchored(entities).select("pid", "ref").distinct().withColumn("known", F.lit(True))
    o = F.coalesce("o", F.lit(""))
    hard = relations.withColumn("hard", o.startswith("_:") | expression(F.col("o")).isNotNull() | F.coalesce("p", F.lit("")).rlike(REASONER_ONLY))
    ends = hard.select("pid", F.explode(F.array("s", "o")).alias("ref")).where("ref is not null")
    upper = catalog.fragment(F.col("ref")).isin(*[f for f, _, _ in catalog.UPPER])
    loose = ends.where(~upper).join(known, ["pid", "ref"], "left_anti").select("pid", F.lit("unresolved").alias("why"))
    reasons = hard.where("hard").select("pid", F.lit("expression").alias("why")).unionAll(loose).groupBy("pid").agg(F.min("why").alias("why"))
    return proposals.select("pid").distinct().join(reasons, "pid", "left").select("pid", F.col("why").isNotNull().alias("needed"), "why")


# The constraint that a class under an upper class is to carry.
SCAFFOLDS = [("BFO_0000019", "quality", "BFO_0000197"), ("BFO_0000023", "role", "BFO_0000054"), ("BFO_0000034", "function", "BFO_0000054"), ("BFO_0000016", "disposition", "BFO_0000054")]


def scaffolds(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """SCF-1: (pid, name, kind, prop, filler): the constraint that a class's category
    requires, where the proposal relates it to a filler that is no upper class."""
    spark = entities.sparkSession
    order = spark.createDataFrame([(f, k, p, i) for i, (f, k, p) in enumerate(SCAFFOLDS)], "ancestor STRING, kind STRING, prop STRING, ordinal INT")
    wanted = F.broadcast(catalog.ancestors(spark).join(order, "ancestor").select(F.col("fragment").alias("anchor"), F.col("kind").alias("category"), "prop", "ordinal"))
    first = named(entities).where("kind = 'class'").join(wanted, "anchor").groupBy("pid", "name").agg(F.min(F.struct("ordinal", "category", "prop")).alias("w"))
    known = [f for f, _, _ in catalog.UPPER]
    held = relations.select("pid", local("s").alias("name"), catalog.fragment(F.col("p")).alias("prop"), F.col("o").alias("filler")).where(~catalog.fragment(F.col("filler")).isin(*known) & (F.col("filler") != ""))
    held = held.groupBy("pid", "name", "prop").agg(F.min("filler").alias("filler"))
    return first.select("pid", "name", F.col("w.category").alias("kind"), F.col("w.prop").alias("prop")).join(held, ["pid", "name", "prop"]).select("pid", "name", "kind", "prop", "filler")


# ---------------------------------------------------------------- legal drafting

# Relations on the bearer's side and of inherence, and words of possibility.
BEARER_SIDE, INHERES = ["BFO_0000196", "RO_0000087", "RO_0000091", "RO_0000085", "RO_0000053"], ["BFO_0000197", "RO_0000052"]
MODAL = r"(?i)\b(?:may|might|can|could|should|is able to|are able to)\b"
UNIVERSAL = ["every", "all", "each", "universal"]
MODAL_QUANTIFIERS = ["some", "may", "possibly", "modal"]


def drafting(claims: DataFrame, edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """LD-1..5: (pid, check, subject) of ``claims(pid, subject, clause, act_id, verified,
    quantifier, modality, context)``, class-level ``edges(pid, pos, s, p, q, o)`` and
    ``kinds(pid, ref, independent, dependent)``: unverified quotes, definitions of no
    act, universal edges from a modal claim (which wins over bearers), bearers said to
    be universal, and dependent classes in several bearers."""
    quantifier, clause = F.lower(F.coalesce("quantifier", F.lit(""))), F.coalesce("clause", F.lit(""))
    modality = F.coalesce(F.nullif(F.lower("modality"), F.lit("")), F.when(F.coalesce("context", F.lit("")).rlike(MODAL) & ~quantifier.isin(*UNIVERSAL), "possibility"), F.lit(""))
    rows = claims.withColumns({"modal": quantifier.isin(*MODAL_QUANTIFIERS) | modality.isin("permission", "possibility") | (clause == "condition"), "qt": quantifier})
    paraphrase = rows.where(~F.coalesce("verified", F.lit(False))).select("pid", F.lit("paraphrase-provenance").alias("check"), "subject")
    unscoped = rows.where((clause == "definition") & (F.coalesce("act_id", F.lit("")) == "")).select("pid", F.lit("unscoped-definition").alias("check"), "subject")
    met = edges.join(rows.select("pid", "modal", "qt"), "pid")
    modal = met.where("modal").select("pid", F.lit("modal-universal").alias("check"), F.col("s").alias("subject"))
    one, two = kinds.select("pid", F.col("ref").alias("s"), F.col("independent").alias("s_ic")), kinds.select("pid", F.col("ref").alias("o"), F.col("dependent").alias("o_dep"))
    sided = met.where(~F.col("modal") & F.col("p").isin(*BEARER_SIDE) & (F.col("qt") != "") & ~F.col("qt").isin(*UNIVERSAL)).join(one, ["pid", "s"]).where("s_ic").join(two, ["pid", "o"], "left").where(F.coalesce("o_dep", F.lit(True)))
    bearer = sided.select("pid", F.lit("bearer-universal").alias("check"), F.col("s").alias("subject"))
    inheres = met.where(F.col("p").isin(*INHERES) & (F.col("q") == "some")).select("pid", "s", "o").unionAll(sided.select("pid", F.col("o").alias("s"), F.col("s").alias("o")))
    multi = inheres.distinct().groupBy("pid", "s").agg(F.count("*").alias("n")).where("n > 1").select("pid", F.lit("multi-bearer").alias("check"), F.col("s").alias("subject"))
    return union(paraphrase, unscoped, modal, bearer, multi)


def alternatives(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """LD-6: (pid, subject, p, fillers): two fillers or more of one subject and property
    that ``listed(pid, alternative)`` names as alternatives only."""
    from ..functions.text import term_key

    keys = listed.select("pid", term_key(F.col("alternative")).alias("key")).where("key <> ''").distinct()
    enough = keys.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1").select("pid")
    rows = edges.where("q = 'some'").withColumn("key", term_key(local("o"))).join(keys.join(enough, "pid"), ["pid", "key"], "left_semi")
    return rows.groupBy("pid", F.col("s").alias("subject"), "p").agg(F.count_distinct("o").alias("fillers")).where("fillers > 1")


def identity_hits(entities: DataFrame, labelled: DataFrame) -> DataFrame:
    """LD-7: (pid, label, iri, kind): what ``labelled(iri, label, kind)`` already names by
    the label of an entity; the smallest name for each."""
    from ..functions.text import label_norm

    index = labelled.select(label_norm(F.col("label")).alias("norm"), "iri", "kind").where("norm <> ''").groupBy("norm").agg(F.min(F.struct("iri", "kind")).alias("h"))
    rows = entities.where("label is not null").select("pid", "label", label_norm(F.col("label")).alias("norm")).distinct()
    return rows.join(index, "norm").select("pid", "label", "h.iri", "h.kind")


# A position and the one it needs on the other side.
CORRELATIVES = [("duty", "claim"), ("power", "liability"), ("privilege", "no-claim"), ("immunity", "disability")]


def positions(held: DataFrame) -> DataFrame:
    """LP-1: (pid, position, problem) of ``held(pid, position, holder, against)``: positions
    nobody holds, and positions without their correlative in the proposal."""
    pairs = [*CORRELATIVES, *[(b, a) for a, b in CORRELATIVES]]
    wanted = F.broadcast(held.sparkSession.createDataFrame(pairs, "position STRING, other STRING"))
    unheld = held.where(F.coalesce("holder", F.lit("")) == "").select("pid", "position", F.lit("unheld").alias("problem"))
    lone = held.join(wanted, "position").join(held.select("pid", F.col("position").alias("other")), ["pid", "other"], "left_anti").select("pid", "position", F.lit("no correlative").alias("problem"))
    return union(unheld, lone)


def fragment_triples(relations: DataFrame) -> DataFrame:
    """X-8: (pid, s, p, o): the triples of a proposal's relations; an expression becomes
    a blank node named by its hash, with the triples of its restriction."""
    e = expression(F.col("o"))
    rows = relations.where("s <> '' and p <> '' and o <> ''").select("pid", "s", "p", "o", e.alias("e"))
    node = F.concat(F.lit("_:"), F.substring(F.sha2(F.concat_ws("|", "e.op", "e.prop", "e.cls"), 256), 1, 16))
    plain = rows.where("e is null").select("pid", "s", "p", "o")
    made = rows.where("e is not null").withColumn("n", node)
    parts = F.when(F.col("e.op") == "not", F.array(F.struct(F.lit("owl:complementOf").alias("p"), F.col("e.cls").alias("o")))).otherwise(
        F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit("owl:Restriction").alias("o")), F.struct(F.lit("owl:onProperty").alias("p"), F.col("e.prop").alias("o")), F.struct(F.lit("owl:someValuesFrom").alias("p"), F.col("e.cls").alias("o")))
    )
    inner = made.select("pid", F.when(F.col("e.op") == "not_some", F.concat("n", F.lit("s"))).otherwise(F.col("n")).alias("s"), F.inline(parts))
    outer = made.where("e.op = 'not_some'").select("pid", F.col("n").alias("s"), F.lit("owl:complementOf").alias("p"), F.concat("n", F.lit("s")).alias("o"))
    return union(plain, made.select("pid", "s", "p", F.col("n").alias("o")), inner, outer)
