"""Ranking, selecting and naming terms: reuse candidates, canonical members, surface
forms, lexical scans of names and texts, sequential numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_key, reservation_key
from . import lint

# Words that carry nothing when texts are matched by overlap.
OVERLAP_STOP = "that this with from have been which their there were will would should could about into than then them they what when where under upon shall".split()
# Kinds and confidences in the order of their rank.
KINDS, CONFIDENCES = ["exact", "stem", "bag", "vector"], ["high", "medium", "review_required"]
# Words that suggest a template, the first template that fits counts.
SMELLS = [
    ("quantitative_threshold", ["threshold", "limit", "acuity", "pound", "degree", "minimum", "maximum", "cutoff"]),
    ("duration_requirement", ["duration", "month", "period", "continuous"]),
    ("exclusion_clause", ["exclusion", "excluded", "carveback", "carve"]),
    ("role", ["role", "claimant", "examiner", "adjudicator"]),
    ("evidentiary_source", ["source", "evidence", "report", "opinion"]),
]
# Instruments by pattern, the most specific first, and how they are cited.
INSTRUMENTS = [
    (r"(?i)\b(\d+)\s*C\.?F\.?R\.?\s*(?:part\s*)?(\d+)", "CFR"),
    (r"(?i)\b(\d+)\s*U\.?S\.?C\.?\s*(\d+)", "USC"),
    (r"(?i)\bDSM[- ]?(5)", "DSM"),
    (r"(?i)\bICD[- ]?(\d+)", "ICD"),
]
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "obo": "http://purl.obolibrary.org/obo/", "bfo": "http://purl.obolibrary.org/obo/",
}
MOST_PROSE = 120


def key_words(label: Column) -> Column:
    return F.array_remove(F.split(label_key(label), " "), "")


def ranked(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` of each group, with their place."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)


def reuse_candidates(wanted: DataFrame, existing: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """TOP-1: (label, iri, exact, similarity, place): for each distinct label the terms of
    ``existing(iri, label, canonical, ordinal)`` with its key, or a Jaccard of ``least``
    or more: exact first, then canonical, then the more similar, then the earlier. Keys
    meet through their rarest words only: of n words a key at the threshold shares one
    of the first n - ceil(n * least) + 1."""
    terms = existing.withColumn("held", key_words(F.col("label"))).where(F.size("held") > 0)
    words = wanted.where("label is not null").select("label").distinct().withColumn("words", key_words(F.col("label"))).where(F.size("words") > 0)
    spread = terms.select("held").distinct().select("held", F.explode("held").alias("w"))
    df = spread.groupBy("w").agg(F.count("*").alias("df"))
    order = words.select("words").distinct().select("words", F.explode("words").alias("w")).join(df, "w", "left")
    rarest = order.groupBy("words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("o"))
    prefix = F.slice("o", F.lit(1), F.size("o") - F.ceil(F.size("o") * least).cast("int") + 1)
    met = rarest.select("words", F.explode(prefix).alias("s")).select("words", F.col("s.w").alias("w")).join(spread, "w").select("words", "held").distinct()
    similarity = F.size(F.array_intersect("words", "held")) / F.size(F.array_union("words", "held"))
    close = met.withColumn("similarity", F.round(similarity, 3)).where(similarity >= least)
    rows = words.join(close, "words").join(terms.drop("label"), "held").select("label", "iri", (F.col("similarity") == 1).alias("exact"), "canonical", "similarity", "ordinal")
    return ranked(rows, ["label"], [F.desc("exact"), F.desc("canonical"), F.desc("similarity"), "ordinal"], k).select("label", "iri", "exact", "similarity", "place")


def contained_candidates(texts: DataFrame, existing: DataFrame, k: int = 5) -> DataFrame:
    """TOP-2: (id, iri, place): terms all of whose key words a text has: canonical first,
    then the longer key, then the earlier."""
    tokens = texts.select("id", F.explode(key_words(F.col("text"))).alias("w"))
    terms = existing.withColumn("held", key_words(F.col("label"))).where(F.size("held") > 0)
    met = terms.select("iri", "canonical", "ordinal", F.size("held").alias("n"), F.length(label_key(F.col("label"))).alias("chars"), F.explode("held").alias("w")).join(tokens, "w")
    whole = met.groupBy("id", "iri", "canonical", "ordinal", "n", "chars").agg(F.count("*").alias("shared")).where("shared = n")
    return ranked(whole, ["id"], [F.desc("canonical"), F.desc("chars"), "ordinal"], k).select("id", "iri", "place")


def overlap_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(*OVERLAP_STOP)))


def overlap_rank(texts: DataFrame, existing: DataFrame, k: int = 50) -> DataFrame:
    """TOP-3: (id, iri, overlap, place): terms by the number of words shared with a text."""
    split = F.regexp_replace("label", "([a-z])([A-Z])", "$1 $2")
    terms = existing.select("iri", "ordinal", F.explode(overlap_words(split)).alias("w"))
    met = texts.select("id", F.explode(overlap_words(F.col("text"))).alias("w")).join(terms, "w").groupBy("id", "iri", "ordinal").agg(F.count("*").alias("overlap"))
    return ranked(met, ["id"], [F.desc("overlap"), "ordinal"], k).select("id", "iri", "overlap", "place")


def canonical_first(rows: DataFrame) -> DataFrame:
    """TOP-4: ``rows(id, iri, canonical, ordinal)`` with their place, canonical ones first."""
    return ranked(rows, ["id"], [F.desc("canonical"), "ordinal"], 1 << 30)


def cluster_rank(clusters: DataFrame) -> DataFrame:
    """TOP-5, FLT-7: ``clusters(name, kind, confidence, members)`` in the order of kind,
    confidence and size, as (name, kind_rank, confidence_rank, members)."""
    rank = lambda c, held: F.array_position(F.array(*map(F.lit, held)), F.col(c)).cast("int")
    return clusters.select("name", rank("kind", KINDS).alias("kind_rank"), rank("confidence", CONFIDENCES).alias("confidence_rank"), "members").orderBy("kind_rank", "confidence_rank", F.desc("members"), "name")


def candidates(clusters: DataFrame, kinds: list[str], least: str) -> DataFrame:
    """FLT-7: clusters of the kinds, of that confidence or a higher one."""
    held = CONFIDENCES[: CONFIDENCES.index(least) + 1]
    return clusters.where(F.col("kind").isin(*kinds) & F.col("confidence").isin(*held))


def canonical_member(members: DataFrame) -> DataFrame:
    """TOP-8: (key, member): the shortest name of a cluster, of names with a capital if it
    has any; the smaller of equal length."""
    best = lambda rows: F.min(F.when(rows, F.struct(F.length("name").alias("n"), "name")))
    capital = F.col("name").rlike("^[A-Z]")
    rows = members.groupBy("key").agg(best(capital).alias("c"), best(F.lit(True)).alias("a"))
    return rows.select("key", F.coalesce("c.name", "a.name").alias("member"))


def first_mention(text: Column, categories: list[str]) -> Column:
    """TOP-9: the category a text mentions first; of equal places the earlier in the list."""
    low = F.lower(text)
    places = F.array(*[F.struct(F.instr(low, c.lower()).alias("at"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(categories)])
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["c"]


def capped(rows: DataFrame, code: str, order: list[str], sample: int) -> DataFrame:
    """TOP-10: at most ``sample`` rows of each code, for a report."""
    return ranked(rows, [code], order, sample).drop("place")


# ---------------------------------------------------------------- sets and numbers

def first_kept(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SET-6: the first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f"))
    return best.select(*key, *[F.col(f"f.{c}").alias(c) for c in rest])


def undefined(named: DataFrame, defined: DataFrame, deferred: DataFrame) -> DataFrame:
    """SET-2, LINT-1: terms that are neither defined nor deferred."""
    return named.select("term").distinct().join(defined.select("term"), "term", "left_anti").join(deferred.select("term"), "term", "left_anti")


def all_but(parts: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """SET-1: the union of class sources without some nodes."""
    out = parts[0].select("class")
    for part in parts[1:]:
        out = out.unionAll(part.select("class"))
    return out.distinct().join(nodes.select("class"), "class", "left_anti")


def numbered(rows: DataFrame, group: str, order: list[str], existing: DataFrame) -> DataFrame:
    """WIN-6, MUT-11: new rows numbered from above the highest id of their group in
    ``existing(group, id)``."""
    top = existing.groupBy(group).agg(F.max("id").alias("top"))
    placed = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.join(top, group, "left").withColumn("id", F.coalesce("top", F.lit(-1)) + F.col("turn")).drop("top", "turn")


def reserved(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """MUT-10: (label, iri, reused): the name a label gets: that of an existing term with
    its reservation key, else one made of its words; equal keys get one name."""
    from ..functions.text import camel_case

    held = existing.groupBy(reservation_key(F.col("label")).alias("key")).agg(F.min("iri").alias("held"))
    made = wanted.select("label", reservation_key(F.col("label")).alias("key")).distinct()
    first = made.groupBy("key").agg(F.min("label").alias("first"))
    rows = made.join(first, "key").join(held, "key", "left")
    return rows.select("label", F.coalesce("held", F.concat(F.lit("working:"), camel_case(F.col("first")))).alias("iri"), F.col("held").isNotNull().alias("reused"))


# ---------------------------------------------------------------- names

def surface_forms(term: Column) -> Column:
    """NORM-9: a term's words, with and without a plural, and every run of them, longest
    first."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(term, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+", " ")), " ")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    plural = lambda w: F.when(w.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(w, "y$", ""), F.lit("ies"))).when(w.endswith("s"), w).otherwise(F.concat(w, F.lit("s")))
    return F.array_distinct(F.flatten(F.transform(runs, lambda w: F.array(w, plural(w)))))


def full_iri(name: Column, base: str, strict: bool = False) -> Column:
    """NORM-14: a prefixed or bare name as a full IRI; an unknown prefix gives null if
    ``strict``, else stays."""
    prefix, rest = F.regexp_extract(name, r"^([A-Za-z]\w*):(?!//)", 1), F.regexp_replace(name, r"^[A-Za-z]\w*:", "")
    out = F.when(name.contains("://"), name)
    for p, namespace in (PREFIXES | {"working": base}).items():
        out = out.when(prefix == p, F.concat(F.lit(namespace), rest))
    return out.when(prefix != "", F.lit(None) if strict else name).otherwise(F.concat(F.lit(base), name))


def provision(locator: Column) -> Column:
    """LEX-4: recital, operative or unknown."""
    at = F.trim(F.coalesce(locator, F.lit("")))
    return F.when(at.startswith("rec_"), "recital").when(at.isin("", "unknown"), "unknown").otherwise("operative")


def smell(label: Column) -> Column:
    """LEX-14: the template a label suggests, or null."""
    low, out = F.lower(label), None
    for name, words in SMELLS:
        hit = low.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def implied_source(*texts: Column) -> Column:
    """LEX-15: the most specific instrument that any of the texts names."""
    found = []
    for pattern, kind in INSTRUMENTS:
        for text in texts:
            part = lambda i: F.regexp_extract(text, pattern, i)  # noqa: B023, E731
            made = F.concat(part(1), F.lit(f" {kind} "), part(2)) if kind in ("CFR", "USC") else F.concat(F.lit(f"{kind}-"), part(1))
            found.append(F.when(text.rlike(pattern), made))
    return F.coalesce(*found)


def prose_rows(triples: DataFrame, predicates: list[str], headers: DataFrame) -> DataFrame:
    """LEX-10: (s, p, chars): literals of prose predicates above ``MOST_PROSE`` characters,
    those of ``headers(s)`` apart."""
    rows = triples.where((F.col("o_kind") == "lit") & F.col("p").isin(*predicates) & (F.length("o") > MOST_PROSE))
    return rows.join(headers.select("s").distinct(), "s", "left_anti").select("s", "p", F.length("o").alias("chars"))


def iri_scan(raw: DataFrame) -> DataFrame:
    """LEX-7: (id, code, iri) of the names in RDF attributes of ``raw(id, raw)``: names with
    an expression, with illegal characters, with a privation, of blank nodes; and a
    complement that is mentioned but never stated."""
    names = raw.select("id", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r'rdf:(?:about|resource)="([^"]*)"'), F.lit(1)))).alias("iri"))
    fragment = F.when(F.col("iri").contains("#"), F.regexp_extract("iri", "#(.*)$", 1)).otherwise(F.lit(""))
    vocabulary = F.col("iri").rlike(r"^http://www\.w3\.org/2002/07/owl#[A-Za-z_][\w.\-]*$")
    rules = [
        ("E_EXPR_IRI", ~vocabulary & (F.col("iri").rlike(r"[\[\]]| some | only |\bnot \(") | fragment.rlike(lint.CONSTRUCTS) | (fragment.contains(":") & ~fragment.startswith("_:")))),
        ("E_BAD_IRI", F.col("iri").rlike(r"[\s<>\"{}|\\^`]")), ("E_ANTIPATTERN", F.col("iri").rlike(lint.ANTIPATTERN)), ("E_BNODE_IRI", F.col("iri").contains("_:")),
    ]
    hits = names.select("id", "iri", F.explode(F.array_compact(F.array(*[F.when(test, code) for code, test in rules]))).alias("code")).select("id", "code", "iri")
    lost = raw.where(F.col("raw").contains("complementOf") & ~F.col("raw").rlike(r"<owl:complementOf[\s>]")).select("id", F.lit("WARN_LOST_COMPLEMENT").alias("code"), F.lit("complementOf").alias("iri"))
    return hits.unionAll(lost)


def governing_context(quote: Column, sentence: Column, lead: int = 8) -> Column:
    """LEX-16: a quote with the ``lead`` words before it in its sentence."""
    at = F.instr(sentence, quote)
    before = F.filter(F.split(F.trim(F.substring(sentence, F.lit(1), at - 1)), r"\s+"), lambda w: w != "")
    kept = F.slice(before, F.greatest(F.size(before) - lead + 1, F.lit(1)), F.lit(lead))
    return F.when(at > 0, F.concat_ws(" ", F.array_join(kept, " "), quote)).otherwise(quote)


def word_window(text: Column, phrase: Column, chars: int = 150, words: int = 38) -> Column:
    """TXT-4: up to ``words`` words around the first place of a phrase, letter case apart,
    from ``chars`` characters on each side; null where it is not found."""
    at = F.instr(F.lower(text), F.lower(phrase))
    low = F.greatest(at - chars, F.lit(1))
    near = F.substring(text, low, at - low + F.length(phrase) + chars)
    return F.when(at > 0, F.array_join(F.slice(F.filter(F.split(near, r"\s+"), lambda w: w != ""), 1, words), " "))


# ---------------------------------------------------------------- annotations

def cross_references(classes: DataFrame, claims: DataFrame) -> DataFrame:
    """X-1: (s, p, o): for each of ``classes(iri, name, label)`` the first claim whose
    ``subject`` has its alphanumeric key, by name before label: two triples each."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    first = claims.groupBy(key(F.col("subject")).alias("key")).agg(F.min(F.struct("ordinal", "claim_id", "quote")).alias("c")).where("key <> ''")
    by = lambda column, name: classes.select("iri", key(F.col(column)).alias("key")).join(first, "key").select("iri", F.col("c").alias(name))
    hit = classes.select("iri").join(by("name", "n"), "iri", "left").join(by("label", "l"), "iri", "left").select("iri", F.coalesce("n", "l").alias("c")).where("c is not null")
    parts = F.array(F.struct(F.lit("claimId").alias("p"), F.col("c.claim_id").cast("string").alias("o")), F.struct(F.lit("sourceQuote").alias("p"), F.col("c.quote").alias("o")))
    return hit.select(F.col("iri").alias("s"), F.inline(parts)).where("o is not null").distinct()


def sibling_census(edges: DataFrame, labels: DataFrame, defined: DataFrame, disjoint: DataFrame) -> DataFrame:
    """X-3: by parent: children, defined ones, disjoint pairs among them, the longest label
    and the labels over ``MOST_PROSE`` characters."""
    kids = edges.select("parent", "child").distinct()
    rows = kids.join(labels.groupBy(F.col("iri").alias("child")).agg(F.max("label").alias("label")), "child", "left").join(defined.select(F.col("term").alias("child"), F.lit(1).alias("d")).distinct(), "child", "left")
    pairs = disjoint.join(kids.select(F.col("child").alias("a"), "parent"), "a").join(kids.select(F.col("child").alias("b"), "parent"), ["b", "parent"]).groupBy("parent").agg(F.count("*").alias("disjoint"))
    counted = rows.groupBy("parent").agg(F.count("*").alias("children"), F.count("d").alias("defined"), F.max_by("label", F.struct(F.length("label"), F.col("label"))).alias("longest"), F.count_if(F.length("label") > MOST_PROSE).alias("over"))
    return counted.join(pairs, "parent", "left").select("parent", "children", "defined", F.coalesce("disjoint", F.lit(0)).alias("disjoint"), "longest", "over")


def repeated_metrics(metrics: DataFrame, allowed: list[str]) -> DataFrame:
    """AGG-25: (key, values) of leaf keys of ``metrics(path, value)`` with different numbers,
    structural keys apart."""
    leaf = F.element_at(F.split("path", r"\."), -1)
    return metrics.where(F.col("value").isNotNull()).groupBy(leaf.alias("key")).agg(F.count_distinct("value").alias("values")).where((F.col("values") > 1) & ~F.col("key").isin(*allowed))


def graph_summary(labelled: DataFrame, k: int = 20) -> DataFrame:
    """LOG-4: the first ``k`` labels for a prompt, by name."""
    return labelled.select("iri", "label").distinct().orderBy("label", "iri").limit(k)
