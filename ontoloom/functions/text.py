"""Scalar text functions as columns: label keys, normal forms, classifiers.

All patterns are written for Java with ``(?U)`` where the source language's classes
are Unicode; nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a class label.
LABEL_NOISE = "process disposition quality role function legal the of class act".split()
# Words left out of a word bag.
BAG_STOP = "the of a an and or in on to for by with as is at from".split()
# Name suffixes, tried in this order.
NAME_SUFFIXES = "Process Event Act Thesis Principle Claim Relation Dependence Condition Capacity Disposition Quality Role Function Network Structure Entity Commitment Framework".split()
# Word endings of the cheap stemmer, tried in this order.
ENDINGS = "ations ation ements ement ingly ing ies ied ers er ed es s e".split()
# Words left out of content tokens.
CONTENT_STOP = "a an and any are as at be been by for from has have if in is it its may must no not of on or shall such that the their them there this to under upon was were which who will with within".split()
# Words that stand for the same thing.
SYNONYMS = {
    "motion": "move", "motions": "move", "movant": "move", "movants": "move", "moved": "move", "moves": "move", "moving": "move",
    "application": "apply", "applications": "apply", "applicant": "apply", "petition": "petit", "petitions": "petit", "petitioner": "petit",
}


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def label_key(label: Column) -> Column:
    """NORM-1: the sorted set of meaningful words of a label."""
    bare = F.lower(camel_split(F.regexp_replace(label, r"\([^)]*\)", " ")))
    kept = F.array_except(words(bare, "[a-z]+"), F.array(*map(F.lit, LABEL_NOISE)))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def word_bag(name: Column) -> Column:
    """NORM-2: all words of a name but stop words, sorted, with repeats."""
    found = F.transform(words(name, r"[A-Z][a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[a-z]+|\d+"), F.lower)
    return F.array_join(F.array_sort(F.filter(found, lambda w: ~w.isin(*BAG_STOP))), " ")


def _without(text: Column, endings: list[str], least: int) -> Column:
    """Without the first ending of the list that leaves more than ``least``
    letters. In these lists a longer ending always comes before its own tail."""
    return F.regexp_replace(text, f"^(.{{{least + 1},}}?)(?:{'|'.join(endings)})$", "$1")


def name_stem(name: Column) -> Column:
    """NORM-3: a name without its first fitting suffix, lower case; null without one."""
    stem = _without(name, NAME_SUFFIXES, 3)
    return F.when(stem != name, F.lower(stem))


def reservation_key(name: Column) -> Column:
    """NORM-4: lower-cased alphanumeric words, one plural s taken off each."""
    bare = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    single = F.transform(bare, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_join(single, " ")


def term_key(term: Column) -> Column:
    """NORM-5: letters and digits, without a plural ending."""
    bare = F.regexp_replace(F.lower(term), "[^a-z0-9]", "")
    cut = lambda n: F.substring(bare, F.lit(1), F.length(bare) - n)
    return (
        F.when(bare.endswith("ies") & (F.length(bare) > 5), F.concat(cut(3), F.lit("y")))
        .when(bare.endswith("es") & (F.length(bare) > 4), cut(2))
        .when(bare.endswith("s") & (F.length(bare) > 3), cut(1))
        .otherwise(bare)
    )


def label_norm(label: Column) -> Column:
    """NORM-6: without quotation marks, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(label, "[‘’'\"]", "")), "[^a-z0-9]+", " "))


def typography(text: Column) -> Column:
    """NORM-7: plain quotes and dashes, single blanks."""
    plain = F.translate(text, "‘’‚‛“”„«»–—‑", "''''\"\"\"\"\"---")
    return F.trim(F.regexp_replace(plain, r"[\s\x{A0}\x{2007}\x{202F}]+", " "))


def search_norm(text: Column) -> Column:
    """NORM-8: padded words, so that containment means whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def content_tokens(text: Column) -> Column:
    """NORM-10: the set of stemmed content words."""
    found = F.filter(words(F.lower(text), "[a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*CONTENT_STOP))
    synonym = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.coalesce(F.try_element_at(synonym, w), _without(w, ENDINGS, 3)))))


def rule_root(locator: Column) -> Column:
    """NORM-11: a locator up to its first bracket."""
    return F.regexp_replace(F.regexp_replace(locator, r"\(.*$", ""), r"^[ .,;]+|[ .,;]+$", "")


def upper_fragment(iri: Column) -> Column:
    """NORM-12: what follows the last #, / or : of a reference."""
    return F.substring_index(F.substring_index(F.substring_index(iri, "#", -1), "/", -1), ":", -1)


def camel_case(phrase: Column) -> Column:
    """NORM-13: a phrase as one name."""
    return F.array_join(F.transform(words(phrase, "[A-Za-z0-9]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def content_hash(*parts: Column) -> Column:
    """HASH-1: ten hex digits of the parts, trimmed and joined by U+0001."""
    joined = F.concat_ws("\x01", *[F.trim(F.coalesce(p, F.lit(""))) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 10)


def slug_hash(*parts: Column) -> Column:
    """HASH-1: a stable local name: letters and digits of the first part, and the hash of all."""
    return F.concat(F.regexp_replace(F.coalesce(parts[0], F.lit("")), "[^A-Za-z0-9]+", ""), F.lit("_"), content_hash(*parts))


def sentences(text: Column) -> Column:
    """TXT-1: split after sentence ends."""
    return F.split(text, r"(?<=[.!?])\s+")


# Clause kinds and the patterns that name them, the first one wins.
CLAUSE_KINDS = [
    ("definition", r"\bmeans\b|\bshall mean\b|\bshall be understood\b|\bis defined as\b"),
    ("scope", r"\b(?:applies|shall (?:not )?apply) to\b|\bshall not apply\b"),
    ("establishment", r"\bis hereby established\b|\blegal personality\b"),
    ("remedy", r"\blodge a complaint\b|\bjudicial remedy\b|\bshall be liable\b|\badministrative fines?\b|\bcompensation\b|\bpenalt(?:y|ies)\b"),
    ("conferral", r"\bshall (?:designate|appoint)\b|\bshall be appointed\b|\bshall have the power\b|\bis empowered\b"),
    ("condition", r"^\s*(?:\(\w+\)\s*)?(?:where|in the case of|if)\b"),
    ("norm", r"\bshall\b|\bmay\b|\bis entitled to\b|\bhas the right\b|\bmust\b"),
]


def clause_kind(text: Column) -> Column:
    """LEX-1."""
    low, out = F.lower(text), F.lit("other")
    for kind, pattern in reversed(CLAUSE_KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return F.when(text.isNotNull(), out)


def celex(text: Column) -> Column:
    """LEX-3: the identifier of the first Union act cited, or null. The current style
    has year/number behind the community; the old one has number/year before it, but a
    directive year/number; years of two digits are of the last century above 50."""
    act = r"(?i)\b(Regulation|Directive|Decision)"
    new = act + r"\s*\((?:EU|EC|EEC|EU,\s*Euratom|EC,\s*Euratom)\)\s*(?:No\.?\s*)?(\d{4})/(\d{1,4})\b"
    old = act + r"\s+(?:\((?:EEC|EC)\)\s*)?(?:No\.?\s*)?(\d{1,4})/(\d{2,4})/(?:EEC|EC|EU)\b"
    part = lambda p, i: F.regexp_extract(text, p, i)
    letter = lambda p: F.when(F.lower(part(p, 1)) == "regulation", "R").when(F.lower(part(p, 1)) == "directive", "L").otherwise("D")
    number = lambda n: F.lpad(F.regexp_replace(n, "^0+(?=.)", ""), 4, "0")
    one = F.concat(F.lit("3"), part(new, 2), letter(new), number(part(new, 3)))
    first, second = part(old, 2), part(old, 3)
    year_first = (F.lower(part(old, 1)) == "directive") | ((F.length(first) <= 2) & (F.length(second) > 2))
    year, count = F.when(year_first, first).otherwise(second), F.when(year_first, second).otherwise(first)
    full = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") > 50, "19").otherwise("20"), year)).otherwise(year)
    return F.when(text.rlike(new), one).when(text.rlike(old), F.concat(F.lit("3"), full, letter(old), number(count)))


# What must not reach a client, and what it would disclose.
LEAKS = [
    ("kernel primitive code", r"K-[A-D]\d"),
    ("legal contradiction code", r"\bLC-\d+"),
    ("classificatory type code", r"\bCT-\d+"),
    ("stratum letter", r"(?i)\bstrat(?:um|a)\s*[A-D]\b"),
    ("dotted module path", r"(?i)\b(?:app|aperture|recognition)\.[a-z_][a-z0-9_.]*"),
    ("instrument identifier", r"(?i)\b(?:dl_reasoner|world_evidence|process_model)\b"),
]
# Words that weaken a duty.
MODALS = r"\b(?:may|might|can|could|should|is able to|are able to)\b"
# Signs of a route for invoking a power.
PATHWAYS = [
    ("motion", r"\b(motion|move[sd]?|moving|movant|appl(y|ies|ication)|petition|request)\w*\b"),
    ("filing", r"\b(fil(e|es|ed|ing)|lodge[sd]?|submit\w*|serve[sd]?|service)\b"),
    ("notice", r"\bnotice\b|\bnotif\w*"),
    ("hearing", r"\bhearing\b|\bconference\b|\bbe heard\b"),
    ("form", r"\b(affidavit|declaration|certif\w*|verified|in writing|written|must (state|include|contain|specify|set out|name)|form)\b"),
    ("order", r"\border\b|\bdirect\w*\b"),
]
# Counterparties that name nobody in particular.
VAGUE = ["", "any person", "any party", "anyone", "others", "other parties", "public", "parties", "all parties", "someone", "persons", "person", "people", "n/a", "none"]
# Phrases of enacted instruments, and article headings.
ENACTED = r"\b(?:whereas:|have adopted this|hereby (?:enacted|established)|official journal of the european union|be it enacted|for the purposes of this (?:regulation|directive|act|decision))"
ARTICLE_HEAD = r"(?m)^[ \t]*(?:Article|ARTICLE|Art\.|Section|SECTION|§)[ \t]+\d+[a-z]?\b"


def genre(text: Column) -> Column:
    """LEX-2: legislation with two signals of four, else philosophy. All signals are
    taken from the whole text, so an act cited late counts as well."""
    sample = text
    signals = (
        celex(text).isNotNull().cast("int")
        + (F.regexp_count(sample, F.lit(ARTICLE_HEAD)) >= 2).cast("int")
        + F.lower(sample).rlike(ENACTED).cast("int")
        + (F.regexp_count(F.lower(sample), F.lit(r"\bshall\b")) * 1000 / F.greatest(F.lit(1), F.regexp_count(sample, F.lit(r"\S+"))) >= 3).cast("int")
    )
    return F.when(F.coalesce(signals, F.lit(0)) >= 2, "legislation").otherwise("philosophy")


def leaks(text: Column) -> Column:
    """LEX-9: every leak as (discloses, matched)."""
    def named(kind: str, pattern: str) -> Column:
        return F.transform(words(text, pattern), lambda m: F.struct(F.lit(kind).alias("discloses"), m.alias("matched")))

    return F.concat(*[named(kind, pattern) for kind, pattern in LEAKS])


def modal_words(text: Column) -> Column:
    """LEX-16: the modal words of a text, in order."""
    return words(F.lower(text), MODALS)


def jaccard(a: Column, b: Column) -> Column:
    """MATH-1: zero for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def nearest_rank(values: Column, percent: float) -> Column:
    """PCT-1 of a sorted array: index round-half-even(p/100*(n-1))."""
    return F.element_at(values, (F.bround(F.lit(percent / 100) * (F.size(values) - 1), 0)).cast("int") + 1)


def wilson(k: Column, n: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    """AGG-10: bounds of the interval, null for n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = k / m, z * z
    centre, spread = p + z2 / (2 * m), z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    return F.round((centre - spread) / (1 + z2 / m), 6), F.round((centre + spread) / (1 + z2 / m), 6)
