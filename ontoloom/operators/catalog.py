"""The upper catalogue as small fixed tables, and what is anchored to it: ancestors,
clashes, chain bindings. All tables here have a fixed size and are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fragment, parent, label of the upper classes.
UPPER = [
    ("BFO_0000001", None, "entity"),
    ("BFO_0000002", "BFO_0000001", "continuant"),
    ("BFO_0000003", "BFO_0000001", "occurrent"),
    ("BFO_0000004", "BFO_0000002", "independent continuant"),
    ("BFO_0000006", "BFO_0000141", "spatial region"),
    ("BFO_0000008", "BFO_0000003", "temporal region"),
    ("BFO_0000009", "BFO_0000006", "two-dimensional spatial region"),
    ("BFO_0000011", "BFO_0000003", "spatiotemporal region"),
    ("BFO_0000015", "BFO_0000003", "process"),
    ("BFO_0000016", "BFO_0000017", "disposition"),
    ("BFO_0000017", "BFO_0000020", "realizable entity"),
    ("BFO_0000018", "BFO_0000006", "zero-dimensional spatial region"),
    ("BFO_0000019", "BFO_0000020", "quality"),
    ("BFO_0000020", "BFO_0000002", "specifically dependent continuant"),
    ("BFO_0000023", "BFO_0000017", "role"),
    ("BFO_0000024", "BFO_0000040", "fiat object part"),
    ("BFO_0000026", "BFO_0000006", "one-dimensional spatial region"),
    ("BFO_0000027", "BFO_0000040", "object aggregate"),
    ("BFO_0000028", "BFO_0000006", "three-dimensional spatial region"),
    ("BFO_0000029", "BFO_0000141", "site"),
    ("BFO_0000030", "BFO_0000040", "object"),
    ("BFO_0000031", "BFO_0000002", "generically dependent continuant"),
    ("BFO_0000034", "BFO_0000016", "function"),
    ("BFO_0000035", "BFO_0000003", "process boundary"),
    ("BFO_0000038", "BFO_0000008", "one-dimensional temporal region"),
    ("BFO_0000040", "BFO_0000004", "material entity"),
    ("BFO_0000140", "BFO_0000141", "continuant fiat boundary"),
    ("BFO_0000141", "BFO_0000004", "immaterial entity"),
    ("BFO_0000142", "BFO_0000140", "fiat line"),
    ("BFO_0000145", "BFO_0000019", "relational quality"),
    ("BFO_0000146", "BFO_0000140", "fiat surface"),
    ("BFO_0000147", "BFO_0000140", "fiat point"),
    ("BFO_0000148", "BFO_0000008", "zero-dimensional temporal region"),
    ("BFO_0000182", "BFO_0000015", "history"),
    ("BFO_0000202", "BFO_0000038", "temporal interval"),
    ("BFO_0000203", "BFO_0000148", "temporal instant"),
]
# The groups of pairwise disjoint upper classes.
DISJOINT = [
    ["BFO_0000002", "BFO_0000003"],
    ["BFO_0000004", "BFO_0000020", "BFO_0000031"],
    ["BFO_0000017", "BFO_0000019"],
    ["BFO_0000016", "BFO_0000023"],
    ["BFO_0000040", "BFO_0000141"],
    ["BFO_0000006", "BFO_0000029", "BFO_0000140"],
    ["BFO_0000008", "BFO_0000011", "BFO_0000015", "BFO_0000035"],
    ["BFO_0000009", "BFO_0000018", "BFO_0000026", "BFO_0000028"],
    ["BFO_0000038", "BFO_0000148"],
    ["BFO_0000142", "BFO_0000146", "BFO_0000147"],
]
# Relation, label, domain, range.
SIGNATURES = [
    ("BFO_0000050", "part of", None, None),
    ("BFO_0000051", "has part", None, None),
    ("BFO_0000197", "inheres in", "BFO_0000020", "BFO_0000004"),
    ("BFO_0000196", "bearer of", "BFO_0000004", "BFO_0000020"),
    ("BFO_0000054", "has realization", "BFO_0000017", "BFO_0000015"),
    ("BFO_0000055", "realizes", "BFO_0000015", "BFO_0000017"),
    ("BFO_0000056", "participates in", "BFO_0000002", "BFO_0000003"),
]
# The links of the chain in order, and the upper classes that may stand there.
CHAIN = [
    ("authority", ["BFO_0000020", "BFO_0000040", "BFO_0000031"]),
    ("criteria", ["BFO_0000020", "BFO_0000031"]),
    ("assessor", ["BFO_0000023", "BFO_0000040"]),
    ("facts", ["BFO_0000031", "BFO_0000019", "BFO_0000015", "BFO_0000040"]),
    ("act", ["BFO_0000015"]),
    ("effect", ["BFO_0000017", "BFO_0000020"]),
    ("remedy", ["BFO_0000015", "BFO_0000017"]),
]
# Numbers of the upper object properties.
KERNEL_PROPERTIES = [
    54, 55, 56, 57, 58, 59, 62, 63, 66, 82, 84, 101, 108, 110, 111, 113, 115, 117, 118, 121, 124, 127, 129, 132, 136, 137, 138, 139, 153, 163, 164, 165, 166, 167, 170,
    171, 172, 173, 174, 175, 176, 177, 178, 181, 183, 184, 185, 194, 195, 196, 197, 199, 200, 210, 211, 216, 217, 218, 219, 220, 221, 222, 223, 224,
]
# Relations of bearing, and the kind of realizable each is for.
BEARING = [("RO_0000087", "BFO_0000023"), ("RO_0000091", "BFO_0000016"), ("RO_0000085", "BFO_0000034")]


def property_name(number: int) -> str:
    return f"BFO_{number:07d}"


def upper(spark: SparkSession) -> DataFrame:
    """(fragment, parent, label)."""
    return spark.createDataFrame(UPPER, "fragment STRING, parent STRING, label STRING")


def ancestor_rows() -> list[tuple[str, str, int]]:
    """HIER-3: (fragment, ancestor, depth), each class its own ancestor at depth 0."""
    parents, rows = {f: p for f, p, _ in UPPER}, []
    for fragment in parents:
        at, depth = fragment, 0
        while at is not None:
            rows.append((fragment, at, depth))
            at, depth = parents[at], depth + 1
    return rows


def ancestors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ancestor_rows(), "fragment STRING, ancestor STRING, depth INT")


def clash_rows() -> list[tuple[str, str]]:
    """HIER-4: (a, b), both ways: classes with a disjoint pair among their ancestors."""
    above: dict[str, set] = {}
    for fragment, ancestor, _ in ancestor_rows():
        above.setdefault(fragment, set()).add(ancestor)
    pairs = {(x, y) for group in DISJOINT for x in group for y in group if x != y}
    return [(a, b) for a in above for b in above if any((x, y) in pairs for x in above[a] for y in above[b])]


def clashes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(clash_rows(), "a STRING, b STRING")


def signatures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNATURES, "p STRING, label STRING, domain STRING, range STRING")


def admissible_rows() -> list[tuple[str, int, str]]:
    """(locus, ordinal, fragment): the classes that may stand at a link, an anchor of
    the link or anything under one."""
    under = ancestor_rows()
    return [(locus, i, f) for i, (locus, anchors) in enumerate(CHAIN, 1) for f in sorted({f for f, a, _ in under if a in anchors})]


def admissible(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(admissible_rows(), "locus STRING, ordinal INT, fragment STRING")


def fragment(ref: Column) -> Column:
    """The bare name of a reference: what follows the last # and /, and the prefix of an
    upper name."""
    last = F.substring_index(F.substring_index(F.trim(ref), "#", -1), "/", -1)
    return F.regexp_replace(last, r"^[^:]*:(?=BFO_)", "")


def bindings(classes: DataFrame, spark: SparkSession) -> DataFrame:
    """HIER-14, MLC-1: (class, locus): the links at which any of the upper classes of
    ``classes(class, fragment)`` may stand."""
    return classes.join(F.broadcast(admissible(spark)), "fragment").select("class", "locus", "ordinal").distinct()


def unbound(classes: DataFrame, spark: SparkSession) -> DataFrame:
    """HIER-14: the classes that stand nowhere on the chain."""
    return classes.select("class").distinct().join(bindings(classes, spark).select("class"), "class", "left_anti")


def first_clash(typed: DataFrame, spark: SparkSession) -> DataFrame:
    """HIER-4, FACT-1: (class, a, b): the first clashing pair among the upper classes
    of ``typed(class, fragment)``. A class has as many of them as parents."""
    rows = typed.distinct()
    pairs = rows.select("class", F.col("fragment").alias("a")).join(F.broadcast(clashes(spark)), "a").join(rows.select("class", F.col("fragment").alias("b")), ["class", "b"])
    return pairs.where("a < b").groupBy("class").agg(F.min(F.struct("a", "b")).alias("p")).select("class", "p.a", "p.b")


def entailed(typed: DataFrame, spark: SparkSession) -> DataFrame:
    """FACT-1: (class, ancestor): all upper classes that ``typed(class, fragment)`` entails."""
    return typed.join(F.broadcast(ancestors(spark)), "fragment").select("class", "ancestor").distinct()


def asserted_links(tagged: DataFrame) -> DataFrame:
    """HIER-15: (class, links, kept): the links a class is asserted at, as
    ``tagged(class, locus, justified)``; several are kept only with a justification."""
    rows = tagged.groupBy("class").agg(F.count_distinct("locus").alias("links"), F.bool_or("justified").alias("justified"))
    return rows.select("class", "links", ((F.col("links") <= 1) | F.col("justified")).alias("kept"))


def chain_profile(links: DataFrame, spark: SparkSession) -> DataFrame:
    """X-13: (locus, ordinal, classes, state): which links of the chain an artifact
    asserts, from ``links(class, locus)``: three classes make a link thick."""
    chain = spark.createDataFrame([(locus, i) for i, (locus, _) in enumerate(CHAIN, 1)], "locus STRING, ordinal INT")
    counted = links.groupBy("locus").agg(F.count_distinct("class").alias("classes"))
    n = F.coalesce("classes", F.lit(0))
    return chain.join(counted, "locus", "left").select("locus", "ordinal", n.alias("classes"), F.when(n == 0, "absent").when(n < 3, "thin").otherwise("thick").alias("state"))
