"""Adapters: the driver's tables in the shapes the operators take.

Every adapter is a narrow projection or union of scans; operators never read
tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

SUBCLASS, TYPE, LABEL, CLASS = "rdfs:subClassOf", "rdf:type", "rdfs:label", "owl:Class"


def _name(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): customers and suppliers under nations under regions under
    ``entity``; every seventh customer also hangs directly under its region."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    far = customer.where("c_custkey % 7 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        customer.select(_name("c:", "c_custkey").alias("child"), _name("n:", "c_nationkey").alias("parent"))
        .unionAll(supplier.select(_name("s:", "s_suppkey"), _name("n:", "s_nationkey")))
        .unionAll(nation.select(_name("n:", "n_nationkey"), _name("r:", "n_regionkey")))
        .unionAll(region.select(_name("r:", "r_regionkey"), F.lit("entity")))
        .unionAll(far.select(_name("c:", "c_custkey"), _name("r:", "n_regionkey")))
    )


def region_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): all pairs of regions, a < b."""
    keys = table(spark, sf_dir, "region").select("r_regionkey")
    return keys.join(keys.withColumnRenamed("r_regionkey", "other"), F.col("r_regionkey") < F.col("other")).select(_name("r:", "r_regionkey").alias("a"), _name("r:", "other").alias("b"))


def straddling_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxonomy, and a second nation for every eleventh customer."""
    customer = table(spark, sf_dir, "customer").where("c_custkey % 11 = 0")
    second = customer.select(_name("c:", "c_custkey").alias("child"), F.concat(F.lit("n:"), ((F.col("c_nationkey") + 6) % 25).cast("string")).alias("parent"))
    return taxonomy(spark, sf_dir).unionAll(second)


def cyclic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): a functional digraph over the users, with tails and cycles."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.col("user_id").alias("child"), ((F.col("user_id") * F.col("user_id") + 1) % 150).alias("parent"))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iri, label): part names with reversed words, CamelCase and suffixes."""
    one, two = F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_name", " "), -1)
    word = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100))
    pair = F.when(F.col("p_partkey") % 2 == 1, F.array(two, one)).otherwise(F.array(one, two))
    plain = F.when(F.col("p_partkey") % 3 == 0, F.concat(word(pair[0]), word(pair[1]))).otherwise(F.concat_ws(" ", pair))
    suffixed = F.when(F.col("p_partkey") % 5 == 0, F.concat(plain, F.lit("Process"))).otherwise(plain)
    return table(spark, sf_dir, "part").select(_name("part:", "p_partkey").alias("iri"), suffixed.alias("label"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, s_kind, p, o, o_kind, o_lang, source): the taxonomy as classes, parts as
    individuals with labels, properties of which one is not declared and one not
    used, restrictions of nations on their regions, and every fiftieth part also
    declared a class (a pun)."""
    sub, part = taxonomy(spark, sf_dir), table(spark, sf_dir, "part")
    lit = lambda v: F.lit(v)
    row = lambda df, s, p, o, kind, s_kind="iri", lang=None, source="artifact": df.select(
        s.alias("s"), lit(s_kind).alias("s_kind"), lit(p).alias("p"), o.alias("o"), lit(kind).alias("o_kind"), lit(lang).cast("string").alias("o_lang"), lit(source).alias("source")
    )
    nodes = sub.select(F.col("child").alias("n")).unionAll(sub.select("parent")).distinct()
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    bnode, me = _name("_:n", "n_nationkey"), _name("n:", "n_nationkey")
    declared = spark.createDataFrame([("locatedIn",), ("hasBrand",), ("neverUsed",)], "name STRING")
    iri = _name("part:", "p_partkey")
    return (
        row(sub, F.col("child"), SUBCLASS, F.col("parent"), "iri")
        .unionAll(row(nodes, F.col("n"), TYPE, lit(CLASS), "iri"))
        .unionAll(row(nation, me, LABEL, F.col("n_name"), "lit", lang="en"))
        .unionAll(row(region, _name("r:", "r_regionkey"), LABEL, F.col("r_name"), "lit", lang="en"))
        .unionAll(row(part, iri, TYPE, F.concat(lit("type:"), F.regexp_replace("p_type", " ", "_")), "iri"))
        .unionAll(row(part, iri, LABEL, F.col("p_name"), "lit", lang="en"))
        .unionAll(row(part, iri, "hasBrand", F.col("p_brand"), "lit"))
        .unionAll(row(part.where("p_size > 40"), iri, "hasSize", F.col("p_size").cast("string"), "lit"))
        .unionAll(row(part.where("p_partkey % 50 = 0"), iri, TYPE, lit(CLASS), "iri"))
        .unionAll(row(declared, F.col("name"), TYPE, lit("owl:ObjectProperty"), "iri"))
        .unionAll(row(nation, me, SUBCLASS, bnode, "bnode"))
        .unionAll(row(nation, bnode, TYPE, lit("owl:Restriction"), "iri", s_kind="bnode"))
        .unionAll(row(nation, bnode, "owl:onProperty", lit("locatedIn"), "iri", s_kind="bnode"))
        .unionAll(row(nation, bnode, "owl:someValuesFrom", _name("r:", "n_regionkey"), "iri", s_kind="bnode"))
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, kind, weight, locus, subject, attribution, detail) from lineitem: flag
    and status give the code, the line number the locus, the part the subject."""
    code = F.concat(F.lit("K-"), F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "1").otherwise("2"))
    return table(spark, sf_dir, "lineitem").select(
        code.alias("code"), F.when(F.col("l_returnflag") == "N", "coverage").otherwise("defect").alias("kind"),
        F.when(F.col("l_returnflag") == "A", 3.0).when(F.col("l_returnflag") == "R", 1.5).otherwise(0.0).alias("weight"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("locus"), F.col("l_partkey").alias("subject"),
        F.when(F.col("l_discount") < 0.03, "translation").when(F.col("l_discount") < 0.07, "source").otherwise("undetermined").alias("attribution"),
        F.concat(F.lit("line of "), F.col("l_returnflag"), F.lit(" shipped in "), F.year("l_shipdate").cast("string")).alias("detail"),
    )


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locus, class): which parts are bound to which line number."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("locus"), F.col("l_partkey").alias("class")).distinct()


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, run, phase, ms) from events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("run"), F.col("event_type").alias("phase"), F.col("value").alias("ms"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, phase, input_tokens, cached_tokens, output_tokens) from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.concat(F.lit("phase_"), F.col("l_returnflag")).alias("phase"),
        F.col("l_extendedprice").cast("bigint").alias("input_tokens"), (F.col("l_extendedprice") * F.col("l_discount") * 5).cast("bigint").alias("cached_tokens"),
        F.col("l_quantity").cast("bigint").alias("output_tokens"),
    )
