"""Audits of a triple set beyond the census: definitional shape, coverage, finalising
gates, and the detectors that need restrictions of several relations.

A structural audit finds faults; it never certifies that none is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled, written
from . import graph
from .detectors import finding
from .triples import ALL, BUILTIN, CLASS, COMPLEMENT, DISJOINT, EQUIVALENT, LABEL, ON, RESTRICTION, SOME, SUBCLASS, TYPE, classes, labels, restrictions, subclass_edges

DEFINITION, COMMENT, STATUS, INTERSECTION = "obo:IAO_0000115", "rdfs:comment", "working:definitionStatus", "owl:intersectionOf"
DIFFERENTIA = [SOME, ALL, "owl:hasValue", COMPLEMENT, "owl:qualifiedCardinality", "owl:minQualifiedCardinality", "owl:maxQualifiedCardinality"]
META = r"(?i)\((?:reuse|instance|class|example[^)]*)\)|^example\b"
STANDARD = r"^(?!rdf:|rdfs:|owl:)[^:]*[:#](?:rdf|rdfs|owl|ro|bfo)[:#]\w+$|^working:(?:subClassOf|type|label|comment|domain|range)$"


def typed_closure(triples: DataFrame) -> DataFrame:
    """HIER-2: (node, ancestor, depth) over subclass and type edges between names."""
    edges = triples.where(F.col("p").isin(SUBCLASS, TYPE) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri") & ~F.col("o").rlike(r"^(?:rdf|rdfs|owl):"))
    return graph.closure(edges.select(F.col("s").alias("child"), F.col("o").alias("parent")))


def equivalence_cycles(triples: DataFrame) -> DataFrame:
    """HIER-9: (node): names that reach themselves over equivalence."""
    edges = triples.where((F.col("p") == EQUIVALENT) & (F.col("o_kind") == "iri")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    return graph.cyclic_nodes(graph.closure(edges))


def anonymous(triples: DataFrame) -> DataFrame:
    """(class, node): the anonymous classes a named one is under or equals, with the
    members of their intersections."""
    held = triples.where(F.col("p").isin(SUBCLASS, EQUIVALENT) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "bnode")).select(F.col("s").alias("class"), F.col("o").alias("node"))
    return held.distinct()


def members_of(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, member, member_kind) of intersections, from ``lists(head, member)``."""
    heads = triples.where(F.col("p") == INTERSECTION).select(F.col("s").alias("node"), F.col("o").alias("head"))
    return heads.join(lists.select("head", "member"), "head").select("node", "member", F.when(F.col("member").startswith("_:"), "bnode").otherwise("iri").alias("member_kind"))


def differentiated(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """HIER-21: (class): classes that say more than what they are under: a disjointness,
    or an anonymous class with a restriction, a complement or an anonymous member."""
    held, inner = anonymous(triples), members_of(triples, lists)
    told = triples.where(F.col("p").isin(*DIFFERENTIA)).select(F.col("s").alias("node")).unionAll(inner.where("member_kind = 'bnode'").select("node")).distinct()
    apart = triples.where((F.col("p") == DISJOINT) & (F.col("s_kind") == "iri")).select(F.col("s").alias("class"))
    return held.join(told, "node", "left_semi").select("class").unionAll(apart).distinct()


def complement_only(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """HIER-21: (class): classes defined only by what they exclude."""
    negative = triples.where(F.col("p") == COMPLEMENT).select(F.col("s").alias("node")).distinct()
    held, inner = anonymous(triples), members_of(triples, lists)
    marked = inner.join(negative.select(F.col("node").alias("member"), F.lit(True).alias("neg")), "member", "left").groupBy("node").agg(F.bool_and(F.coalesce("neg", F.lit(False))).alias("all"))
    only = negative.unionAll(marked.where("all").select("node")).distinct()
    return held.join(only, "node", "left_semi").select("class").distinct()


def residual(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """HIER-21, KA-B3: (class, why): defined by complement alone, or without differentia
    beside a sibling that has one. Where nothing is defined by equivalence the question
    cannot be asked: one row ``silent``."""
    triples = written(triples)
    named, told = classes(triples), written(differentiated(triples, lists))
    edges = subclass_edges(triples).join(named.select(F.col("class").alias("child")), "child")
    parents = edges.join(told.select(F.col("class").alias("child")), "child", "left_semi").select("parent").distinct()
    bare = edges.join(parents, "parent", "left_semi").select(F.col("child").alias("class")).distinct().join(told, "class", "left_anti")
    rows = complement_only(triples, lists).select("class", F.lit("complement only").alias("why")).unionAll(bare.select("class", F.lit("no differentia beside its siblings").alias("why")))
    asked = triples.where(F.col("p") == EQUIVALENT).limit(1)
    silent = triples.sparkSession.range(1).join(asked, F.lit(True), "left_anti").select(F.lit(None).cast("string").alias("class"), F.lit("silent").alias("why"))
    one = asked.select(F.lit(1).alias("asked"))
    return rows.join(F.broadcast(one), F.lit(True), "left_semi").unionAll(silent)


def metrics(triples: DataFrame) -> DataFrame:
    """AUD, AGG-1, 2: (metric, value): the census and audit of a triple set, rates in
    percent of its classes."""
    said = triples
    triples = settled(lambda: said)
    is_, held = F.col("p") == TYPE, restrictions(triples)
    some = lambda rows: F.coalesce(F.bool_or(rows), F.lit(False))
    has = lambda p: some((F.col("p") == p) & (F.col("o") != ""))
    # What is said of a subject is told once; the metrics of subjects are sums over these rows.
    facts = written(triples.groupBy("s").agg(
        some(is_ & (F.col("o") == CLASS) & (F.col("s_kind") == "iri")).alias("class"), has(LABEL).alias("labelled"), has(DEFINITION).alias("defined"), has(COMMENT).alias("commented"),
        some((F.col("p") == STATUS) & (F.col("o") == "absent-in-source")).alias("deferred"), F.count_if(is_ & (F.col("o") == RESTRICTION)).alias("restrictions"), some(F.col("p").isin(SOME, ALL, "owl:hasValue")).alias("filled"),
    ))
    named = facts.where("class").select(F.col("s").alias("class"))
    edges = written(subclass_edges(triples).distinct())
    count = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    intended = triples.where(~F.col("p").rlike(BUILTIN) & (F.col("o_kind") == "iri")).select("s", "o").join(named.select(F.col("class").alias("s")), "s", "left_semi").join(named.select(F.col("class").alias("o")), "o", "left_semi")
    # Where classes are under each other, all reach all: only what is between such groups is closed.
    rows = settled(lambda: graph.condensed(edges))
    reach = settled(lambda: graph.condensed_reach(rows))
    known = named.where(~F.col("class").startswith("obo:")).join(graph.condensed_under(rows, reach, "obo:").withColumnRenamed("child", "class"), "class", "left_anti")

    def counts(df: DataFrame, **sums: Column) -> DataFrame:
        one = df.agg(*[F.coalesce(F.sum(v.cast("bigint")), F.lit(0)).cast("double").alias(k) for k, v in sums.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in sums])))

    named_, upper = F.col("class"), F.col("filler").startswith("obo:")
    malformed = F.col("s").rlike(r"#\w+:\w+|[\s<>{}|\\^`]|^working:\w+:\w+|^working:(?:BFO|RO|IAO)_\d+")
    parts = [
        counts(triples, triples=F.lit(1), mangled_standard_predicates=F.col("p").rlike(STANDARD), local_disjointness=(F.col("p") == DISJOINT) & ~F.col("s").startswith("obo:"), meta_labels=(F.col("p") == LABEL) & F.col("o").rlike(META)),
        counts(
            facts, classes=named_, labelled=named_ & F.col("labelled"), defined=named_ & F.col("defined"), defined_or_deferred=named_ & (F.col("defined") | F.col("deferred")), commented=named_ & F.col("commented"),
            malformed_iris=malformed, empty_restrictions=F.when(~F.col("filled"), F.col("restrictions")),
        ),
        counts(held, restrictions=F.lit(1), upper_fillers=upper, domain_fillers=~upper), count(edges, "subclass_axioms"), count(intended, "punned_triples"),
        count(graph.condensed_redundant(rows, reach), "redundant_parents"), count(graph.multi_parents(edges), "multi_parents"), count(known, "unanchored"),
        edges.groupBy("parent").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).cast("double").alias("value")).select(F.lit("max_fan_out").alias("metric"), "value"),
    ]
    values = parts[0]
    for part in parts[1:]:
        values = values.unionAll(part)
    out = settled(lambda: values)
    wide = out.groupBy().pivot("metric", ["classes", "restrictions", "punned_triples", "defined", "defined_or_deferred"]).agg(F.first("value"))
    seen = F.col("restrictions") + F.col("punned_triples")
    rates = wide.select(F.inline(F.array(
        F.struct(F.lit("visibility_ratio").alias("metric"), F.when(seen == 0, 1.0).otherwise(F.round(F.col("restrictions") / seen, 6)).alias("value")),
        F.struct(F.lit("definition_coverage").alias("metric"), F.round(F.col("defined") / F.greatest("classes", F.lit(1.0)), 6).alias("value")),
        F.struct(F.lit("definition_coverage_faithful").alias("metric"), F.round(F.col("defined_or_deferred") / F.greatest("classes", F.lit(1.0)), 6).alias("value")),
    )))
    return out.unionAll(rates)


def dangling(triples: DataFrame, imported: DataFrame | None) -> DataFrame:
    """JOIN-7: (iri, code): names of an imported namespace that the import does not
    define; without an import one row WARN."""
    spark = triples.sparkSession
    if imported is None:
        return spark.createDataFrame([(None, "WARN_NO_IMPORT")], "iri STRING, code STRING")
    used = triples.select(F.col("s").alias("iri")).unionAll(triples.where("o_kind = 'iri'").select("o")).where(F.col("iri").startswith("obo:")).distinct()
    return used.join(imported.select(F.col("s").alias("iri")).distinct(), "iri", "left_anti").select("iri", F.lit("E_DANGLING").alias("code"))


# ---------------------------------------------------------------- detectors

def ck_a2(verdicts: DataFrame | None, spark) -> DataFrame:
    """CK-A2 takes what a reasoner found, ``verdicts(class, satisfiable)``; without one it
    is not computed, which is not zero."""
    if verdicts is None:
        return spark.createDataFrame([("CK", "K-A2", None, "not computed")], "family STRING, code STRING, subject STRING, detail STRING")
    return finding(verdicts.where("not satisfiable"), "CK", "K-A2", "class", F.lit("unsatisfiable"))


def ck_b1(edges: DataFrame) -> DataFrame:
    """Cycles of each relation of ``edges(relation, child, parent)``; the relations are
    kept apart by a prefix, so that one closure serves all."""
    name = lambda c: F.concat_ws("\x01", "relation", c)
    reach = graph.closure(edges.where("child is not null and parent is not null").select(name("child").alias("child"), name("parent").alias("parent")))
    rows = graph.cycle_components(reach).groupBy("component").agg(F.count("*").alias("n")).select(F.substring_index("component", "\x01", 1).alias("relation"), F.substring_index("component", "\x01", -1).alias("subject"), "n")
    return finding(rows, "CK", "K-B1", "subject", F.concat(F.col("relation"), F.lit(" cycle of "), F.col("n").cast("string")))


# What each link commits a class to, any of the upper classes.
EXPECTED = [
    ("L1", ["BFO_0000040", "BFO_0000030", "BFO_0000004", "BFO_0000023"]), ("L2", ["BFO_0000031"]), ("L3", ["BFO_0000023"]), ("L4", ["BFO_0000031"]),
    ("L5", ["BFO_0000015"]), ("L6", ["BFO_0000023", "BFO_0000016", "BFO_0000017"]), ("L7", ["BFO_0000015"]),
]


def ck_b3(placed: DataFrame, reach: DataFrame) -> DataFrame:
    """CK-B3: ``placed(class, link)`` that are none of what the link expects; ``reach`` is
    reflexive over upper names."""
    wanted = F.broadcast(placed.sparkSession.createDataFrame([(link, c) for link, held in EXPECTED for c in held], "link STRING, ancestor STRING"))
    known = placed.join(wanted.select("link").distinct(), "link", "left_semi")
    fits = known.join(reach.select(F.col("node").alias("class"), "ancestor"), "class").join(wanted, ["link", "ancestor"]).select("class", "link").distinct()
    return finding(known.join(fits, ["class", "link"], "left_anti").distinct(), "CK", "K-B3", "class", F.concat(F.lit("at "), "link"))


def ck_c2(held: DataFrame, reach: DataFrame, placed: DataFrame) -> DataFrame:
    """CK-C2: realised but not realizable; a realizable that inheres in an occurrent; an
    occurrent that bears; an assessor that is a disposition, not a role. ``held(class,
    property, filler)``, ``reach`` reflexive over upper names."""
    under = lambda upper, name: reach.where(F.col("ancestor") == upper).select(F.col("node").alias(name)).distinct()
    of = lambda p: held.where(F.col("property") == p).select("class", "filler").distinct()
    realised = of("BFO_0000054").join(under("BFO_0000017", "class"), "class", "left_anti").select("class", F.concat(F.lit("realized in "), "filler").alias("why"))
    inhering = of("BFO_0000197").join(under("BFO_0000017", "class"), "class", "left_semi").join(under("BFO_0000003", "filler"), "filler", "left_semi").select("class", F.concat(F.lit("inheres in occurrent "), "filler").alias("why"))
    bearing = of("BFO_0000196").join(under("BFO_0000003", "class"), "class", "left_semi").select("class", F.concat(F.lit("occurrent bears "), "filler").alias("why"))
    office = placed.where("link = 'L3'").select("class").distinct().join(under("BFO_0000023", "class"), "class", "left_anti").join(under("BFO_0000016", "class"), "class", "left_semi").select("class", F.lit("assessor as disposition").alias("why"))
    return finding(realised.unionAll(inhering).unionAll(bearing).unionAll(office).distinct(), "CK", "K-C2", "class", F.col("why"))


def ck_d2_self(repairs: DataFrame) -> DataFrame:
    """CK-D2: ``repairs(path, act)`` in which a path repairs itself."""
    return finding(repairs.where("path = act").distinct(), "CK", "K-D2", "path", F.lit("repairs itself"))


def ck_d3_shared(excludes: DataFrame, preconditions: DataFrame) -> DataFrame:
    """CK-D3, the second shape, JOIN-5: a path that bars another shares a precondition
    with a third: ``excludes(path, other)``, ``preconditions(path, condition)``. The
    first one bars, so the conditions are met from it, never all with all."""
    pre = preconditions.distinct()
    barring = excludes.where("path <> other").distinct().join(pre, "path")
    met = barring.join(pre.select(F.col("path").alias("third"), "condition"), "condition").where("third <> path and third <> other")
    shared = met.groupBy("path", "other", "third").agg(F.array_join(F.array_sort(F.collect_set(F.col("condition").cast("string"))), ",").alias("conditions"))
    return finding(shared, "CK", "K-D3", "path", F.concat_ws(" ", F.lit("bars"), "other", F.lit("while"), "third", F.lit("is open under"), "conditions"))


def bearing_dispositions(held: DataFrame, reach: DataFrame, dependent: str, disposition: str, bears: list[str]) -> DataFrame:
    """ICD-2: (class, filler): dependent classes that bear a disposition."""
    under = lambda upper, name: reach.where(F.col("ancestor") == upper).select(F.col("node").alias(name)).distinct()
    rows = held.where(F.col("property").isin(*bears)).join(under(dependent, "class"), "class", "left_semi").join(under(disposition, "filler"), "filler", "left_semi")
    return rows.select("class", "filler").distinct()


def substantive(held: DataFrame, upper: str) -> DataFrame:
    """ICD-3: restrictions that say something: no self filler, none filled by the top."""
    return held.where((F.col("class") != F.col("filler")) & (F.col("filler") != upper)).distinct()


def blast_radius(groups: DataFrame, unsatisfiable: DataFrame, edges: DataFrame) -> DataFrame:
    """X-4: (grp, direct, cascade): of ``unsatisfiable(class)`` those in a group of
    ``groups(grp, class)``, and those that only descend from one."""
    hit = groups.join(unsatisfiable, "class", "left_semi")
    reach = graph.closure(edges).select(F.col("node").alias("below"), F.col("ancestor").alias("class"))
    cascade = hit.join(reach, "class").select("grp", F.col("below").alias("class")).distinct().join(unsatisfiable, "class", "left_semi").join(groups, ["grp", "class"], "left_anti")
    counted = hit.groupBy("grp").agg(F.count_distinct("class").alias("direct")).join(cascade.groupBy("grp").agg(F.count("*").alias("cascade")), "grp", "left")
    return counted.select("grp", "direct", F.coalesce("cascade", F.lit(0)).alias("cascade"))


# ---------------------------------------------------------------- coverage and gates

def rate(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(100 * part / whole, 2))


def definition_coverage(named: DataFrame, defined: DataFrame, deferred: DataFrame) -> DataFrame:
    """LINT-1: (population, covered, deferred, pct): of ``named(term)``; deferred terms are
    out of the population, and an empty one is covered to 0 percent."""
    rows = named.select("term").distinct().join(defined.select("term", F.lit(1).alias("d")).distinct(), "term", "left").join(deferred.select("term", F.lit(1).alias("x")).distinct(), "term", "left")
    one = rows.agg(F.count_if(F.col("x").isNull() | F.col("d").isNotNull()).alias("population"), F.count("d").alias("covered"), F.count_if(F.col("x").isNotNull() & F.col("d").isNull()).alias("deferred"))
    return one.withColumn("pct", rate(F.col("covered"), F.col("population"), 0.0))


def capacity_realization(capacities: DataFrame, realised: DataFrame) -> DataFrame:
    """LINT-1: (population, covered, pct) of capacities that something realises; an empty
    population is covered to 100 percent."""
    rows = capacities.select("term").distinct().join(realised.select("term", F.lit(1).alias("r")).distinct(), "term", "left")
    return rows.agg(F.count("*").alias("population"), F.count("r").alias("covered")).withColumn("pct", rate(F.col("covered"), F.col("population"), 100.0))


def finalize(gates: DataFrame, measured: DataFrame, waivers: DataFrame) -> DataFrame:
    """FIN-1, X-15: (gate, value, least, state) of ``gates(gate, least)`` against
    ``measured(gate, value)``: passed, failed, waived, or not evaluated, which blocks as a
    failure does."""
    rows = gates.join(measured, "gate", "left").join(waivers.select("gate", F.lit(True).alias("waived")).distinct(), "gate", "left")
    state = F.when(F.col("value") >= F.col("least"), "passed").when(F.col("waived"), "waived").when(F.col("value").isNull(), "not evaluated").otherwise("failed")
    return rows.select("gate", "value", "least", state.alias("state"), state.isin("failed", "not evaluated").alias("blocks"))


def probes(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """RES-1: (precondition, satisfied, evidence) of ``rules(precondition, metric, least)``
    against ``counts(metric, value)``; null where nothing was measured."""
    rows = rules.join(counts, "metric", "left")
    return rows.select("precondition", (F.col("value") >= F.col("least")).alias("satisfied"), F.when(F.col("value").isNotNull(), F.concat(F.col("metric"), F.lit("="), F.col("value").cast("bigint").cast("string"))).alias("evidence"))


def chain_validation(links: DataFrame) -> DataFrame:
    """RES-4: (locus, rule) of ``links(locus, ordinal, classes, declared, as_of)``: a link
    declared thick with fewer than three classes, a gap before a link that has classes, a
    declaration that is no date or older than the newest by more than a year."""
    from pyspark.sql import Window

    day = F.to_date(F.try_to_timestamp("as_of", F.lit("yyyy-MM-dd")))
    rows = links.withColumn("day", day).withColumn("newest", F.max(day).over(Window.partitionBy(F.lit(1)))).withColumn("before", F.lag("classes").over(Window.partitionBy(F.lit(1)).orderBy("ordinal")))
    tests = [("thickness", (F.col("declared") == "thick") & (F.col("classes") < 3)), ("gap", (F.col("before") == 0) & (F.col("classes") > 0)), ("no date", F.col("as_of").isNotNull() & F.col("day").isNull()), ("stale", F.datediff("newest", "day") > 365)]
    return rows.select("locus", F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))).alias("rule"))


def older_debt(findings: DataFrame) -> DataFrame:
    """DEBT-2: the count without a registry: findings by code, translation apart."""
    return findings.where(~F.col("attribution").eqNullSafe("translation")).groupBy("code").agg(F.count("*").alias("debt"))


def located_findings(findings: DataFrame, anchors: DataFrame, defaults: DataFrame) -> DataFrame:
    """DEBT-4: findings with the locus of their subject's anchor, else that of their code."""
    return findings.join(anchors.withColumnRenamed("locus", "own"), "subject", "left").join(F.broadcast(defaults.withColumnRenamed("locus", "usual")), "code", "left").withColumn("at", F.coalesce("own", "usual")).drop("own", "usual")


def retyped_acts(findings: DataFrame, acts: DataFrame) -> DataFrame:
    """DEBT-5: K-A2 on an act becomes K-D2, replaced and not added."""
    hit = F.col("act").isNotNull() & (F.col("code") == "K-A2")
    return findings.join(acts.select("subject", F.lit(True).alias("act")).distinct(), "subject", "left").withColumn("code", F.when(hit, "K-D2").otherwise(F.col("code"))).drop("act")


def debt_band(score: Column) -> Column:
    """COV-2: coherent, warning or failure."""
    return F.when(score == 0, "coherent").when(score < 100, "warning").otherwise("failure")


def adjudicated(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """ADJ-1: each row with the verdict of the first rule that holds, else ``open``."""
    out = F.lit("open")
    for verdict, test in reversed(rules):
        out = F.when(test, verdict).otherwise(out)
    return rows.withColumn("verdict", out)


def with_default(rows: DataFrame, extra: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """JOIN-11: ``extra(key, column)`` onto rows, with a default where it has none."""
    return rows.join(extra, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


# ---------------------------------------------------------------- legal reports

def legal_checks(held: DataFrame, independent: DataFrame, triples: DataFrame) -> DataFrame:
    """LEGAL-1: (check, findings): D1 universal bearers, D2 several bearers, D3 labels of
    several names, D4 classes without a definition, D6 isolated classes."""
    triples = written(triples)
    bears, inheres = held.where(F.col("property").isin("BFO_0000196", "obo:BFO_0000196")), held.where(F.col("property").isin("BFO_0000197", "obo:BFO_0000197"))
    multi = inheres.groupBy("class").agg(F.count_distinct("filler").alias("n")).where("n > 1")
    shared = labels(triples).where("label <> ''").groupBy("label").agg(F.count_distinct("iri").alias("n")).where("n > 1")
    bare = classes(triples).join(triples.where((F.col("p") == DEFINITION) & (F.col("o") != "")).select(F.col("s").alias("class")).distinct(), "class", "left_anti")
    used = triples.where(~F.col("p").isin(TYPE, LABEL, DEFINITION, COMMENT) & (F.col("o_kind") != "lit"))
    alone = classes(triples).join(used.select(F.col("s").alias("class")).unionAll(used.select("o")).distinct(), "class", "left_anti")
    named = {"D1 bearer universal": bears.join(independent, "class", "left_semi"), "D2 multi-bearer": multi, "D3 shared label": shared, "D4 undefined": bare, "D6 isolated": alone}
    out = None
    for check, df in named.items():
        row = df.agg(F.count("*").alias("findings")).select(F.lit(check).alias("check"), "findings")
        out = row if out is None else out.unionAll(row)
    return out


def draft_report(triples: DataFrame) -> DataFrame:
    """LEGAL-2, X-11: (part, n): classes, restrictions by quantifier, spans, scoped senses and
    definitions absent in the source."""
    held = restrictions(triples)
    is_p = lambda p: triples.where(F.col("p") == p).agg(F.count("*").alias("n"))
    parts = {"classes": classes(triples).agg(F.count("*").alias("n")), "spans": is_p("working:sourceSpan"), "scoped": is_p("working:scopedSenseOf"), "absent": triples.where((F.col("p") == STATUS) & (F.col("o") == "absent-in-source")).agg(F.count("*").alias("n"))}
    out = held.groupBy(F.concat(F.lit("restrictions "), "quantifier").alias("part")).agg(F.count("*").alias("n"))
    for name, df in parts.items():
        out = out.unionAll(df.select(F.lit(name).alias("part"), "n"))
    return out


def scoped_senses(definitions: DataFrame) -> DataFrame:
    """X-11: (label, act, sense, general): of ``definitions(label, act, text, operative,
    ordinal)`` one sense an act, equal texts share the first act's sense, and the general
    class keeps the operative text that came first."""
    from ..functions.text import label_norm

    keyed = definitions.where("label is not null and text is not null").withColumn("key", label_norm(F.col("text")))
    order = F.struct((~F.coalesce("operative", F.lit(False))).alias("late"), "ordinal")
    sense = keyed.groupBy("label", "act").agg(F.min(F.struct(order.alias("o"), "key")).alias("s")).select("label", "act", F.col("s.key").alias("key"))
    first = keyed.groupBy("label", "key").agg(F.min(F.struct(order.alias("o"), "act")).alias("f")).select("label", "key", F.col("f.act").alias("sense"))
    general = keyed.groupBy("label").agg(F.min(F.struct(order.alias("o"), "act")).alias("g")).select("label", F.col("g.act").alias("general"))
    return sense.join(first, ["label", "key"]).join(general, "label").select("label", "act", "sense", (F.col("act") == F.col("general")).alias("general"))


def _shifted(i: int, step: int):
    return lambda cell, at: F.when(at == i, cell + step).otherwise(cell)


def vector_clusters(vectors: DataFrame, threshold: float = 0.92, high: float = 0.96, pivots: int = 3) -> DataFrame:
    """HIER-16: (vec_id, cluster, least, confidence): components of ``vectors(vec_id, v)``
    over pairs with a cosine of ``threshold`` or more; ``least`` is the smallest such
    cosine in the cluster, of high confidence from ``high`` on.

    Of unit vectors with that cosine the distances to any pivot differ by at most
    r = sqrt(2 - 2 * threshold). Distances to ``pivots`` vectors of the table, the only
    rows the driver sees, are cut into cells of width r, and only neighbouring cells
    meet: no pair is lost."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.where("vec_id is not null and v is not null").dropDuplicates(["vec_id"]).withColumn("n", norm).where("n > 0").select("vec_id", F.expr("transform(v, x -> cast(x / n as double))").alias("v"))
    radius = (2 - 2 * threshold) ** 0.5
    chosen = [r["v"] for r in unit.orderBy("vec_id").select("v").limit(pivots).collect()]
    far = [F.sqrt(F.aggregate(F.zip_with("v", F.array(*map(F.lit, p)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)) for p in chosen]
    cells = unit.withColumn("cell", F.array(*[F.floor(d / radius) for d in far]) if far else F.array())
    near = cells
    for i in range(len(chosen)):
        near = near.withColumn("cell", F.explode(F.array(*[F.transform("cell", _shifted(i, s)) for s in (-1, 0, 1)])))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = cells.join(near.select(F.col("vec_id").alias("other"), F.col("v").alias("w"), "cell"), "cell").where("vec_id < other").withColumn("cosine", dot).where(F.col("cosine") >= threshold).select("vec_id", "other", "cosine").distinct()
    pairs = written(pairs)
    groups = graph.components(pairs.select(F.col("vec_id").alias("src"), F.col("other").alias("dst"))).withColumnRenamed("component", "cluster")
    least = pairs.join(groups.withColumnRenamed("node", "vec_id"), "vec_id").groupBy("cluster").agg(F.round(F.min("cosine"), 4).alias("least"))
    return groups.join(least, "cluster").select(F.col("node").alias("vec_id"), "cluster", "least", F.when(F.col("least") >= high, "high").otherwise("medium").alias("confidence"))
