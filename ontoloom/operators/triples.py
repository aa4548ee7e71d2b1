"""Views, census and audit of a triple set, and rewrites of it.

``triples(s, s_kind, p, o, o_kind, o_lang, source)`` is a set: duplicates at load
are dropped by ``load``. Predicates and classes are compact names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_key

SUBCLASS, TYPE, LABEL, CLASS = "rdfs:subClassOf", "rdf:type", "rdfs:label", "owl:Class"
RESTRICTION, ON, SOME, ALL = "owl:Restriction", "owl:onProperty", "owl:someValuesFrom", "owl:allValuesFrom"
DISJOINT, COMPLEMENT, EQUIVALENT = "owl:disjointWith", "owl:complementOf", "owl:equivalentClass"
BUILTIN = r"^(rdf|rdfs|owl|skos|dc|obo):"


def load(*sources: DataFrame) -> DataFrame:
    """SRC-2: the union of sources as a set; ``source`` tells them apart."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["s", "p", "o", "source"])


# ---------------------------------------------------------------- views

def pattern(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """FLT-1: the triples with any of the positions bound."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == value)
    return triples


def classes(triples: DataFrame, namespace: str = "") -> DataFrame:
    """FLT-2: the named classes, of a namespace if one is given."""
    triples = triples.where(F.col("s").startswith(namespace))
    return triples.where((F.col("p") == TYPE) & (F.col("o") == CLASS) & (F.col("s_kind") == "iri")).select(F.col("s").alias("class")).distinct()


def individuals(triples: DataFrame) -> DataFrame:
    typed = triples.where((F.col("p") == TYPE) & (F.col("s_kind") == "iri") & ~F.col("o").rlike(BUILTIN))
    return typed.select(F.col("s").alias("individual"), F.col("o").alias("class")).distinct()


def labels(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == LABEL).select(F.col("s").alias("iri"), F.col("o").alias("label"))


def subclass_edges(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") == SUBCLASS) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(F.col("s").alias("child"), F.col("o").alias("parent"))


def restrictions(triples: DataFrame) -> DataFrame:
    """(class, property, quantifier, filler): FLT-4, over the blank node's triples."""
    held = triples.where((F.col("p").isin(SUBCLASS, EQUIVALENT)) & (F.col("o_kind") == "bnode")).select(F.col("s").alias("class"), F.col("o").alias("node"))
    bnodes = triples.where(F.col("s_kind") == "bnode")
    typed = bnodes.where((F.col("p") == TYPE) & (F.col("o") == RESTRICTION)).select(F.col("s").alias("node"))
    on = bnodes.where(F.col("p") == ON).select(F.col("s").alias("node"), F.col("o").alias("property"))
    fill = bnodes.where(F.col("p").isin(SOME, ALL)).select(F.col("s").alias("node"), F.when(F.col("p") == SOME, "some").otherwise("all").alias("quantifier"), F.col("o").alias("filler"))
    return held.join(typed, "node").join(on, "node").join(fill, "node").select("class", "property", "quantifier", "filler")


def disjoint_pairs(triples: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: FLT-5, SET-7; the pairwise form and ``members(group, class)`` of
    the list form, both expanded."""
    pairs = triples.where(F.col("p") == DISJOINT).select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"))
    if members is not None:
        other = members.select("group", F.col("class").alias("b"))
        pairs = pairs.unionAll(members.select("group", F.col("class").alias("a")).join(other, "group").where("a < b").select("a", "b"))
    return pairs.where("a <> b").distinct()


def local_name(iri: Column, variant: int = 1) -> Column:
    """FLT-3: the three readings of an IRI's local name."""
    if variant == 1:
        return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)
    if variant == 2:
        return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))
    return F.element_at(F.split(iri, "[#/]"), -1)


# ---------------------------------------------------------------- census and audit

def census(triples: DataFrame) -> DataFrame:
    """AGG-1: one row of counts, in one pass."""
    is_type = F.col("p") == TYPE
    named = F.col("s_kind") == "iri"
    classes_ = F.count_distinct(F.when(is_type & (F.col("o") == CLASS) & named, F.col("s")))
    return triples.agg(
        F.count("*").alias("triples"), classes_.alias("classes"), F.count_distinct(F.when(is_type & ~F.col("o").rlike(BUILTIN), F.col("s"))).alias("individuals"),
        F.count_distinct(F.when(is_type & F.col("o").endswith("Property"), F.col("s"))).alias("properties"), F.count_if(F.col("p") == SUBCLASS).alias("subclass_axioms"),
        F.count_if(is_type & (F.col("o") == RESTRICTION)).alias("restrictions"), F.count_distinct(F.when(F.col("p") == LABEL, F.col("s"))).alias("labelled"),
        F.count_if(F.col("o_kind") == "lit").alias("literals"),
    )


def relation_usage(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count("*").alias("uses"), F.count_distinct("s").alias("subjects"))


def undeclared(triples: DataFrame) -> DataFrame:
    """JOIN-6: (property, problem): used but not declared; declared, but used by no
    triple and no restriction."""
    declared = triples.where((F.col("p") == TYPE) & F.col("o").endswith("Property")).select(F.col("s").alias("property")).distinct()
    used = triples.where(~F.col("p").rlike(BUILTIN)).select(F.col("p").alias("property")).distinct()
    restricted = triples.where(F.col("p") == ON).select(F.col("o").alias("property")).distinct()
    lacking = used.join(declared, "property", "left_anti").withColumn("problem", F.lit("undeclared"))
    return lacking.unionAll(declared.join(used.unionAll(restricted), "property", "left_anti").withColumn("problem", F.lit("unused")))


def punned(triples: DataFrame) -> DataFrame:
    """SET-3, KA-C2: names that are a class and an individual."""
    return classes(triples).select(F.col("class").alias("iri")).intersect(individuals(triples).select("individual"))


def visibility(triples: DataFrame) -> DataFrame:
    """AUD: intended class relations, those that are axioms a reasoner sees, ratio
    (one when none is intended)."""
    seen = restrictions(triples).select("class", "property", "filler").distinct().agg(F.count("*").alias("n"))
    both = classes(triples)
    bare = triples.where(~F.col("p").rlike(BUILTIN) & (F.col("o_kind") == "iri")).join(both.select(F.col("class").alias("s")), "s", "left_semi").agg(F.count("*").alias("n"))
    one = seen.select("n", F.lit(1).alias("v")).unionAll(bare.select("n", F.lit(0))).agg(F.sum(F.when(F.col("v") == 1, F.col("n"))).alias("visible"), F.sum("n").alias("intended"))
    return one.select("visible", "intended", F.when(F.col("intended") == 0, 1.0).otherwise(F.round(F.col("visible") / F.col("intended"), 6)).alias("ratio"))


def malformed(names: DataFrame) -> DataFrame:
    """LEX-6: (iri, kind) of ``names(iri)``; the first fault counts."""
    kind = (
        F.when(F.col("iri").rlike(r"[\s<>\"{}|\\^`]"), "illegal_character")
        .when(F.col("iri").rlike(r"#\w+:\w+"), "curie_in_fragment")
        .when(F.col("iri").rlike(r"working#(?:BFO|RO|IAO)_\d+"), "upper_id_in_local_namespace")
    )
    return names.select("iri", kind.alias("kind")).where("kind is not null")


def synonym_clusters(labelled: DataFrame) -> DataFrame:
    """HIER-18: (key, members, first) of labels with one key; the empty key is a
    bucket. Members are counted, not gathered."""
    return labelled.groupBy(label_key(F.col("label")).alias("key")).agg(F.count("*").alias("members"), F.min("iri").alias("first")).where("members > 1")


def shared_labels(labelled: DataFrame) -> DataFrame:
    """HIER-19."""
    return labelled.where("label <> ''").groupBy("label").agg(F.count_distinct("iri").alias("iris")).where("iris > 1")


def isolated(triples: DataFrame) -> DataFrame:
    """HIER-20: individuals that no relation leaves or reaches."""
    relation = triples.where(~F.col("p").rlike(BUILTIN) & (F.col("o_kind") == "iri"))
    touched = relation.select(F.col("s").alias("individual")).unionAll(relation.select("o")).distinct()
    literal = triples.where(~F.col("p").rlike(BUILTIN)).select(F.col("s").alias("individual")).distinct()
    return individuals(triples).select("individual").distinct().join(touched, "individual", "left_anti").join(literal, "individual", "left_anti")


def shared_fillers(triples: DataFrame) -> DataFrame:
    """AGG-20: fillers that two classes or more use."""
    return restrictions(triples).groupBy("filler").agg(F.count_distinct("class").alias("classes")).where("classes > 1")


def validate(triples: DataFrame) -> DataFrame:
    """VAL-1: (rule, violations), the structural validator as rows."""
    bnodes = triples.where(F.col("s_kind") == "bnode")
    typed = bnodes.where(F.col("p") == TYPE).select("s").distinct()
    untyped = bnodes.select("s").distinct().join(typed, "s", "left_anti").agg(F.count("*").alias("violations"))
    lone = classes(triples).join(triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("class")).distinct(), "class", "left_anti").agg(F.count("*").alias("violations"))
    bare = classes(triples).join(labels(triples).select(F.col("iri").alias("class")).distinct(), "class", "left_anti").agg(F.count("*").alias("violations"))
    empty = bnodes.where((F.col("p") == TYPE) & (F.col("o") == RESTRICTION)).select("s").join(bnodes.where(F.col("p").isin(SOME, ALL)).select("s"), "s", "left_anti").agg(F.count("*").alias("violations"))
    named = {"untyped_anonymous": untyped, "ungrounded_class": lone, "class_without_label": bare, "restriction_without_filler": empty}
    out = None
    for rule, df in named.items():
        part = df.select(F.lit(rule).alias("rule"), "violations")
        out = part if out is None else out.unionAll(part)
    return out


# ---------------------------------------------------------------- rewrites

def merge_terms(triples: DataFrame, renamed: DataFrame) -> DataFrame:
    """MUT-2: subjects and objects by ``renamed(old, new)``, old labels kept as
    alternative labels, subclass loops dropped. Predicates are not renamed."""
    first, second = renamed.select(F.col("old").alias("s"), F.col("new").alias("new_s")), renamed.select(F.col("old").alias("o"), F.col("new").alias("new_o"))
    moved = triples.join(first, "s", "left").join(second, "o", "left")
    alias = (F.col("p") == LABEL) & F.col("new_s").isNotNull()
    rows = moved.select(
        F.coalesce("new_s", "s").alias("s"), "s_kind", F.when(alias, "skos:altLabel").otherwise(F.col("p")).alias("p"),
        F.when(F.col("o_kind") == "lit", F.col("o")).otherwise(F.coalesce("new_o", "o")).alias("o"), "o_kind", "o_lang", "source",
    )
    return rows.where(~((F.col("p") == SUBCLASS) & (F.col("s") == F.col("o")))).distinct()


def purge(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """MUT-4: without ``terms(term)`` and the restrictions filled by them."""
    dead = triples.where(F.col("p").isin(SOME, ALL)).join(terms.select(F.col("term").alias("o")), "o", "left_semi").select(F.col("s").alias("term"))
    gone = terms.select("term").unionAll(dead).distinct()
    return triples.join(gone.select(F.col("term").alias("s")), "s", "left_anti").join(gone.select(F.col("term").alias("o")), "o", "left_anti")


def declaration_repairs(triples: DataFrame) -> DataFrame:
    """MUT-5: (property, kind) to declare: a data property only if all uses are literals."""
    missing = undeclared(triples).where("problem = 'undeclared'").select(F.col("property").alias("p"))
    uses = triples.join(missing, "p", "left_semi").groupBy("p").agg(F.bool_and(F.col("o_kind") == "lit").alias("literal"))
    return uses.select(F.col("p").alias("property"), F.when(F.col("literal"), "owl:DatatypeProperty").otherwise("owl:ObjectProperty").alias("kind"))


def module_precedence(claims: DataFrame) -> DataFrame:
    """MUT-7: of ``claims(s, p, o, rank)`` the value of the lowest rank; ``conflict``
    tells whether the lowest rank disagrees with itself."""
    best = claims.groupBy("s", "p").agg(F.min("rank").alias("rank"))
    held = claims.join(best, ["s", "p", "rank"])
    return held.groupBy("s", "p", "rank").agg(F.min("o").alias("o"), (F.count_distinct("o") > 1).alias("conflict"))


def orphan_bnodes(triples: DataFrame, max_rounds: int = 30) -> DataFrame:
    """HIER-23: without the blank nodes that nothing refers to, to the fixpoint."""
    from ..session import written

    for _ in range(max_rounds):
        refs = triples.where(F.col("o_kind") == "bnode").select(F.col("o").alias("s")).distinct()
        loose = triples.where(F.col("s_kind") == "bnode").select("s").distinct().join(refs, "s", "left_anti")
        if loose.isEmpty():
            return triples
        triples = written(triples.join(loose, "s", "left_anti"))
    raise RuntimeError("orphan_bnodes: not settled")


def canonical_bnodes(triples: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """SNK-3: blank nodes renamed by the hash of what leaves them, so that equal structures
    are written equally. A node is named once all blank nodes it leads to are; of nodes
    in a cycle, which never are, the hash covers what leaves the cycle."""
    from ..session import written

    arcs = triples.where("s_kind = 'bnode'").select("s", "p", "o", "o_kind").distinct()
    ids = None
    for _ in range(max_rounds):
        if ids is None:
            open_, known = arcs.select("s").distinct(), arcs.where("false").select(F.col("s").alias("node"), F.col("s").alias("id"))
        else:
            known = ids
            open_ = arcs.select("s").distinct().join(known.select(F.col("node").alias("s")), "s", "left_anti")
        if open_.isEmpty():
            break
        told = arcs.join(open_, "s", "left_semi").join(known.toDF("o", "id"), "o", "left").join(arcs.select(F.col("s").alias("o"), F.lit(True).alias("inner")).distinct(), "o", "left")
        waits = F.coalesce("inner", F.lit(False)) & F.col("id").isNull()
        own = told.groupBy("s").agg(F.bool_or(waits).alias("waits"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(waits, F.col("p")).otherwise(F.concat_ws(" ", "p", F.coalesce("id", "o"))))), "|"), 256).alias("h"))
        ready = own.where("not waits")
        if ready.isEmpty():
            ready = own
        new = ready.select(F.col("s").alias("node"), F.concat(F.lit("_:"), F.substring("h", 1, 16)).alias("id"))
        ids = written(new if ids is None else known.unionAll(new))
    else:
        raise RuntimeError("canonical_bnodes: not settled")
    if ids is None:
        return triples.distinct()
    out = triples.join(ids.toDF("s", "id"), "s", "left").withColumn("s", F.coalesce("id", "s")).drop("id")
    out = out.join(ids.toDF("o", "id"), "o", "left").withColumn("o", F.when(F.col("o_kind") == "bnode", F.coalesce("id", "o")).otherwise(F.col("o"))).drop("id")
    return out.select(triples.columns).distinct()


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """X-17: (metric, before, after) of two (metric, value) audits where they differ."""
    both = before.toDF("metric", "before").join(after.toDF("metric", "after"), "metric", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def lowest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row by key, the first in order."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("i = 1").drop("i")


# ---------------------------------------------------------------- reports

def reduced_world(triples: DataFrame, touched: DataFrame) -> DataFrame:
    """HIER-22: the class axioms, the ``touched(individual)`` and what lies one step
    from them, by two semi-joins."""
    tbox = triples.where((F.col("p") == SUBCLASS) | ((F.col("p") == TYPE) & F.col("o").rlike(BUILTIN)) | (F.col("s_kind") == "bnode"))
    near = triples.join(touched.select(F.col("individual").alias("s")), "s", "left_semi")
    step = triples.join(near.where(F.col("o_kind") == "iri").select(F.col("o").alias("s")).distinct(), "s", "left_semi")
    return tbox.unionByName(near).unionByName(step).distinct()


def canonical_coverage(canonical: DataFrame, reach: DataFrame, typed: DataFrame, held: DataFrame) -> DataFrame:
    """CANON-1: of ``canonical(class)`` the subclasses, instances of these and
    restrictions on them; zero rows are kept."""
    below = reach.select(F.col("ancestor").alias("class"), F.col("node").alias("sub")).join(canonical, "class", "left_semi")
    subs = below.groupBy("class").agg(F.count("*").alias("subclasses"))
    instances = below.join(typed.select(F.col("class").alias("sub"), "individual"), "sub").groupBy("class").agg(F.count_distinct("individual").alias("instances"))
    used = held.groupBy(F.col("filler").alias("class")).agg(F.count("*").alias("restrictions"))
    rows = canonical.select("class").distinct().join(subs, "class", "left").join(instances, "class", "left").join(used, "class", "left")
    return rows.select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("subclasses", "instances", "restrictions")])


def quality_gates(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """FIN-2: (gate, value, bound, passed) of ``metrics(metric, value)`` against
    ``bounds(metric, least, most)``; a gate without a value is not passed."""
    rows = F.broadcast(bounds).join(metrics, "metric", "left")
    ok = (F.col("value") >= F.coalesce("least", F.lit(float("-inf")))) & (F.col("value") <= F.coalesce("most", F.lit(float("inf"))))
    return rows.select(F.col("metric").alias("gate"), "value", F.coalesce("least", "most").alias("bound"), F.coalesce(ok, F.lit(False)).alias("passed"))


def realizable_misuse(held: DataFrame, reach: DataFrame, realizable: str, bearer: str) -> DataFrame:
    """RM-1, the structural half: restricted classes under ``realizable`` whose filler is
    not under ``bearer``."""
    under = reach.where(F.col("ancestor") == realizable).select(F.col("node").alias("class")).distinct()
    fine = reach.where(F.col("ancestor") == bearer).select(F.col("node").alias("filler")).distinct()
    return held.join(under, "class", "left_semi").join(fine, "filler", "left_anti").select("class", "property", "filler").distinct()
