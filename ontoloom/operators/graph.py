"""Graph operators over edge tables: closure, components, cycles, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, settled, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): connected components of ``edges(src, dst)``; the
    component is its smallest node. Null ends are no edges.

    Large-star and small-star rounds: every round joins and groups on node ids
    only, the number of rounds grows with the logarithm of the longest chain, and
    a hub's edges are pre-aggregated to one minimum per node before they are
    shuffled. No component is ever gathered."""
    clean = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    links = written(clean.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(max_rounds):
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(hung.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        after = written(small)
        changed = after.exceptAll(links).limit(1).count() or links.exceptAll(after).limit(1).count()
        discard(links)
        links = after
        if not changed:
            nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.unionAll(roots).groupBy("node").agg(F.min("component").alias("component"))
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, ancestor, depth): HIER-1, the irreflexive transitive closure of
    ``edges(child, parent)`` with the least depth; exact on cycles. Null ends are no
    edges.

    Semi-naive doubling: after round k all pairs up to 2^k steps apart are known,
    and only pairs found in the last round are joined with what is known. Two pairs
    that a last-round pair is not part of were joined before. It ends with an
    empty round, so rounds grow with the logarithm of the depth, and a flat
    hierarchy is joined once. A round keeps what is new by an anti join and never
    rewrites what it has."""
    clean = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull())
    rounds = [written(clean.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())]
    for _ in range(max_rounds):
        last, known = rounds[-1], _all(rounds)
        ahead = lambda df: df.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        # The last round meets all on its upper side; what is older meets it on its own.
        steps = last.join(ahead(known), "ancestor")
        if len(rounds) > 1:
            steps = steps.unionAll(_all(rounds[:-1]).join(ahead(last), "ancestor"))
        found = steps.groupBy("node", F.col("further").alias("ancestor")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        new = written(found.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        rounds.append(new)
    raise RuntimeError(f"closure: not settled after {max_rounds} rounds")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionAll(table)
    return out


def cyclic_nodes(reach: DataFrame) -> DataFrame:
    """HIER-8: nodes that reach themselves."""
    return reach.where(F.col("node") == F.col("ancestor")).select("node")


def cycle_components(reach: DataFrame) -> DataFrame:
    """(node, component): HIER-8, the smallest node of each cycle."""
    back = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("node"))
    return reach.select("node", "ancestor").join(back, ["node", "ancestor"]).groupBy("node").agg(F.min(F.least("node", "ancestor")).alias("component"))


def redundant_parents(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(child, parent): HIER-10, parents that another parent already implies."""
    direct = edges.distinct()
    implied = reach.where(F.col("node") != F.col("ancestor")).select(F.col("node").alias("via"), F.col("ancestor").alias("parent"))
    # What a parent implies is few; the parents of a child are never joined with each other.
    over = direct.select("child", F.col("parent").alias("via")).join(implied, "via").select("child", "parent")
    return direct.join(over, ["child", "parent"], "left_semi")


def condensed(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(child, parent, code, lower, upper): ``edges(child, parent)`` with a number of the
    child and the numbers of the strongly connected components of both ends. Null ends
    are no edges.

    Within a component all reach all, so its closure grows with the square of it and is
    never built. Each round gives the nodes a new order and finds the least node that
    each reaches, and the least that reaches it. Where both are the same, it is in their
    component; an edge between nodes that differ in either is in none and is dropped.
    Ends that lie on no cycle are dropped before."""
    clean = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent").distinct()
    names = clean.select(F.col("child").alias("name")).unionAll(clean.select("parent")).distinct()
    codes = written(names.select("name", F.monotonically_increasing_id().alias("code")))
    coded = written(clean.join(codes.toDF("child", "lower"), "child").join(codes.toDF("parent", "upper"), "parent").select("child", "parent", "lower", "upper"))
    live, found = _on_cycles(written(coded.where("lower <> upper").select("lower", "upper"))), []
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        key = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731  # of one number, it is one to one
        arc = lambda way, a, b: live.select(F.lit(way).alias("way"), key(a).alias("node"), key(b).alias("to"))  # noqa: B023, E731
        nodes = live.select(F.col("lower").alias("code")).unionAll(live.select("upper")).distinct().withColumn("node", key("code"))
        # The driver keeps no plan of the rounds.
        least = settled(lambda: _least_reached(arc(0, "lower", "upper").unionAll(arc(1, "upper", "lower"))))  # noqa: B023
        both = least.groupBy("node").agg(F.min(F.when(F.col("way") == 0, F.col("low"))).alias("low0"), F.min(F.when(F.col("way") == 1, F.col("low"))).alias("low1"))
        seen = written(nodes.join(both, "node").select("code", "low0", "low1"))
        hit = seen.where("low0 = low1")
        found.append(written(hit.join(hit.groupBy("low0").agg(F.min("code").alias("component")), "low0").select("code", "component")))
        rest = seen.where("low0 <> low1")
        left = live.join(rest.toDF("lower", "low0", "low1"), "lower").join(rest.toDF("upper", "low0", "low1"), ["upper", "low0", "low1"]).select("lower", "upper")
        after = _on_cycles(written(left))
        discard(live, least, seen)
        live = after
    else:
        raise RuntimeError(f"condensed: not settled after {max_rounds} rounds")
    out = coded.withColumn("code", F.col("lower"))
    for end in ("lower", "upper"):
        if found:
            out = out.join(_all(found).toDF(end, "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    out = written(out.select("child", "parent", "code", "lower", "upper"))
    discard(codes, coded, live, *found)
    return out


def _on_cycles(live: DataFrame) -> DataFrame:
    """``live(lower, upper)`` without edges from nodes that none leads to or to nodes that
    lead to none, as long as that takes half of the edges; what is left is found by order."""
    size = live.count()
    while size:
        kept = written(live.join(live.select(F.col("upper").alias("lower")).distinct(), "lower", "left_semi").join(live.select(F.col("lower").alias("upper")).distinct(), "upper", "left_semi"))
        discard(live)
        live, before, size = kept, size, kept.count()
        if 2 * size > before:
            break
    return live


def _least_reached(arcs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(way, node, low): the least node that each node of ``arcs(way, node, to)`` reaches, or
    itself. What the least so far has reached is taken over at once, so that long
    chains take a logarithm of rounds where the order is that of a hash."""
    arcs = written(arcs)
    low = written(arcs.select("way", "node").unionAll(arcs.select("way", F.col("to").alias("node"))).distinct().select("way", "node", F.col("node").alias("low"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        near = arcs.join(low.select("way", F.col("node").alias("to"), F.col("low").alias("near")), ["way", "to"]).groupBy("way", "node").agg(F.min("near").alias("near"))
        far = low.select("way", F.col("node").alias("low"), F.col("low").alias("far"))
        least = F.least("low", "near", "far")
        after = written(low.select("way", "node", "low").join(near, ["way", "node"], "left").join(far, ["way", "low"]).select("way", "node", least.alias("low"), (least < F.col("low")).alias("moved")))
        discard(low)
        low = after
        if low.where("moved").isEmpty():
            discard(arcs)
            return low
    raise RuntimeError(f"_least_reached: not settled after {max_rounds} rounds")


def condensed_reach(rows: DataFrame) -> DataFrame:
    """(node, ancestor, depth): the closure over the components of ``rows``, as ``condensed``
    gives them, of those that are above something; the others are nobody's ancestor."""
    above = rows.select(F.col("upper").alias("child")).distinct()
    between = rows.where("lower <> upper").select(F.col("lower").alias("child"), F.col("upper").alias("parent")).distinct()
    return closure(between.join(above, "child", "left_semi"))


def condensed_redundant(rows: DataFrame, reach: DataFrame) -> DataFrame:
    """(child, parent): HIER-10 as ``redundant_parents``, of ``condensed`` rows and their
    ``condensed_reach``. A parent is implied by another one of its component, by one in
    the child's own, or by one whose component is below its."""
    groups = rows.groupBy("code", "lower", "upper").agg(F.count("*").alias("n"))
    kinds = groups.groupBy("code").agg(F.bool_or(F.col("lower") == F.col("upper")).alias("own"), F.count("*").alias("groups"))
    marked = written(groups.join(kinds, "code").withColumn("sure", (F.col("n") > 1) | (F.col("own") & (F.col("lower") != F.col("upper")))))
    # In a child's own component no other one leads back, so only what is outside is open.
    asked = marked.where("not own and groups > 1")
    wanted = asked.where("not sure").select("code", "upper")
    above = reach.select(F.col("node").alias("via"), F.col("ancestor").alias("upper")).join(wanted.select("upper").distinct(), "upper", "left_semi")
    over = asked.select("code", F.col("upper").alias("via")).join(above, "via").select("code", "upper")
    implied = marked.where("sure").select("code", "upper").unionAll(wanted.join(over, ["code", "upper"], "left_semi"))
    return rows.join(implied, ["code", "upper"], "left_semi").select("child", "parent")


def condensed_under(rows: DataFrame, reach: DataFrame, prefix: str) -> DataFrame:
    """(child): the nodes with an ancestor of the prefix, of ``condensed`` rows and their
    ``condensed_reach``."""
    top = rows.where(F.col("parent").startswith(prefix)).select("upper").distinct()
    below = reach.join(top.select(F.col("upper").alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias("upper"))
    return rows.join(top.unionAll(below).distinct(), "upper", "left_semi").select("child").distinct()


def multi_parents(edges: DataFrame) -> DataFrame:
    """(child, parents): HIER-11."""
    return edges.distinct().groupBy("child").agg(F.count("*").alias("parents")).where(F.col("parents") > 1)


def unanchored(edges: DataFrame, reach: DataFrame, anchor: str) -> DataFrame:
    """(node): HIER-12, nodes with no ancestor of the given prefix, themselves apart."""
    nodes = edges.select(F.col("child").alias("node")).unionAll(edges.select("parent")).distinct()
    held = reach.where(F.col("ancestor").startswith(anchor)).select("node").distinct()
    return nodes.where(~F.col("node").startswith(anchor)).join(held, "node", "left_anti")


def hubs(edges: DataFrame, more_than: int) -> DataFrame:
    """(parent, fan_out): AGG-28."""
    return edges.distinct().groupBy("parent").agg(F.count("*").alias("fan_out")).where(F.col("fan_out") > more_than)


def nearest_anchor(reach: DataFrame, anchor: str) -> DataFrame:
    """(node, anchor, depth): HIER-5, the nearest ancestor of the prefix; ties go to
    the smaller name."""
    held = reach.where(F.col("ancestor").startswith(anchor))
    best = F.min(F.struct("depth", "ancestor"))
    return held.groupBy("node").agg(best.alias("best")).select("node", F.col("best.ancestor").alias("anchor"), F.col("best.depth").alias("depth"))


def first_anchor(edges: DataFrame, anchor: str) -> DataFrame:
    """(child, anchor, depth): TOP-7, the nearest ancestor of the prefix over the parents of
    ``edges(child, parent, ordinal)``: the least depth, then the first parent, then the
    smaller name."""
    direct = edges.select("child", "parent", "ordinal")
    near = nearest_anchor(closure(direct.select("child", "parent")), anchor).select(F.col("node").alias("parent"), F.col("anchor").alias("over"), F.col("depth").alias("up"))
    own = direct.where(F.col("parent").startswith(anchor)).select("child", F.struct(F.lit(1).alias("depth"), "ordinal", F.col("parent").alias("anchor")).alias("b"))
    over = direct.join(near, "parent").select("child", F.struct((F.col("up") + 1).alias("depth"), "ordinal", F.col("over").alias("anchor")).alias("b"))
    best = own.unionAll(over).groupBy("child").agg(F.min("b").alias("b"))
    return best.select("child", "b.anchor", "b.depth")


def reflexive(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """``reach`` and each of ``nodes(node)`` above itself at depth 0."""
    return reach.unionAll(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def straddles(reach: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(node, a, b): JOIN-2, nodes under both members of a disjoint pair, a < b.
    ``reach`` should be reflexive for a node that is itself a member."""
    pairs = disjoint.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = reach.select("node", F.col("ancestor").alias("a")).join(pairs, "a")
    return one.join(reach.select("node", F.col("ancestor").alias("b")), ["node", "b"]).select("node", "a", "b").distinct()
