"""Hierarchy queries over the taxonomy and the cyclic graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources import adapters as A

#: The adapters in SQL, for the twins.
SUB = """sub AS (
    SELECT 'c:' || c_custkey AS child, 'n:' || c_nationkey AS parent FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation
    UNION ALL SELECT 'r:' || r_regionkey, 'entity' FROM region
    UNION ALL SELECT 'c:' || c_custkey, 'r:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 = 0)"""
REACH = """walk AS (
    SELECT child AS node, parent AS ancestor, 1 AS depth FROM sub
    UNION ALL SELECT w.node, s.parent, w.depth + 1 FROM walk w JOIN sub s ON s.child = w.ancestor),
reach AS (SELECT node, ancestor, min(depth) AS depth FROM walk GROUP BY 1, 2)"""
TREE = f"WITH RECURSIVE {SUB}, {REACH}"
CYCLE = """WITH RECURSIVE sub AS (SELECT DISTINCT user_id AS child, (user_id * user_id + 1) % 150 AS parent FROM events),
reach AS (SELECT child AS node, parent AS ancestor FROM sub UNION SELECT r.node, s.parent FROM reach r JOIN sub s ON s.child = r.ancestor)"""
STRADDLE = f"""WITH RECURSIVE {SUB.replace("sub AS", "base AS", 1)}, sub AS (SELECT * FROM base UNION ALL
    SELECT 'c:' || c_custkey, 'n:' || ((c_nationkey + 6) % 25) FROM customer WHERE c_custkey % 11 = 0), {REACH},
disjoint AS (SELECT 'r:' || a.r_regionkey AS a, 'r:' || b.r_regionkey AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey)"""


def _tree(query):
    def run(spark, sf_dir):
        sub = A.taxonomy(spark, sf_dir)
        return query(sub, graph.closure(sub))

    return run


def closure_counts(sub, reach):
    return reach.where(~F.col("ancestor").startswith("s:")).groupBy("ancestor").agg(F.count("*").alias("descendants"), F.max("depth").alias("deepest"))


def closure_depths(sub, reach):
    return reach.groupBy("depth").agg(F.count("*").alias("pairs"))


def depth_map(sub, reach):
    """HIER-6: the least depth below the root, 6 for what never meets it."""
    nodes = sub.select(F.col("child").alias("node")).unionAll(sub.select("parent")).distinct().where("node <> 'entity'")
    return nodes.join(reach.where("ancestor = 'entity'"), "node", "left").select("node", F.coalesce("depth", F.lit(6)).alias("depth"))


def spine(sub, reach):
    """HIER-7: descendants of each region by kind."""
    rows = reach.where(F.col("ancestor").startswith("r:"))
    return rows.groupBy("ancestor").agg(F.count_if(F.col("node").startswith("n:")).alias("classes"), F.count_if(~F.col("node").startswith("n:")).alias("individuals"))


def _straddle(spark, sf_dir):
    sub = A.straddling_taxonomy(spark, sf_dir)
    return graph.straddles(graph.closure(sub), A.region_disjointness(spark, sf_dir))


def _new_under_profile(spark, sf_dir):
    """PROF-1, SET-4: clashes that only the added axioms bring."""
    pairs = A.region_disjointness(spark, sf_dir)
    base = graph.straddles(graph.closure(A.taxonomy(spark, sf_dir)), pairs)
    return _straddle(spark, sf_dir).exceptAll(base).groupBy("a", "b").agg(F.count("*").alias("nodes"))


def _cycle(query):
    def run(spark, sf_dir):
        return query(graph.closure(A.cyclic_graph(spark, sf_dir)))

    return run


QUERIES = {
    "hier_closure_counts": _tree(closure_counts),
    "hier_closure_depths": _tree(closure_depths),
    "hier_depth_map": _tree(depth_map),
    "hier_anchor_spine": _tree(spine),
    "hier_nearest_anchor": _tree(lambda sub, reach: graph.nearest_anchor(reach, "r:")),
    "hier_redundant_parents": _tree(graph.redundant_parents),
    "hier_multi_parent": lambda spark, d: graph.multi_parents(A.taxonomy(spark, d)),
    "hier_unanchored": _tree(lambda sub, reach: graph.unanchored(sub, reach, "n:")),
    "hier_fanout_hubs": lambda spark, d: graph.hubs(A.taxonomy(spark, d), 40),
    "hier_closure_cyclic": _cycle(lambda reach: reach.groupBy("node").agg(F.count("*").alias("reached"))),
    "hier_cyclic_nodes": _cycle(graph.cyclic_nodes),
    "hier_cycle_components": _cycle(graph.cycle_components),
    "hier_components": lambda spark, d: graph.components(A.cyclic_graph(spark, d).toDF("src", "dst")),
    "clash_straddles": _straddle,
    "clash_new_under_profile": _new_under_profile,
}

SQL = {
    "hier_closure_counts": f"{TREE} SELECT ancestor, count(*) AS descendants, max(depth) AS deepest FROM reach WHERE ancestor NOT LIKE 's:%' GROUP BY 1",
    "hier_closure_depths": f"{TREE} SELECT depth, count(*) AS pairs FROM reach GROUP BY 1",
    "hier_depth_map": f"{TREE} SELECT n.node, coalesce(r.depth, 6) AS depth FROM (SELECT child AS node FROM sub UNION SELECT parent FROM sub) n LEFT JOIN reach r ON r.node = n.node AND r.ancestor = 'entity' WHERE n.node <> 'entity'",
    "hier_anchor_spine": f"{TREE} SELECT ancestor, count(*) FILTER (WHERE node LIKE 'n:%') AS classes, count(*) FILTER (WHERE node NOT LIKE 'n:%') AS individuals FROM reach WHERE ancestor LIKE 'r:%' GROUP BY 1",
    "hier_nearest_anchor": f"{TREE} SELECT node, arg_min(ancestor, (depth, ancestor)) AS anchor, min(depth) AS depth FROM reach WHERE ancestor LIKE 'r:%' GROUP BY 1",
    "hier_redundant_parents": f"{TREE}, d AS (SELECT DISTINCT child, parent FROM sub) SELECT DISTINCT d.child, d.parent FROM d JOIN d o ON o.child = d.child AND o.parent <> d.parent JOIN reach r ON r.node = o.parent AND r.ancestor = d.parent",
    "hier_multi_parent": f"WITH {SUB} SELECT child, count(DISTINCT parent) AS parents FROM sub GROUP BY 1 HAVING count(DISTINCT parent) > 1",
    "hier_unanchored": f"{TREE} SELECT node FROM (SELECT child AS node FROM sub UNION SELECT parent FROM sub) n WHERE node NOT LIKE 'n:%' AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.node = n.node AND r.ancestor LIKE 'n:%')",
    "hier_fanout_hubs": f"WITH {SUB} SELECT parent, count(DISTINCT child) AS fan_out FROM sub GROUP BY 1 HAVING count(DISTINCT child) > 40",
    "hier_closure_cyclic": f"{CYCLE} SELECT node, count(*) AS reached FROM reach GROUP BY 1",
    "hier_cyclic_nodes": f"{CYCLE} SELECT node FROM reach WHERE node = ancestor",
    "hier_cycle_components": f"{CYCLE} SELECT a.node, min(least(a.node, a.ancestor)) AS component FROM reach a JOIN reach b ON b.node = a.ancestor AND b.ancestor = a.node GROUP BY 1",
    "hier_components": """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS u, (user_id * user_id + 1) % 150 AS v FROM events WHERE user_id <> (user_id * user_id + 1) % 150),
        b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS root FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node)
        SELECT node, min(root) AS component FROM r GROUP BY 1""",
    "clash_straddles": f"{STRADDLE} SELECT DISTINCT x.node, d.a, d.b FROM disjoint d JOIN reach x ON x.ancestor = d.a JOIN reach y ON y.node = x.node AND y.ancestor = d.b",
    "clash_new_under_profile": f"{STRADDLE} SELECT a, b, count(*) AS nodes FROM (SELECT DISTINCT x.node, d.a, d.b FROM disjoint d JOIN reach x ON x.ancestor = d.a JOIN reach y ON y.node = x.node AND y.ancestor = d.b) GROUP BY 1, 2",
}
