"""Queries over graphs; regions, nations and customers lend a tree, parts and suppliers a bipartite graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..registry import query, table

_EDGES = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"


def tree(spark, sf_dir):
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"))
    return n.unionByName(table(spark, sf_dir, "customer").select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("child")))


_RING = f"""WITH RECURSIVE e AS ({_EDGES}), both_ways AS (SELECT parent AS s, child AS t FROM e UNION SELECT child, parent FROM e),
seen AS (SELECT 'r1' AS node UNION SELECT t FROM both_ways JOIN seen ON s = node) SELECT node FROM seen"""


@query(_RING)
def reachability(spark, sf_dir):
    return graph.reachable(tree(spark, sf_dir), spark.createDataFrame([("r1",)], "node string")).select("node")


@query(f"WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT parent AS ancestor, child AS node, 1::BIGINT AS depth FROM e UNION ALL SELECT c.ancestor, e.child, depth + 1 FROM c JOIN e ON e.parent = c.node) SELECT * FROM c")
def ancestors(spark, sf_dir):
    return graph.closure(tree(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT parent AS base, child AS tip, 1::BIGINT AS length FROM e UNION ALL SELECT base, e.child, length + 1 FROM c JOIN e ON e.parent = c.tip), p AS (SELECT 'r' || (c_custkey % 5) AS base, 'c' || c_custkey AS tip FROM customer) SELECT p.base, p.tip, length FROM p LEFT JOIN c USING (base, tip)")
def chain_path(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")).alias("base"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tip"))
    return graph.chain(tree(spark, sf_dir), pairs)


@query(f"WITH RECURSIVE e AS ({_EDGES}), own AS (SELECT parent AS node FROM e UNION SELECT child FROM e), c AS (SELECT node AS ancestor, node FROM own UNION ALL SELECT ancestor, e.child FROM c JOIN e ON e.parent = c.node), f AS (SELECT 'c' || o_custkey AS node FROM orders) SELECT ancestor AS node, count(*) AS n FROM c JOIN f USING (node) GROUP BY ancestor")
def tree_rollup(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), F.lit(1).alias("value"))
    return graph.roll_up(tree(spark, sf_dir), facts).select("node", "n")


@query("SELECT code, node FROM (VALUES ('not_a_tree', 'r0'), ('not_a_tree', 'r1'), ('not_a_tree', 'r2'), ('not_a_tree', 'r3'), ('not_a_tree', 'r4'), ('multiple_parents', 'n3'), ('missing_link', 'x'), ('joint_graph_cycle', 'x')) v(code, node)")
def cycle_check(spark, sf_dir):
    """The tree's faults after a self link of an unknown node and a second parent of a nation are put in."""
    e = tree(spark, sf_dir)
    nodes = e.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    first = table(spark, sf_dir, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("r"), ((F.col("n_regionkey") + 1) % 5).cast("string")).alias("parent"), F.lit("n3").alias("child"))
    return graph.tree_findings(nodes, e.unionByName(first).unionByName(spark.createDataFrame([("x", "x")], "parent string, child string")))


@query()
def connected_bodies(spark, sf_dir):
    """Orders and suppliers that line items join; SQL recursion over all of them is too slow, tests hold a brute-force version."""
    return graph.bodies(table(spark, sf_dir, "lineitem").select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join_refs(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT n_nationkey, s AS segment FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer")
def required_minus_seen(spark, sf_dir):
    """Each nation must have each segment: what is required, less what is there. Segments come as one array, not as a product."""
    c = table(spark, sf_dir, "customer")
    segments = c.agg(F.collect_set("c_mktsegment").alias("all"))
    need = table(spark, sf_dir, "nation").join(F.broadcast(segments), F.lit(True)).select("n_nationkey", F.explode("all").alias("segment"))
    return need.exceptAll(c.select("c_nationkey", "c_mktsegment").distinct())


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) % 2 = 1")
def open_chain_parity(spark, sf_dir):
    """Ends that an odd number of pieces use: where a chain is open."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n")).filter("n % 2 = 1")
