"""Graphs of frames, links and joints ``(parent, child)``: reachability, trees, cycles, paths, roll-ups, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import checkpointed


def closure(edges: DataFrame) -> DataFrame:
    """``(ancestor, node, depth)`` over all paths of a forest or an acyclic graph, the least depth of each pair.

    Paths double in length each round, so the rounds are as the logarithm of
    the depth. Pairs on a cycle reach themselves, and end as well.
    """
    paths = checkpointed(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).cast("long").alias("depth")).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
    size = lambda df: df.agg(F.count("*"), F.sum("depth")).first()
    while True:
        a, b = paths.alias("a"), paths.alias("b")
        more = a.join(b, F.col("a.node") == F.col("b.ancestor")).select("a.ancestor", "b.node", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        grown = checkpointed(paths.unionByName(more).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
        if size(grown) == size(paths):
            return grown
        paths = grown


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(node, depth)`` from the nodes of ``start (node)``, links taken both ways; breadth first, a round for each depth."""
    both = edges.select(F.col("parent").alias("s"), F.col("child").alias("e")).unionByName(edges.select(F.col("child").alias("s"), F.col("parent").alias("e"))).distinct()
    front = checkpointed(start.select("node").distinct())
    seen, depth = front.withColumn("depth", F.lit(0).cast("long")), 0
    while not front.isEmpty():
        depth += 1
        step = both.join(front, F.col("s") == F.col("node")).select(F.col("e").alias("node")).distinct().join(seen, "node", "left_anti")
        front = checkpointed(step)
        seen = checkpointed(seen.unionByName(front.withColumn("depth", F.lit(depth).cast("long"))))
    return seen


def tree_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(code, node)``: several parents, no or several roots, cycles, links to unknown nodes."""
    up = edges.groupBy(F.col("child").alias("node")).agg(F.count_distinct("parent").alias("n"))
    many = up.filter("n > 1").select(F.lit("multiple_parents").alias("code"), "node")
    roots = nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    n = roots.count()
    wrong = roots.filter(F.lit(n != 1)).select(F.lit("not_a_tree").alias("code"), "node")
    loops = closure(edges).filter("ancestor = node").select(F.lit("joint_graph_cycle").alias("code"), "node")
    ends = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    lost = ends.join(nodes, "node", "left_anti").select(F.lit("missing_link").alias("code"), "node")
    return many.unionByName(wrong).unionByName(loops).unionByName(lost)


def chain(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(base, tip, length)`` of pairs ``(base, tip)``; null where no path leads from parent to child."""
    paths = closure(edges).select(F.col("ancestor").alias("base"), F.col("node").alias("tip"), F.col("depth").alias("length"))
    return pairs.join(paths, ["base", "tip"], "left")


def roll_up(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``(node, n, total)``: count and sum of facts ``(node, value)`` on the node and all below it."""
    own = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct().select(F.col("node").alias("ancestor"), "node")
    pairs = closure(edges).select("ancestor", "node").filter("ancestor <> node").unionByName(own)
    sums = facts.groupBy("node").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return pairs.join(sums, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("n").alias("n"), F.sum("v").alias("total"))


def bodies(links: DataFrame) -> DataFrame:
    """``(node, body)`` of links ``(a, b)``: body is the least node that links lead to.

    Each round a node takes the least name among its neighbours' and jumps
    to that name's own name, so that long chains fold up.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("body")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(names.select(F.col("node").alias("b"), F.col("body").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hop = names.join(seen, "node").select("node", "body", F.least("body", "other").alias("to"))
        jump = names.select(F.col("node").alias("to"), F.col("body").alias("far"))
        new = checkpointed(hop.join(jump, "to", "left").select("node", "body", F.least("to", "far").alias("new")))
        if new.filter("new <> body").isEmpty():
            return names
        names = new.select("node", F.col("new").alias("body"))
