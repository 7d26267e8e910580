"""Queries over meshes, faces and assemblies; ``lineitem``, ``orders`` and ``part`` lend their rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mesh
from ..registry import query, table
from ..store import checkpointed
from .clouds import near, sql_near

#: The corners of a unit cube's twelve triangles, wound outwards.
CUBE = ["000 011 010", "000 001 011", "100 110 111", "100 111 101", "000 100 101", "000 101 001", "010 011 111", "010 111 110", "000 010 110", "000 110 100", "001 101 111", "001 111 011"]


def cubes(spark, sf_dir):
    """A cube for each supplier, of edge 1 + key modulo 3, four apart, one above the plate."""
    tri = F.array(*[F.array(*[F.array(*[F.lit(float(d)) for d in p]) for p in t.split()]) for t in CUBE])
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(tri).alias("n", "t"))
    edge, at = 1.0 + F.col("s_suppkey") % 3, (F.col("s_suppkey") * 4.0, F.lit(0.0), F.lit(1.0))
    cols = [(F.col("t")[i][j] * edge + at[j]).alias(f"{name}{c}") for i, name in enumerate("abc") for j, c in enumerate("xyz")]
    return checkpointed(rows.select((F.col("s_suppkey") * 12 + F.col("n")).alias("tri"), F.col("s_suppkey").alias("body"), *cols))


_S = "SELECT s_suppkey, 1.0 + s_suppkey % 3 AS e FROM supplier"


@query(f"SELECT 0::BIGINT AS boundary, (18 * count(*))::BIGINT AS manifold, 0::BIGINT AS non_manifold, 0::BIGINT AS misturned, 0::BIGINT AS degenerate, (12 * count(*))::BIGINT AS triangles, true AS watertight FROM ({_S})")
def edge_census(spark, sf_dir):
    return mesh.census(cubes(spark, sf_dir))


@query(f"SELECT {sql_near('sum(6*e*e)')} AS area, {sql_near('sum(e*e*e)')} AS volume, {sql_near('max(e)')} AS size_z, (12 * count(*))::BIGINT AS triangles, (2 * count(*))::BIGINT AS euler FROM ({_S})")
def mesh_facts(spark, sf_dir):
    return mesh.facts(cubes(spark, sf_dir)).select(near("area").alias("area"), near("volume").alias("volume"), near("size_z").alias("size_z"), "triangles", "euler")


def _raised(spark, sf_dir):
    """The cubes, those of even key half a unit up, so that these have ceilings."""
    up = F.when(F.col("body") % 2 == 0, 0.5).otherwise(0.0)
    return cubes(spark, sf_dir).withColumns({f"{n}z": F.col(f"{n}z") + up for n in "abc"})


@query(f"WITH s AS ({_S}) SELECT {sql_near('coalesce(sum(e*e) FILTER (s_suppkey % 2 = 0), 0)')} AS area, (2 * count(*) FILTER (s_suppkey % 2 = 0))::BIGINT AS faces, {sql_near('coalesce(sum(0.5*e*e) FILTER (s_suppkey % 2 = 0), 0)')} AS support_volume, {sql_near('100 * coalesce(sum(e*e) FILTER (s_suppkey % 2 = 0), 0) / sum(6*e*e)')} AS percent FROM s")
def overhang_facts(spark, sf_dir):
    return mesh.overhang(_raised(spark, sf_dir)).select(near("area").alias("area"), "faces", near("support_volume").alias("support_volume"), near("percent").alias("percent"))


@query(f"WITH s AS ({_S}) SELECT 0::BIGINT AS bin, {sql_near('sum(e*e)')} AS area FROM s WHERE s_suppkey % 2 = 0 HAVING count(*) > 0")
def histogram_10(spark, sf_dir):
    return mesh.overhang_histogram(_raised(spark, sf_dir)).select("bin", near("area").alias("area"))


@query(f"WITH s AS ({_S}), t AS (SELECT s_suppkey * 12 + n AS tri, e * e / 2 AS area FROM s, (VALUES (8), (9)) v(n) WHERE s_suppkey % 2 = 0) SELECT tri, {sql_near('area')} AS area FROM t ORDER BY t.area DESC, tri LIMIT 8")
def largest_overhangs(spark, sf_dir):
    return mesh.largest_overhangs(_raised(spark, sf_dir)).select("tri", near("area").alias("area"))


@query()
def orientation_compare(spark, sf_dir):
    return mesh.orientations(_raised(spark, sf_dir)).select("orientation", near("support_area").alias("support_area"), near("height").alias("height"))


@query("SELECT body, count(*) AS n, min(t) AS min, round(quantile_cont(t, 0.05), 6) AS p05, round(quantile_cont(t, 0.25), 6) AS p25, round(quantile_cont(t, 0.5), 6) AS p50, max(t) AS max FROM (SELECT l_returnflag AS body, l_quantity::DOUBLE AS t FROM lineitem WHERE l_quantity > 1e-3 AND l_quantity < 45) GROUP BY ROLLUP (body)")
def body_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("body"), F.col("l_quantity").cast("double").alias("t"))
    return mesh.thickness_facts(rows, 45.0).select("body", "n", "min", *[F.round(c, 6).alias(c) for c in ("p05", "p25", "p50")], "max")


@query("WITH b AS (SELECT l_returnflag AS body, sum(l_quantity)::DOUBLE AS area FROM lineitem GROUP BY 1) SELECT body, greatest(round_even(2000 * area / sum(area) OVER (), 0), 64)::BIGINT AS budget FROM b")
def sample_budgets(spark, sf_dir):
    return mesh.budgets(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("body")).agg(F.sum("l_quantity").cast("double").alias("area")))


# ---- topology --------------------------------------------------------------

_FACES = "SELECT l_returnflag AS axis, round_even(l_discount / 0.01, 0)::BIGINT AS bucket, l_discount::DOUBLE AS coord, l_extendedprice::DOUBLE AS area FROM lineitem"


@query("SELECT n_nationkey, n, coalesce(sum(n) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def rebase_offsets(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"))
    w = Window.orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) = 1 THEN p_type ELSE p_type || '#' || row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) END AS alias FROM part")
def label_aliases(spark, sf_dir):
    """A label that several rows have is numbered in their order."""
    w = Window.partitionBy("p_type")
    name = F.when(F.count("*").over(w) == 1, F.col("p_type")).otherwise(F.concat("p_type", F.lit("#"), F.row_number().over(w.orderBy("p_partkey")).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("alias"))


_LIMITS = [("FDM", 1.2, 45.0), ("SLS", 0.7, None), ("SLA", 0.5, 30.0), ("metal", 0.4, 45.0), ("MJF", 0.5, None)]
_LSQL = ", ".join(f"('{p}', {w}, {a if a is not None else 'NULL'})" for p, w, a in _LIMITS)


@query(f"WITH l(process, wall, angle) AS (VALUES {_LSQL}), m AS (SELECT 0.6 AS wall, 40.0 AS angle), u AS (SELECT process, 'wall' AS fact, l.wall AS lim, m.wall AS got FROM l, m UNION ALL SELECT process, 'angle', l.angle, m.angle FROM l, m UNION ALL SELECT process, 'hole', 2.0, NULL FROM l) SELECT process, fact, CASE WHEN lim IS NULL OR got IS NULL THEN 'not checked' WHEN got >= lim THEN 'pass' ELSE 'fail' END AS verdict FROM u")
def limits_check(spark, sf_dir):
    """Measured facts against the limits of each process; without limit or measurement nothing is claimed."""
    limits = spark.createDataFrame([(p, w, a, 2.0) for p, w, a in _LIMITS], "process string, wall double, angle double, hole double").unpivot("process", ["wall", "angle", "hole"], "fact", "lim")
    got = spark.createDataFrame([("wall", 0.6), ("angle", 40.0)], "fact string, got double")
    j = limits.join(F.broadcast(got), "fact", "left")
    return j.select("process", "fact", F.when(F.col("lim").isNull() | F.col("got").isNull(), "not checked").when(F.col("got") >= F.col("lim"), "pass").otherwise("fail").alias("verdict"))
