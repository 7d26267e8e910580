"""Facts of triangle meshes ``(tri, ax, ay, az, bx ... cz)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v

#: The six axis-aligned orientations, as rows of the linear part.
ORIENTATIONS = {
    "current_plus_z": ((1, 0, 0), (0, 1, 0), (0, 0, 1)), "flip_180_x": ((1, 0, 0), (0, -1, 0), (0, 0, -1)), "rot_plus_90_x": ((1, 0, 0), (0, 0, -1), (0, 1, 0)),
    "rot_minus_90_x": ((1, 0, 0), (0, 0, 1), (0, -1, 0)), "rot_plus_90_y": ((0, 0, 1), (0, 1, 0), (-1, 0, 0)), "rot_minus_90_y": ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
}


def corner(name: str) -> v.Vec:
    return tuple(F.col(f"{name}{c}") for c in "xyz")


def with_facts(tris: DataFrame) -> DataFrame:
    """Adds area, nz (unit normal's z, null for a degenerate triangle), centroid z, and the signed volume under it."""
    a, b, c = corner("a"), corner("b"), corner("c")
    n = v.cross(v.sub(b, a), v.sub(c, a))
    return tris.withColumn("area", v.length(n) / 2).withColumn("nz", n[2] / F.nullif(v.length(n), F.lit(0.0))).withColumn("mid_z", (a[2] + b[2] + c[2]) / 3).withColumn("tetra", v.dot(a, v.cross(b, c)) / 6)


def edges(tris: DataFrame, tol: float = 1e-6) -> DataFrame:
    """``(tri, p, q, forward)``: the three edges of each triangle between quantised corners, p < q."""
    keys = [F.array(*[F.round(x / tol).cast("long") for x in corner(n)]) for n in "abc"]
    rows = tris.select("tri", F.explode(F.array(*[F.struct(keys[i].alias("s"), keys[(i + 1) % 3].alias("e")) for i in range(3)])).alias("x")).select("tri", "x.s", "x.e")
    return rows.filter("s <> e").select("tri", F.least("s", "e").alias("p"), F.greatest("s", "e").alias("q"), (F.col("s") < F.col("e")).alias("forward"))


def census(tris: DataFrame) -> DataFrame:
    """Counts of edges by use: boundary 1, manifold 2, non-manifold more; degenerate triangles; whether the mesh is closed and evenly wound."""
    uses = edges(tris).groupBy("p", "q").agg(F.count("*").alias("n"), F.sum(F.when(F.col("forward"), 1).otherwise(-1)).alias("turn"))
    if_ = lambda c: F.coalesce(F.count_if(c), F.lit(0)).cast("long")
    found = uses.agg(if_(F.col("n") == 1).alias("boundary"), if_(F.col("n") == 2).alias("manifold"), if_(F.col("n") > 2).alias("non_manifold"), if_((F.col("n") == 2) & (F.col("turn") != 0)).alias("misturned"))
    flat = with_facts(tris).agg(F.count_if(F.col("area") <= 1e-12).cast("long").alias("degenerate"), F.count("*").alias("triangles"))
    return found.join(flat, F.lit(True)).withColumn("watertight", (F.col("boundary") == 0) & (F.col("non_manifold") == 0) & (F.col("manifold") > 0))


def facts(tris: DataFrame) -> DataFrame:
    """Extents, area, volume (of a closed mesh), triangles, Euler number."""
    ends = [F.greatest(*[F.max(f"{n}{c}") for n in "abc"]) - F.least(*[F.min(f"{n}{c}") for n in "abc"]) for c in "xyz"]
    own = with_facts(tris).agg(*[e.alias(f"size_{c}") for e, c in zip(ends, "xyz", strict=True)], F.sum("area").alias("area"), F.abs(F.sum("tetra")).alias("volume"), F.count("*").alias("triangles"))
    e = edges(tris).select("p", "q").distinct()
    points = e.select(F.explode(F.array("p", "q")).alias("p")).distinct().agg(F.count("*").alias("n_points"))
    out = own.join(census(tris).select("watertight"), F.lit(True)).join(e.agg(F.count("*").alias("n_edges")), F.lit(True)).join(points, F.lit(True))
    return out.withColumn("euler", F.col("n_points") - F.col("n_edges") + F.col("triangles")).withColumn("volume", F.when(F.col("watertight"), F.col("volume")))


def overhang_rows(tris: DataFrame) -> DataFrame:
    """Down-facing triangles off the plate, with angle: 0 a flat ceiling, 90 a wall."""
    rows = with_facts(tris)
    floor = rows.agg(F.min(F.least("az", "bz", "cz")).alias("z0"))
    angle = 90.0 - F.degrees(F.asin(F.least(F.greatest(-F.col("nz"), F.lit(0.0)), F.lit(1.0))))
    return rows.join(F.broadcast(floor), F.lit(True)).filter((F.col("nz") < -1e-6) & (F.col("mid_z") >= F.col("z0") + 0.1)).withColumn("angle", angle)


def overhang(tris: DataFrame, limit: float = 45.0) -> DataFrame:
    """Area, share and number of overhanging triangles below the limit, and the volume of prisms under them."""
    total = with_facts(tris).agg(F.sum("area").alias("total"))
    low = overhang_rows(tris).filter(F.col("angle") < limit)
    sums = low.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count("*").alias("faces"), F.coalesce(F.sum(F.col("area") * F.abs("nz") * (F.col("mid_z") - F.col("z0"))), F.lit(0.0)).alias("support_volume"))
    return sums.join(total, F.lit(True)).withColumn("percent", F.coalesce(F.try_divide(100 * F.col("area"), "total"), F.lit(0.0)))


def overhang_histogram(tris: DataFrame) -> DataFrame:
    """Overhanging area by ten degrees; bins without area are left out."""
    bins = overhang_rows(tris).filter("angle < 90").groupBy(F.floor(F.col("angle") / 10).alias("bin")).agg(F.sum("area").alias("area"))
    return bins.filter("area > 0")


def largest_overhangs(tris: DataFrame, limit: float = 45.0, k: int = 8) -> DataFrame:
    """The k largest triangles below the limit: a report."""
    return overhang_rows(tris).filter(F.col("angle") < limit).orderBy(F.desc("area"), "tri").limit(k)


def orientations(tris: DataFrame, limit: float = 45.0) -> DataFrame:
    """Overhanging area and height of build for the six orientations, in one pass: each triangle is turned six ways in place."""
    down = [F.struct(F.lit(name).alias("orientation"), *[F.lit(float(x)).alias(f"r{i}") for i, x in enumerate(rows[2])]) for name, rows in ORIENTATIONS.items()]
    turned = tris.withColumn("o", F.explode(F.array(*down))).select("*", "o.*")
    a, b, c = corner("a"), corner("b"), corner("c")
    r = tuple(F.col(f"r{i}") for i in range(3))
    n = v.cross(v.sub(b, a), v.sub(c, a))
    zs = [v.dot(r, p) for p in (a, b, c)]
    rows = turned.select("orientation", (v.length(n) / 2).alias("area"), (v.dot(r, n) / F.nullif(v.length(n), F.lit(0.0))).alias("nz"), ((zs[0] + zs[1] + zs[2]) / 3).alias("mid"), F.least(*zs).alias("lo"), F.greatest(*zs).alias("hi"))
    ends = rows.groupBy("orientation").agg(F.min("lo").alias("z0"), (F.max("hi") - F.min("lo")).alias("height"))
    angle = 90.0 - F.degrees(F.asin(F.least(F.greatest(-F.col("nz"), F.lit(0.0)), F.lit(1.0))))
    low = (F.col("nz") < -1e-6) & (F.col("mid") >= F.col("z0") + 0.1) & (angle < limit)
    return rows.join(F.broadcast(ends), "orientation").groupBy("orientation").agg(F.coalesce(F.sum(F.when(low, F.col("area"))), F.lit(0.0)).alias("support_area"), F.max("height").alias("height"))


def thickness_facts(rows: DataFrame, diagonal: float) -> DataFrame:
    """Quantiles of the valid samples ``(body, t)`` for each body and for all (body null)."""
    good = rows.filter((F.col("t") > 1e-3) & (F.col("t") < diagonal))
    return good.rollup("body").agg(F.count("*").alias("n"), F.min("t").alias("min"), *[F.percentile("t", F.lit(p)).alias(f"p{int(100 * p):02d}") for p in (0.05, 0.25, 0.5)], F.max("t").alias("max"))


def budgets(bodies: DataFrame, samples: int = 2000) -> DataFrame:
    """Samples for each body ``(body, area)`` by its share of the area, 64 at least; halves go to even."""
    total = bodies.agg(F.sum("area").alias("total"))
    return bodies.join(F.broadcast(total), F.lit(True)).select("body", F.greatest(F.bround(samples * F.col("area") / F.col("total")), F.lit(64)).cast("long").alias("budget"))
