"""Frames and the transforms between them as tables: rules on single transforms, cycles, ordered chains.

Transforms are rows ``(doc, id, source, target, layout, convention, units,
type, matrix, inverse, reflection_allowed, held_out, round_trip_max,
round_trip_tolerance, norm, condition, reciprocal)``, matrices arrays of 16
numbers by row; frames are rows ``(doc, id, handedness)``. Findings are
``(doc, code, subject)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import checkpointed
from .kinematics import IDENTITY, identity, product

#: What a transform must say of itself, and the bounds of its numbers.
LAYOUT, CONVENTION, UNITS, NORM = "row-major", "column-vector", "contract-linear-units", "infinity"
TYPES = ["rigid", "similarity", "affine"]
SINGULAR, RESIDUAL, CONDITION, TIGHT = 1e-12, 1e-8, 1e12, 1e-12


def _at(m: str, i: int) -> Column:
    return F.get(F.col(m), F.lit(i))


def _row(m: str, i: int) -> Column:
    return F.slice(F.col(m), 4 * i + 1, 3)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _off_identity(m: str) -> Column:
    return F.array_max(F.transform(F.zip_with(F.col(m), identity(), lambda x, y: F.abs(x - y)), lambda x: x))


def _close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def measured(transforms: DataFrame) -> DataFrame:
    """Adds determinant, norms of the rows, dots between them, the residual of both products and the condition number."""
    m = "matrix"
    minor = lambda a, b, c, d: _at(m, a) * _at(m, b) - _at(m, c) * _at(m, d)
    det = _at(m, 0) * minor(5, 10, 6, 9) - _at(m, 1) * minor(4, 10, 6, 8) + _at(m, 2) * minor(4, 9, 5, 8)
    size = lambda name: F.greatest(*[_total(F.transform(_row(name, i), F.abs)) for i in range(3)])
    out = transforms.withColumns({
        "_det": det, "_norms": F.array(*[F.sqrt(_dot(_row(m, i), _row(m, i))) for i in range(3)]), "_dots": F.array(*[F.abs(_dot(_row(m, a), _row(m, b))) for a, b in ((0, 1), (0, 2), (1, 2))]),
        "_there": product(F.col("matrix"), F.col("inverse")), "_back": product(F.col("inverse"), F.col("matrix")), "_condition": size("matrix") * size("inverse"),
    })
    return out.withColumn("_residual", F.greatest(_off_identity("_there"), _off_identity("_back")))


def transform_findings(transforms: DataFrame, frames: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """Findings on single transforms.

    extents ``(doc, frame, extent)``: the frame of the source cloud and its
    largest coordinate, one at least; transforms from that frame must be rigid
    or similar as tightly as their round-trip tolerance asks at that extent.
    """
    sized = (F.size("matrix") == 16) & (F.size("inverse") == 16)
    known = frames.select("doc", F.col("id").alias("_f"), F.col("handedness").alias("_h"))
    t = transforms.withColumn("_sized", F.coalesce(sized, F.lit(False)))
    for end in ("source", "target"):
        t = t.join(known.withColumnsRenamed({"_f": end, "_h": f"_h_{end}"}).withColumn(f"_known_{end}", F.lit(True)), ["doc", end], "left")
    if extents is not None:
        t = t.join(extents.select("doc", F.col("frame").alias("source"), F.greatest("extent", F.lit(1.0)).alias("_extent")), ["doc", "source"], "left")
    else:
        t = t.withColumn("_extent", F.lit(None).cast("double"))
    bad = F.array(*[F.lit(x) for x in IDENTITY[12:]])
    plain = {
        "reference.frame": F.col("_known_source").isNull() | F.col("_known_target").isNull(), "geometry.self_transform": F.col("source") == F.col("target"),
        "transform.layout": ~F.col("layout").eqNullSafe(F.lit(LAYOUT)), "transform.vector_convention": ~F.col("convention").eqNullSafe(F.lit(CONVENTION)), "transform.translation_units": ~F.col("units").eqNullSafe(F.lit(UNITS)),
        "transform.type": ~F.coalesce(F.col("type").isin(TYPES), F.lit(False)), "transform.matrix_size": ~F.col("_sized"), "transform.reflection_flag": F.col("_sized") & F.col("reflection_allowed").isNull(),
        "transform.held_out": F.col("_sized") & (F.col("held_out") < 1), "transform.round_trip": F.col("_sized") & (F.col("round_trip_max") > F.col("round_trip_tolerance")), "transform.conditioning_norm": F.col("_sized") & ~F.col("norm").eqNullSafe(F.lit(NORM)),
    }
    found = lambda df, rules: df.select("doc", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("code"), F.col("id").alias("subject"))
    out = found(t, plain)
    m = measured(t.filter("_sized"))
    scale, mean = F.array_max("_norms"), _total(F.col("_norms")) / 3.0
    wanted = F.when(F.col("type") == "rigid", 1.0).otherwise(mean)
    m = m.withColumns({"_scale": scale, "_wanted": F.greatest(wanted, F.lit(1.0)), "_mean": mean})
    m = m.withColumn("_tight", F.least(F.lit(TIGHT), F.coalesce(F.col("round_trip_tolerance") / (F.col("_extent") * F.col("_wanted")), F.lit(TIGHT))))
    stiff = F.col("type").isin("rigid", "similarity")
    same = F.exists("_norms", lambda n: F.abs(n - F.when(F.col("type") == "rigid", 1.0).otherwise(F.col("_mean"))) > F.col("_tight") * F.col("_wanted"))
    allowed = F.coalesce(F.col("reflection_allowed"), F.lit(False))
    turned = F.signum("_det") != F.when(F.col("_h_source") == F.col("_h_target"), 1.0).otherwise(-1.0)
    reciprocal = F.when(F.col("_condition") > 0, 1.0 / F.col("_condition")).otherwise(0.0)
    numeric = {
        "transform.homogeneous_row": (F.slice("matrix", 13, 4) != bad) | (F.slice("inverse", 13, 4) != bad), "transform.singular": (F.col("_scale") == 0) | (F.abs("_det") <= SINGULAR * F.col("_scale") ** 3),
        "transform.undocumented_reflection": (F.col("_det") < 0) & ~allowed, "transform.overflow": F.isnan("_residual") | (F.col("_residual") == float("inf")), "transform.inverse": F.isnan("_residual") | (F.col("_residual") > RESIDUAL),
        "transform.conditioning": (F.col("_condition") > CONDITION) | F.isnan("_condition") | ~_close(F.col("condition"), F.col("_condition"), 1e-6, 1e-9) | ~_close(F.col("reciprocal"), reciprocal, 1e-6, 1e-12),
        "transform.not_rigid": (F.col("type") == "rigid") & same, "transform.not_similarity": (F.col("type") == "similarity") & (same | (F.col("_mean") <= 0)),
        "transform.non_orthogonal": stiff & (F.array_max("_dots") > F.col("_tight") * F.greatest(F.lit(1.0), F.col("_wanted") * F.col("_wanted"))),
        "transform.handedness": F.col("_h_source").isNotNull() & F.col("_h_target").isNotNull() & (F.abs("_det") >= SINGULAR) & turned & ~allowed,
    }
    out = out.unionByName(found(m, numeric))
    repeated = lambda keys, code: transforms.groupBy("doc", *keys).agg(F.max("id").alias("subject"), F.count("*").alias("n")).filter("n > 1").select("doc", F.lit(code).alias("code"), "subject")
    return out.unionByName(repeated(["source", "target"], "reference.duplicate_transform")).unionByName(repeated(["id"], "reference.duplicate_id"))


def cycle_findings(transforms: DataFrame) -> DataFrame:
    """``transform.cycle`` for the transforms that disagree with another way between their frames, by over 1e-8 relative.

    Frames take a pose from the least frame of their doc, or of their part of
    it, round by round along transforms in either direction, each from the
    least transform that reaches it; then every transform is checked once.
    """
    t = transforms.filter((F.size("matrix") == 16) & (F.size("inverse") == 16)).select("doc", "id", "source", "target", "matrix", "inverse")
    steps = checkpointed(t.select("doc", "id", F.col("source").alias("a"), F.col("target").alias("b"), F.col("matrix").alias("m")).unionByName(t.select("doc", "id", F.col("target").alias("a"), F.col("source").alias("b"), F.col("inverse").alias("m"))))
    frames = checkpointed(steps.select("doc", F.col("a").alias("frame")).distinct())
    placed = None
    while True:
        left = frames if placed is None else frames.join(placed, ["doc", "frame"], "left_anti")
        front = checkpointed(left.groupBy("doc").agg(F.min("frame").alias("frame")).select("doc", "frame", identity().alias("pose")))
        if front.isEmpty():
            break
        while not front.isEmpty():
            placed = checkpointed(front if placed is None else placed.unionByName(front))
            reach = steps.join(front.withColumnRenamed("frame", "a"), ["doc", "a"]).join(placed.select("doc", F.col("frame").alias("b")), ["doc", "b"], "left_anti")
            new = reach.groupBy("doc", "b").agg(F.min_by(F.struct("m", "pose"), F.struct("id", "a")).alias("s"))
            front = checkpointed(new.select("doc", F.col("b").alias("frame"), product(F.col("s.m"), F.col("s.pose")).alias("pose")))
    if placed is None:
        return t.select("doc", F.lit("transform.cycle").alias("code"), F.col("id").alias("subject")).limit(0)
    both = t.join(placed.select("doc", F.col("frame").alias("source"), F.col("pose").alias("_p")), ["doc", "source"]).join(placed.select("doc", F.col("frame").alias("target"), F.col("pose").alias("_q")), ["doc", "target"])
    both = both.withColumn("_r", product(F.col("matrix"), F.col("_p")))
    off = F.array_max(F.zip_with("_r", "_q", lambda x, y: F.abs(x - y) / F.greatest(F.lit(1.0), F.abs(x), F.abs(y))))
    return both.filter(off > RESIDUAL).select("doc", F.lit("transform.cycle").alias("code"), F.col("id").alias("subject"))


def chain_findings(chains: DataFrame, transforms: DataFrame) -> DataFrame:
    """Findings on ordered chains ``(doc, chain, start, goal, ids)``: each step begins where the last one ended, the last ends in the goal."""
    each = chains.select("doc", "chain", "start", "goal", F.posexplode_outer("ids").alias("n", "id"))
    t = transforms.dropDuplicates(["doc", "id"]).select("doc", "id", F.col("source").alias("_s"), F.col("target").alias("_t"))
    j = each.join(t, ["doc", "id"], "left")
    w = Window.partitionBy("doc", "chain").orderBy("n")  # the steps of one chain
    j = j.withColumn("_at", F.coalesce(F.lag("_t").over(w), F.col("start")))
    last = F.row_number().over(Window.partitionBy("doc", "chain").orderBy(F.desc("n"))) == 1
    end = F.coalesce(F.col("_t"), F.col("start"))
    j = j.withColumn("_last", last)
    code = F.when(F.col("id").isNotNull() & F.col("_t").isNull(), "reference.transform").when(F.col("id").isNotNull() & (F.col("_s") != F.col("_at")), "reference.transform_order").when(F.col("_last") & (end != F.col("goal")), "reference.transform_order")
    first = j.withColumn("code", code).filter("code is not null").groupBy("doc", "chain").agg(F.min_by("code", F.coalesce("n", F.lit(-1))).alias("code"))
    return first.select("doc", "code", F.col("chain").alias("subject"))
