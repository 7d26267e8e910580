"""Point-cloud evidence: masks, fingerprints, hash-ranked samples, nearest neighbours, distance statistics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec as v
from ..store import checkpointed

#: Fixed value: part of the ranked bytes of a sample.
ALGORITHM = "hash-rank-v1"
ROLES = ("measurement", "display", "distance-a", "distance-b")
PERCENTILES = (50, 95, 98, 99)


@F.pandas_udf(T.StringType())
def canonical(x: pd.Series) -> pd.Series:
    """Seventeen significant digits as Python prints them; minus zero is 0. The JVM's digits differ."""
    return pd.Series(["0" if n == 0 else format(n, ".17g") for n in x])


def contains(shape: dict, p: v.Vec) -> Column:
    """Whether a point is in an ``aabb`` or a ``sphere``, borders included."""
    if shape["type"] == "aabb":
        inside = [c.between(lo, hi) for c, lo, hi in zip(p, shape["min"], shape["max"], strict=True)]
        return inside[0] & inside[1] & inside[2]
    return v.length(v.sub(p, v.vec(*shape["center"]))) <= float(shape["radius"])


def compile_mask(mask: dict, frame: str) -> dict:
    """The mask, if it is well formed and in the given frame."""
    if set(mask) - {"frame", "include", "exclude"} or mask.get("frame") != frame:
        raise ValueError("mask has unknown members or another frame")
    shapes = [*mask.get("include", []), *mask.get("exclude", [])]
    if len(shapes) > 1024:
        raise ValueError("over 1024 mask definitions")
    for s in shapes:
        keys = {"aabb": {"type", "min", "max"}, "sphere": {"type", "center", "radius"}}.get(s.get("type"))
        if keys is None or set(s) != keys:
            raise ValueError("unknown mask definition")
        numbers = [*s["min"], *s["max"]] if s["type"] == "aabb" else [*s["center"], s["radius"]]
        if not all(isinstance(n, (int, float)) and not isinstance(n, bool) and math.isfinite(n) for n in numbers):
            raise ValueError("mask numbers must be finite")
        if s["type"] == "aabb" and any(a > b for a, b in zip(s["min"], s["max"], strict=True)) or s["type"] == "sphere" and s["radius"] <= 0:
            raise ValueError("empty mask definition")
    return mask


def mask_column(mask: dict | None, p: v.Vec) -> Column:
    """Inside any include (or there is none), and inside no exclude."""
    out = F.lit(True)
    if mask and mask.get("include"):
        out = contains(mask["include"][0], p)
        for s in mask["include"][1:]:
            out = out | contains(s, p)
    for s in (mask or {}).get("exclude", []):
        out = out & ~contains(s, p)
    return out


def fingerprint(points: DataFrame) -> DataFrame:
    """Count and bounds."""
    return points.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])


def canonical_sha256(points: DataFrame, chunk: int = 4096) -> DataFrame:
    """``(n, sha256)`` of all points as one stream of lines in the order of idx.

    Lines are made and joined in runs of ``chunk`` points, in parallel; the
    runs, sorted, then stream through one hash in one task, which holds one
    batch of them at a time: the digest is serial by definition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for text, count in zip(batch["text"], batch["n"], strict=True):
                digest.update(text.encode("ascii"))
                n += int(count)
        yield pd.DataFrame({"n": [n], "sha256": [digest.hexdigest()]})

    line = F.concat_ws(" ", canonical("x"), canonical("y"), canonical("z"))
    runs = points.select("idx", line.alias("t")).groupBy(F.floor(F.col("idx") / chunk).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "t"))).alias("l"))
    texts = runs.select("run", F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n")).alias("text"), F.size("l").alias("n"))
    return texts.repartition(1).sortWithinPartitions("run").select("text", "n").mapInPandas(run, "n long, sha256 string")


def sample_report(points: DataFrame, k: int, role: str = "measurement", seed: int = 0, mask: dict | None = None) -> DataFrame:
    """One row on ``hash_rank_sample``: method, counts, coverage in per cent, bounds of the sample."""
    p = tuple(F.col(c) for c in "xyz")
    counts = points.agg(F.count("*").alias("source_count"), F.count(F.when(mask_column(mask, p), 1)).alias("eligible_count"))
    kept = hash_rank_sample(points, k, role, seed, mask)
    facts = fingerprint(kept).withColumnRenamed("n", "sample_count")
    method = F.lit("masked-hash-rank") if mask else F.when(F.col("eligible_count") <= k, "full").otherwise("hash-rank")
    return counts.join(F.broadcast(facts), F.lit(True)).withColumn("method", method).withColumn("coverage_percent", 100.0 * F.col("eligible_count") / F.col("source_count"))


def merkle_fingerprint(points: DataFrame, chunk: int = 4096) -> DataFrame:
    """Order-dependent hash of the points: SHA-256 of runs of ``chunk`` points by idx, then of runs of hashes, until one is left.

    Each level is hashed in parallel and no task holds more than ``chunk``
    rows of a run. It is no hash of the points as one stream, and so has a
    name of its own. An empty cloud has no row.
    """

    def folded(rows: DataFrame, between: str) -> DataFrame:
        runs = rows.groupBy(F.floor(F.col("idx") / chunk).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("rows"))
        return checkpointed(runs.select(F.col("run").alias("idx"), F.sha2(F.array_join(F.transform("rows", lambda r: r["h"]), between), 256).alias("h")))

    text = F.concat_ws(" ", canonical("x"), canonical("y"), canonical("z"))
    level = folded(points.select("idx", text.alias("h")), "\n")
    while level.agg(F.max("idx")).first()[0]:
        level = folded(level, "")
    return level.select(F.col("h").alias("merkle"))


def rank_column(idx: Column, text: Column, role: str, seed: int) -> Column:
    """Hex SHA-256 of algorithm, role, seed, idx and the point's canonical text, zero bytes between."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    zero = "\0"
    return F.sha2(F.concat(F.lit(f"{ALGORITHM}{zero}{role}{zero}{seed}{zero}"), idx.cast("string"), F.lit(zero), text), 256)


def hash_rank_sample(points: DataFrame, k: int, role: str = "measurement", seed: int = 0, mask: dict | None = None) -> DataFrame:
    """The k points of least rank, ties by idx, after the mask; a top-k, so each task keeps k rows at most."""
    p = tuple(F.col(c) for c in "xyz")
    text = F.concat_ws(" ", canonical("x"), canonical("y"), canonical("z"))
    eligible = points.filter(mask_column(mask, p))
    return eligible.withColumn("rank", rank_column(F.col("idx"), text, role, seed)).orderBy("rank", "idx").limit(k)


#: Cells hold some eight targets at the start; no cell is narrower than this share of the largest coordinate, so that cell numbers are exact.
PER_CELL, NARROWEST = 8, -44


def _cell_exponent(targets: DataFrame, top: int) -> int:
    """The widest power of two below ``top`` at which cells hold PER_CELL targets or fewer on average: from one pass, by distinct cells."""
    steps = range(top, NARROWEST - 1, -2)
    cells = [F.approx_count_distinct(F.struct(*[F.floor(F.col(c) * 2.0**-e) for c in "xyz"])).alias(f"e{i}") for i, e in enumerate(steps)]
    n, *found = targets.agg(F.count("*"), *cells).first()
    return next((e for e, k in zip(steps, found, strict=True) if n <= PER_CELL * max(k, 1)), NARROWEST)


def nearest(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``(q, distance)``: distance of each query point ``(q, x, y, z)`` to the nearest target ``(x, y, z)``; null if there is none.

    Both sides are put in cells; a query looks at its cell and the 26 around
    it, and is done if it finds a target within one cell's width, for
    nothing outside is nearer. The others go on in cells twice as wide, up to
    twice the whole extent, where every query sees every target. So each round
    is an equi-join on cells, there are some fifty at most, and none is a
    product of the tables but what is left for that last one. Widths are
    powers of two, so cell numbers are exact at any magnitude; distances are
    of the coordinates as given. Equal targets are one. A difference beyond
    the range of a double raises.
    """
    steps = F.array(*[F.struct(*[F.lit(d).cast("long").alias(n) for d, n in zip((a, b, c), "abc", strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    largest = F.max(F.greatest(*[F.abs(c) for c in "xyz"]))
    sizes = [t.agg(largest).first()[0] for t in (queries, targets)]
    if sizes[0] is None or sizes[1] is None:
        return queries.select("q", F.lit(None).cast("double").alias("distance"))
    _, power = math.frexp(max(*sizes, 5e-324))
    at = [F.col(c) * 2.0 ** -(power // 2) * 2.0 ** -(power - power // 2) for c in "xyz"]  # within -1 and 1; in two steps, for 2 ** 1074 is no double

    def scaled(t: DataFrame, *keep: str) -> DataFrame:
        return t.select(*keep, *[F.col(c).alias(f"o{c}") for c in "xyz"], *[x.alias(c) for x, c in zip(at, "xyz", strict=True)])

    placed = checkpointed(scaled(targets.select(*"xyz").distinct()))
    open_, done, width = scaled(queries, "q"), None, _cell_exponent(placed, 2)
    far = v.distance(tuple(F.col(f"o{c}") for c in "xyz"), tuple(F.col(f"t{c}") for c in "xyz"))
    while True:
        key = lambda c: F.floor(F.col(c) * 2.0**-width).cast("long")  # noqa: B023,E731
        around = open_.withColumn("d", F.explode(steps)).select("q", *[f"o{c}" for c in "xyz"], *[(key(c) + F.col(f"d.{d}")).alias(f"c{c}") for c, d in zip("xyz", "abc", strict=True)])
        cells = placed.select(*[F.col(f"o{c}").alias(f"t{c}") for c in "xyz"], *[key(c).alias(f"c{c}") for c in "xyz"])
        best = around.join(cells, ["cx", "cy", "cz"]).groupBy("q").agg(F.min(far).alias("distance"))
        seen = checkpointed(open_.join(best, "q", "left"))
        # scaled back in two steps; beyond the extent nothing is left to look at
        near = F.lit(True) if width > 2 else F.col("distance") * 2.0 ** -(power // 2) * 2.0 ** -(power - power // 2) <= 2.0**width
        found = seen.filter(near).select("q", "distance")
        done = found if done is None else done.unionByName(found)
        open_ = seen.filter(~F.coalesce(near, F.lit(False))).drop("distance")
        if open_.isEmpty():
            return done.withColumn("distance", F.when(F.col("distance") == math.inf, F.raise_error(F.lit("a distance is beyond the range of a double")).cast("double")).otherwise(F.col("distance")))
        width += 1


def distance_statistics(distances: DataFrame, tolerance: float) -> DataFrame:
    """n, mean, rms, maximum, percentiles (linear between order statistics) and the share within the tolerance.

    Moments are of values over the largest, so no square over- or underflows;
    a moment or percentile of values above zero that underflows raises. Order
    statistics come from counts by range partition, not from one sorted task.
    No row comes back for an empty table.
    """
    n, scale = distances.agg(F.count("*"), F.max("distance")).first()
    ranked = numbered(distances.select("distance"), "distance")
    spots = {p: divmod((n - 1) * p, 100) for p in PERCENTILES}
    wanted = sorted({i + d for i, _ in spots.values() for d in (0, 1)})
    order = ranked.filter(F.col("i").isin(wanted)).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("distance").alias("d")))).alias("at"))  # eight rows at most
    unit = F.col("distance") / F.lit(scale) if scale else F.lit(0.0)
    moments = distances.agg(
        F.count("*").alias("n"), F.avg(unit).alias("u1"), F.sqrt(F.avg(unit * unit)).alias("u2"),
        (100.0 * F.avg(F.when(F.col("distance") <= tolerance, 1.0).otherwise(0.0))).alias("within_percent"),
    )
    top = F.lit(float(scale or 0.0))
    sound = lambda unit, x: F.when((unit > 0) & (x == 0), F.raise_error(F.lit("a statistic of distances above zero underflows")).cast("double")).otherwise(x)
    cols = [sound(F.col(u), F.col(u) * top).alias(name) for u, name in (("u1", "mean"), ("u2", "rms"))]
    marks = []
    for p, (low, rest) in spots.items():
        a, b = [F.try_element_at("at", F.lit(i).cast("long")) / F.lit(scale or 1.0) for i in (low, min(low + 1, max(n - 1, 0)))]
        u = a + (b - a) * (rest / 100.0)
        marks.append(sound(u, u * top).alias(f"p{p}"))
    return moments.join(F.broadcast(order), F.lit(True)).filter("n > 0").select("n", *cols, top.alias("maximum"), *marks, "within_percent")


def certificate(distances: DataFrame, tolerance: float) -> DataFrame:
    """Blocks of the sorted values between the order statistics that the percentiles and the tolerance need.

    A row per block, 64 at most: start, end (inclusive), first, last, sum and
    sum of squares of values over the largest, and the side of the tolerance.
    Positions come from counts by range partition, not from one sorted task.
    """
    n, within, scale = distances.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("distance") <= tolerance, 1)), F.lit(0)), F.max("distance")).first()
    if not n:
        raise ValueError("a certificate takes one value at least")
    cuts = {0, n, within}
    for p in PERCENTILES:
        low, rest = divmod((n - 1) * p, 100)
        cuts |= {low, low + 1, low + bool(rest), low + bool(rest) + 1}
    cuts = sorted(c for c in cuts if 0 <= c <= n)
    ranked = numbered(distances.select("distance"), "distance")
    block = F.aggregate(F.array(*[F.lit(c) for c in cuts[1:]]), F.lit(0), lambda a, c: a + F.when(F.col("i") >= c, 1).otherwise(0))
    u = F.col("distance") / F.lit(scale if scale else 1.0)
    return ranked.select(block.alias("block"), "i", u.alias("u")).groupBy("block").agg(
        F.min("i").alias("start_index"), F.max("i").alias("end_index"), F.min("u").alias("first"), F.max("u").alias("last"),
        F.sum("u").alias("sum"), F.sum(F.col("u") * F.col("u")).alias("sum_squares"),
        F.when(F.max("i") < within, "within").otherwise("outside").alias("threshold_class"),
    )


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with i, its place from 0 in the order: range-partitioned, counted by partition, then numbered within each."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_i", within).join(F.broadcast(before), "_p").withColumn("i", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def verify_certificate(blocks: DataFrame) -> DataFrame:
    """Findings on a certificate: gaps between blocks, values out of order, sums that no values can have."""
    w = Window.orderBy("start_index")
    n = F.col("end_index") - F.col("start_index") + 1
    eps = 1e-12
    b = blocks.withColumn("_gap", F.col("start_index") - F.coalesce(F.lag("end_index").over(w), F.lit(-1)) - 1).withColumn("_prev", F.lag("last").over(w))
    low = F.when(n == 1, F.col("first")).otherwise(F.col("first") * (n - 1) + F.col("last"))
    high = F.when(n == 1, F.col("last")).otherwise(F.col("first") + F.col("last") * (n - 1))
    rules = {
        "certificate_blocks": F.col("_gap") != 0,
        "certificate_order": (F.col("first") > F.col("last")) | (F.col("_prev") > F.col("first")),
        "certificate_sum": (F.col("sum") < low * (1 - eps)) | (F.col("sum") > high * (1 + eps)),
        "certificate_moments": F.col("sum_squares") * n < F.col("sum") * F.col("sum") * (1 - 1e-9),
    }
    found = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])))
    return b.select("start_index", found.alias("code"))


def transform_canary(bounds: DataFrame, m: Sequence[float], inverse: Sequence[float], tolerance: float = 1e-9) -> DataFrame:
    """Whether a transform and its inverse agree on the eight corners of boxes ``(lo_x ... hi_z)``."""
    corners = F.array(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for side, c in zip(pick, "xyz", strict=True)]) for pick in [(a, b, c) for a in ("lo", "hi") for b in ("lo", "hi") for c in ("lo", "hi")]])
    rows = bounds.withColumn("c", F.explode(corners))
    p = tuple(F.col(f"c.{c}") for c in "xyz")
    moved = v.apply_point(m, p)
    error = v.length(v.sub(v.apply_point(inverse, moved), p))
    a, b = [v.num(x) for x in m], [v.num(x) for x in inverse]
    cycle = F.greatest(v.identity_error(v.product(a, b)), v.identity_error(v.product(b, a)))
    det, condition = v.determinant3(m), v.linear_norm(m) * v.linear_norm(inverse)
    out = rows.agg(F.max(error).alias("round_trip_max"), F.count("*").alias("corners"), *[f(x).alias(f"{f.__name__}_{c}") for x, c in zip(moved, "xyz", strict=True) for f in (F.min, F.max)])
    return out.withColumn("determinant", det).withColumn("cycle_error", cycle).withColumn("condition", condition).withColumn(
        "ok", (F.abs(det) > 1e-12) & (condition <= 1e12) & (cycle <= 1e-8) & (F.col("round_trip_max") <= tolerance)
    )
