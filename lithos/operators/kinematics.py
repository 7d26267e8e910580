"""Forward kinematics: joints ``(robot, parent, child, origin, type, axis, value)`` to the pose of every link.

origin is a 4x4 matrix, 16 numbers by row; axis an array of three numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import checkpointed

IDENTITY = [float(i % 5 == 0) for i in range(16)]


def identity() -> Column:
    return F.array(*[F.lit(x) for x in IDENTITY])


def product(a: Column, b: Column) -> Column:
    """Product of two matrices held as arrays; one small expression, whatever they are."""
    at = lambda m, i: F.get(m, i)
    cell = lambda k: sum((at(a, F.floor(k / 4).cast("int") * 4 + j) * at(b, k % 4 + 4 * j) for j in range(1, 4)), at(a, F.floor(k / 4).cast("int") * 4) * at(b, k % 4))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def inverse_rigid_point(m: Column, p: Column) -> Column:
    """A point in the coordinates of a rigid frame."""
    d = [F.get(p, F.lit(i)) - F.get(m, F.lit(4 * i + 3)) for i in range(3)]
    return F.array(*[sum((F.get(m, F.lit(4 * i + j)) * d[i] for i in range(1, 3)), F.get(m, F.lit(j)) * d[0]) for j in range(3)])


def turn(axis: Column, angle: Column) -> Column:
    """Rotation about an axis of any length above zero, as a matrix."""
    size = F.sqrt(F.aggregate(axis, F.lit(0.0), lambda s, x: s + x * x))
    x, y, z = [F.get(axis, F.lit(i)) / F.nullif(size, F.lit(0.0)) for i in range(3)]
    c, s = F.cos(angle), F.sin(angle)
    t = 1.0 - c
    o = F.lit(0.0)
    return F.array(t * x * x + c, t * x * y - s * z, t * x * z + s * y, o, t * x * y + s * z, t * y * y + c, t * y * z - s * x, o, t * x * z - s * y, t * y * z + s * x, t * z * z + c, o, o, o, o, F.lit(1.0))


def slide(axis: Column, by: Column) -> Column:
    out = [F.lit(x) for x in IDENTITY]
    for i in range(3):
        out[4 * i + 3] = F.get(axis, F.lit(i)) * by
    return F.array(*out)


def clamped(value: Column, lower: Column, upper: Column, kind: Column) -> Column:
    """A joint's value within its limits; continuous joints have none, fixed ones are at 0."""
    inside = F.least(F.greatest(value, F.coalesce(lower, value)), F.coalesce(upper, value))
    return F.when(kind == "fixed", 0.0).when(kind == "continuous", value).otherwise(inside)


def resolve_mimics(joints: DataFrame) -> DataFrame:
    """``(robot, joint, value)``: a joint that mimics another takes multiplier * value + offset of the last in its chain.

    Chains are halved each round by pointer jumping; a chain that never ends,
    or ends in no joint, leaves the joint its own value.
    """
    own = joints.select("robot", "joint", "value")
    now = checkpointed(joints.select("robot", "joint", F.col("mimic").alias("to"), F.coalesce("multiplier", F.lit(1.0)).alias("m"), F.coalesce("offset", F.lit(0.0)).alias("b")).filter("to is not null"))
    for _ in range(20):
        step = now.select("robot", F.col("joint").alias("to"), F.col("to").alias("_to"), F.col("m").alias("_m"), F.col("b").alias("_b"))
        hit = now.join(step, ["robot", "to"], "left")
        if hit.filter("_to is not null").isEmpty():
            break
        now = checkpointed(hit.select("robot", "joint", F.coalesce("_to", "to").alias("to"), F.when(F.col("_to").isNull(), F.col("m")).otherwise(F.col("m") * F.col("_m")).alias("m"), F.when(F.col("_to").isNull(), F.col("b")).otherwise(F.col("m") * F.col("_b") + F.col("b")).alias("b")))
    ends = now.join(own.select("robot", F.col("joint").alias("to"), F.col("value").alias("_v")), ["robot", "to"]).select("robot", "joint", (F.col("m") * F.col("_v") + F.col("b")).alias("_r"))
    return own.join(ends, ["robot", "joint"], "left").select("robot", "joint", F.coalesce("_r", "value").alias("value"))


def link_poses(joints: DataFrame) -> DataFrame:
    """``(robot, link, root, pose)`` of every link, from its joint's origin and motion, up to the root of its tree.

    Paths are doubled each round, so a chain of n joints takes log n joins;
    links of a cycle have no root and are left out.
    """
    moved = F.when(F.col("type").isin("revolute", "continuous"), turn(F.col("axis"), F.col("value"))).when(F.col("type") == "prismatic", slide(F.col("axis"), F.col("value"))).otherwise(identity())
    step = joints.withColumn("_move", moved).select("robot", F.col("child").alias("link"), F.col("parent").alias("up"), product(F.col("origin"), F.col("_move")).alias("pose"))
    step = checkpointed(step)
    roots = checkpointed(step.select("robot", F.col("up").alias("link")).distinct().join(step.select("robot", "link"), ["robot", "link"], "left_anti"))
    marks = roots.select("robot", F.col("link").alias("up"), F.lit(True).alias("ended"))
    now = checkpointed(step.join(marks, ["robot", "up"], "left"))
    ended = 0
    while True:
        # of links on their way to a root some arrive in every round; if none does, the rest go in circles
        arrived = now.filter("ended").count()
        if arrived == ended or arrived == now.count():
            break
        ended = arrived
        above = now.select("robot", F.col("link").alias("up"), F.col("up").alias("_up"), F.col("pose").alias("_pose"))
        moved = now.filter("ended is null").drop("ended").join(above, ["robot", "up"]).select("robot", "link", F.col("_up").alias("up"), product(F.col("_pose"), F.col("pose")).alias("pose")).join(marks, ["robot", "up"], "left")
        now = checkpointed(now.filter("ended").select("robot", "up", "link", "pose", "ended").unionByName(moved))
    found = now.filter("ended").select("robot", "link", F.col("up").alias("root"), "pose")
    return found.unionByName(roots.select("robot", "link", F.col("link").alias("root"), identity().alias("pose")))


def sample_track(keys: DataFrame, times: DataFrame, loop: float | None = None) -> DataFrame:
    """Values of tracks ``(track, t, v)`` at ``(track, at)``: linear between keys, clamped at the ends, or wrapped by the duration ``loop``.

    Keys and times are merged in one order by track and each time takes the
    last key before it and the next one: no join of all times with all keys.
    """
    from pyspark.sql import Window

    at = F.pmod(F.col("at"), F.lit(loop)) if loop else F.col("at")
    rows = keys.select("track", "t", "v", F.lit(None).cast("double").alias("at")).unionByName(times.select("track", at.alias("t"), F.lit(None).cast("double").alias("v"), "at"))
    order = Window.partitionBy("track").orderBy("t", F.col("at").isNotNull())
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    key = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    m = rows.withColumn("_a", F.last(key, True).over(before)).withColumn("_b", F.first(key, True).over(after)).filter("at is not null")
    share = (F.col("t") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    value = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.coalesce(share, F.lit(0.0)))
    return m.select("track", "at", value.alias("value"))
