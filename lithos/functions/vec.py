"""Column builders for 3-vectors, 4x4 matrices, boxes and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
ALIGNED = 0.985


def num(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vec(*parts: object) -> Vec:
    return tuple(num(p) for p in parts)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k: object) -> Vec:
    return tuple(x * num(k) for x in a)


def total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def dot(a: Vec, b: Vec) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    """Distance of two points without over- or underflow of squares; infinite only if a difference is."""
    d = [F.abs(x) for x in sub(a, b)]
    top = F.greatest(*d)
    return F.when((top == 0) | (top == float("inf")), top).otherwise(top * F.sqrt(total([(x / top) * (x / top) for x in d])))


def unit(a: Vec) -> Vec:
    """Null components for a vector of no length."""
    n = F.nullif(length(a), F.lit(0.0))
    return tuple(x / n for x in a)


def apply_point(m: Sequence[object], p: Vec) -> Vec:
    """Homogeneous transform, 16 numbers by row; divides by w; null where w is about 0."""
    row = lambda i: num(m[i]) * p[0] + num(m[i + 1]) * p[1] + num(m[i + 2]) * p[2] + num(m[i + 3])
    w = row(12)
    safe = F.when(F.abs(w) > 1e-15, w)
    return row(0) / safe, row(4) / safe, row(8) / safe


def apply_direction(m: Sequence[object], d: Vec) -> Vec:
    """The linear part only."""
    return tuple(num(m[i]) * d[0] + num(m[i + 1]) * d[1] + num(m[i + 2]) * d[2] for i in (0, 4, 8))


def apply_box(m: Sequence[object], lo: Vec, hi: Vec) -> tuple[Vec, Vec]:
    """The box of the eight moved corners, in closed form: each entry takes the corner that serves it."""
    low, high = [], []
    for i in (0, 4, 8):
        ends = [(num(m[i + j]) * lo[j], num(m[i + j]) * hi[j]) for j in range(3)]
        low.append(total([F.least(a, b) for a, b in ends]) + num(m[i + 3]))
        high.append(total([F.greatest(a, b) for a, b in ends]) + num(m[i + 3]))
    return tuple(low), tuple(high)


def determinant3(m: Sequence[object]) -> Column:
    a, b, c = vec(*m[0:3]), vec(*m[4:7]), vec(*m[8:11])
    return dot(a, cross(b, c))


def product(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Product of two 4x4 matrices."""
    return [total([a[4 * i + k] * b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)]


def identity_error(m: Sequence[Column]) -> Column:
    return F.greatest(*[F.abs(x - (1.0 if i % 5 == 0 else 0.0)) for i, x in enumerate(m)])


def linear_norm(m: Sequence[object]) -> Column:
    """Largest row sum of absolute entries of the linear part."""
    return F.greatest(*[total([F.abs(num(m[i + j])) for j in range(3)]) for i in (0, 4, 8)])


def dominant_axis(v: Vec) -> Column:
    """Struct axis, sign, magnitude, aligned; the first of equal components; null without length."""
    u = unit(v)
    a = [F.abs(x) for x in u]
    pick = lambda xs: F.when((a[0] >= a[1]) & (a[0] >= a[2]), xs[0]).when(a[1] >= a[2], xs[1]).otherwise(xs[2])
    found = F.struct(pick([F.lit(c) for c in "xyz"]).alias("axis"), F.when(pick(u) >= 0, 1).otherwise(-1).alias("sign"), pick(a).alias("magnitude"), (pick(a) >= ALIGNED).alias("aligned"))
    return F.when(u[0].isNotNull(), found)


def relationship(a: Vec, b: Vec) -> Column:
    """opposed, parallel, perpendicular or angled; null if either has no length."""
    d = dot(unit(a), unit(b))
    return F.when(d <= -ALIGNED, "opposed").when(d >= ALIGNED, "parallel").when(F.abs(d) <= 1 - ALIGNED, "perpendicular").when(d.isNotNull(), "angled")


def view_name(axis: Column, sign: Column) -> Column:
    names = {"x": ("right", "left"), "y": ("back", "front"), "z": ("top", "bottom")}
    out = F.lit(None).cast("string")
    for k, (plus, minus) in names.items():
        out = F.when(axis == k, F.when(sign >= 0, plus).otherwise(minus)).otherwise(out)
    return out


def angle_degrees(a: Vec, b: Vec) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(dot(unit(a), unit(b)), F.lit(-1.0)), F.lit(1.0))))


def snap(x: Column, to: Column, tol: float) -> Column:
    return F.when(F.abs(x - to) <= tol, to).otherwise(x)


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def hex_channel(text: Column, i: int) -> Column:
    return F.conv(F.substring(F.ltrim(text, F.lit("#")), 2 * i + 1, 2), 16, 10).cast("double") / 255.0


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Of a symmetric 3x3 matrix, largest first, by angles."""
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2.0 * off) / 6.0)
    safe = F.when(p > 0, p)
    a, b, c = (xx - q) / safe, (yy - q) / safe, (zz - q) / safe
    d, e, f = xy / safe, xz / safe, yz / safe
    half = (a * b * c + 2.0 * d * e * f - a * f * f - b * e * e - c * d * d) / 2.0
    phi = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3.0
    first = q + 2.0 * p * F.cos(phi)
    last = q + 2.0 * p * F.cos(phi + 2.0943951023931953)
    return [F.coalesce(x, q) for x in (first, 3.0 * q - first - last, last)]


def rpy_matrix(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Rotation of fixed axes x, y, z in turn, as nine numbers by row."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr]


def rpy_quaternion(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """x, y, z, w."""
    h = [x / 2.0 for x in (roll, pitch, yaw)]
    (cr, cp, cy), (sr, sp, sy) = [F.cos(x) for x in h], [F.sin(x) for x in h]
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]


def arc_extreme(start: Column, sweep: Column, at: float) -> Column:
    """Whether the angle ``at`` (radians) lies in the sweep from start, both counter-clockwise."""
    turn = 6.283185307179586
    off = (F.lit(at) - start) - turn * F.floor((F.lit(at) - start) / turn)
    return off <= sweep + 1e-12


def polygon_area(xs: Column, ys: Column) -> Column:
    """Absolute shoelace area of a ring given as two arrays; closed by its first point."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.when(n >= 3, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2.0).otherwise(F.lit(0.0))
