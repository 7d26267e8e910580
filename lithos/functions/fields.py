"""Scalar fields over points as Column expressions: helpers, blends, primitives, periodic surfaces and lattices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vec as v
from .vec import Vec, num

TURN = 2 * math.pi


def floor_mod(a: Column, b: object) -> Column:
    """With the sign of the divisor."""
    return a - num(b) * F.floor(a / num(b))


def clamp(x: Column, lo: object, hi: object) -> Column:
    return F.least(F.greatest(x, num(lo)), num(hi))


def mix(a: Column, b: Column, t: Column) -> Column:
    return a * (1.0 - t) + b * t


def smoothstep(lo: object, hi: object, x: Column) -> Column:
    t = clamp((x - num(lo)) / (num(hi) - num(lo)), 0, 1)
    return t * t * (3.0 - 2.0 * t)


def linear_map(x: Column, a: object, b: object, c: object, d: object) -> Column:
    return (x - num(a)) * ((num(d) - num(c)) / (num(b) - num(a))) + num(c)


def ramp(x: Column, a: object, b: object, c: object, d: object) -> Column:
    return clamp(linear_map(x, a, b, c, d), c, d)


def two_body_field(a: Column, b: Column) -> Column:
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def two_body_polar(a: Column, b: Column, angle: object) -> Column:
    return a * F.cos(num(angle)) + b * F.sin(num(angle))


def wave_even(x: Column, period: object) -> Column:
    """Triangle wave about zero, of a quarter period at most, highest at whole periods."""
    p = num(period)
    return p * 0.25 - F.abs(floor_mod(x + p * 0.5, p) - p * 0.5)


def wave_even_positive(x: Column, period: object) -> Column:
    return wave_even(x, period) + num(period) * 0.25


def wave_odd(x: Column, period: object) -> Column:
    return wave_even(x - num(period) * 0.5, period)


def wave_odd_positive(x: Column, period: object) -> Column:
    return wave_odd(x, period) + num(period) * 0.25


def repeat_centered(x: Column, period: object) -> Column:
    p = num(period)
    return floor_mod(x + p * 0.5, p) - p * 0.5


# ---- blends: what is inside both of two fields; unions mirror them ----------


def both_round(a: Column, b: Column, r: object) -> Column:
    k = F.greatest(num(r), F.lit(0.0))
    corner = v.length((F.greatest(a + k, F.lit(0.0)), F.greatest(b + k, F.lit(0.0))))
    return F.least(-k, F.greatest(a, b)) + corner


def both_chamfer(a: Column, b: Column, r: object) -> Column:
    return F.greatest(a, b, (a + b + num(r)) * math.sqrt(0.5))


def both_exp(a: Column, b: Column, r: object) -> Column:
    """The soft maximum, with the larger exponent taken out, so that it cannot overflow."""
    k = F.greatest(num(r), F.lit(1e-6)) * 0.5
    return F.greatest(a, b) + k * F.log1p(F.exp(-F.abs(a - b) / k))


def both_norm(a: Column, b: Column, r: object, power: object) -> Column:
    k, p = F.greatest(num(r), F.lit(0.0)), F.greatest(num(power), F.lit(1e-6))
    corner = F.pow(F.pow(F.greatest(a + k, F.lit(0.0)), p) + F.pow(F.greatest(b + k, F.lit(0.0)), p), 1.0 / p)
    return F.least(-k, F.greatest(a, b)) + corner


def both_rvachev(a: Column, b: Column, r: object) -> Column:
    sharp, k = F.greatest(a, b), F.greatest(num(r), F.lit(0.0))
    s = smoothstep(0, 1, (sharp + k) / F.nullif(k, F.lit(0.0)))
    return F.when((k <= 0) | (sharp < -k), sharp).otherwise(mix(sharp, a + b - F.sqrt(a * a + b * b), s))


def either(blend, a: Column, b: Column, *rest: object) -> Column:  # noqa: ANN001
    """The union of two fields by the blend of their complements."""
    return -blend(-a, -b, *rest)


# ---- primitives ------------------------------------------------------------


def sphere(p: Vec, center: Vec, radius: object) -> Column:
    return v.length(v.sub(p, center)) - num(radius)


def box(p: Vec, size: Vec, center: Vec) -> Column:
    q = [F.abs(x) - s * 0.5 for x, s in zip(v.sub(p, center), size, strict=True)]
    return v.length(tuple(F.greatest(x, F.lit(0.0)) for x in q)) + F.least(F.greatest(*q), F.lit(0.0))


def plane(p: Vec, origin: Vec, normal: Vec) -> Column:
    """Also of the plane of two coordinates."""
    return v.dot(v.sub(p, origin), v.unit(normal))


def segment(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance to a segment, of two or three coordinates."""
    along, off = v.sub(b, a), v.sub(p, a)
    n = v.dot(along, along)
    t = F.when(n < 1e-12, 0.0).otherwise(clamp(v.dot(off, along) / F.nullif(n, F.lit(0.0)), 0, 1))
    return v.length(v.sub(off, v.scale(along, t)))


def torus(p: Vec, major: object, minor: object) -> Column:
    return v.length((v.length(p[:2]) - num(major), p[2])) - num(minor)


def axis(p: Vec, origin: Vec, direction: Vec) -> Column:
    off, n = v.sub(p, origin), v.length(direction)
    u = v.scale(direction, 1.0 / F.nullif(n, F.lit(0.0)))
    return F.when(n < 1e-12, v.length(off)).otherwise(v.length(v.sub(off, v.scale(u, v.dot(off, u)))))


def cylinder(p: Vec, origin: Vec, direction: Vec, radius: object) -> Column:
    return axis(p, origin, direction) - num(radius)


def capped_cylinder(p: Vec, a: Vec, b: Vec, radius: object) -> Column:
    along = v.sub(b, a)
    return F.greatest(cylinder(p, a, along, radius), -plane(p, a, along), plane(p, b, along))


def capsule(p: Vec, a: Vec, b: Vec, radius: object) -> Column:
    return segment(p, a, b) - num(radius)


def cone_capsule(p: Vec, a: Vec, b: Vec, ra: object, rb: object) -> Column:
    along, off = v.sub(b, a), v.sub(p, a)
    n = v.dot(along, along)
    t = F.when(n < 1e-12, 0.0).otherwise(clamp(v.dot(off, along) / F.nullif(n, F.lit(0.0)), 0, 1))
    return segment(p, a, b) - mix(num(ra), num(rb), t)


def cone(p: Vec, apex: Vec, direction: Vec, half_angle: object) -> Column:
    off, u = v.sub(p, apex), v.unit(direction)
    up = v.dot(off, u)
    return F.coalesce(v.length(v.sub(off, v.scale(u, up))) - up * F.tan(num(half_angle)), v.length(off))


def capped_cone(p: Vec, a: Vec, b: Vec, ra: object, rb: object) -> Column:
    along = v.sub(b, a)
    half = F.atan2(F.abs(num(rb) - num(ra)), v.length(along))
    side = F.when(num(ra) < num(rb), cone(p, a, along, half) - num(ra)).otherwise(cone(p, b, v.scale(along, -1), half) - num(rb))
    return F.when(v.length(along) < 1e-12, sphere(p, a, ra)).otherwise(F.greatest(side, -plane(p, a, along), plane(p, b, along)))


def shell(d: Column, thickness: object, bias: object = 0) -> Column:
    t = num(thickness)
    return F.abs(d + num(bias) * t * 0.5) - t * 0.5


def rotate_axis(p: Vec, origin: Vec, direction: Vec, angle: object) -> Vec:
    """Turned about an axis (Rodrigues)."""
    k, off, c, s = v.unit(direction), v.sub(p, origin), F.cos(num(angle)), F.sin(num(angle))
    return v.add(v.add(v.add(origin, v.scale(off, c)), v.scale(v.cross(k, off), s)), v.scale(k, v.dot(k, off) * (1.0 - c)))


def remap_cylindrical(p: Vec, circumference: object) -> Vec:
    return v.length(p[:2]), F.atan2(p[1], p[0]) * (num(circumference) / TURN), p[2]


# ---- triply periodic surfaces: each is scaled by the mean period -------------


def _phases(p: Vec, period: tuple[float, float, float]) -> tuple[list[Column], list[Column], list[Column], list[Column]]:
    t = [x * (TURN / q) for x, q in zip(p, period, strict=True)]
    return [F.sin(x) for x in t], [F.cos(x) for x in t], [F.sin(2.0 * x) for x in t], [F.cos(2.0 * x) for x in t]


def _sum3(f) -> Column:  # noqa: ANN001
    """Sum over the three cyclic choices of axes (i, next, next but one)."""
    return f(0, 1, 2) + f(1, 2, 0) + f(2, 0, 1)


def gyroid(p: Vec, period: tuple[float, float, float], drop: tuple[float, float, float] = (1, 1, 1)) -> Column:
    s, c, _, _ = _phases(p, period)
    return _sum3(lambda i, j, k: drop[i] * s[i] * c[j]) * (sum(period) / 18)


def schwarz(p: Vec, period: tuple[float, float, float], drop: tuple[float, float, float] = (1, 1, 1), blend: float = 0) -> Column:
    s, c, _, _ = _phases(p, period)
    return _sum3(lambda i, j, k: drop[i] * c[j] * (s[i] * blend - (1 - blend))) * (sum(period) / 36)


def diamond(p: Vec, period: tuple[float, float, float], drop: tuple[float, float, float] = (1, 1, 1), blend: float = 0) -> Column:
    s, c, _, _ = _phases(p, period)
    mixed = _sum3(lambda i, j, k: drop[i] * s[i] * c[j] * (c[k] * (1 - blend) + blend))
    return (s[0] * s[1] * s[2] * (1 - blend) + mixed) * (sum(period) / (12 * math.sqrt(8)))


def lidinoid(p: Vec, period: tuple[float, float, float], drop: tuple[float, float, float] = (1, 1, 1), blend: float = 0) -> Column:
    s, c, s2, c2 = _phases(p, period)
    first = _sum3(lambda i, j, k: drop[i] * s[k] * c[j] * (s2[i] * (1 - blend) + blend))
    return (first - (1 - blend) * _sum3(lambda i, j, k: c2[i] * c2[j])) * (sum(period) / 72)


def neovius(p: Vec, period: tuple[float, float, float], drop: tuple[float, float, float] = (1, 1, 1), blend: float = 0) -> Column:
    _, c, _, _ = _phases(p, period)
    d = [c[i] * drop[i] for i in range(3)]
    return (-(d[0] + d[1] + d[2]) - (1 - blend) * (4 / 3) * d[0] * d[1] * d[2]) * (sum(period) / 52)


def split_p(p: Vec, period: tuple[float, float, float], lid: float = 1.1, gyr: float = -0.2, sch: float = -0.4) -> Column:
    s, c, s2, c2 = _phases(p, period)
    return _sum3(lambda i, j, k: s2[i] * c[j] * s[k] * -lid + s2[i] * c2[i] * gyr + c2[i] * sch) * (sum(period) / 36)


def iwp(p: Vec, period: tuple[float, float, float], drop: tuple[float, float, float] = (1, 1, 1)) -> Column:
    _, c, _, c2 = _phases(p, period)
    return _sum3(lambda i, j, k: 2 * drop[i] * c[i] * c[j] - c2[i]) * (sum(period) / 48)


def cubic_grid(p: Vec, size: tuple[float, float, float]) -> Column:
    return F.least(*[wave_even_positive(x, s) for x, s in zip(p, size, strict=True)])


def square_honeycomb(p: Vec, size: tuple[float, float]) -> Column:
    return F.least(*[wave_even_positive(x, s) for x, s in zip(p[:2], size, strict=True)])


def reinforced_honeycomb(p: Vec, size: tuple[float, float], turns: tuple[float, ...] = (0.25,)) -> Column:
    """The square comb with a diagonal wall for each angle, in half turns."""
    cell = tuple(repeat_centered(x, s) for x, s in zip(p[:2], size, strict=True))
    return F.least(square_honeycomb(p, size), *[F.abs(plane(cell, v.vec(0, 0), v.vec(math.cos(math.pi * t), math.sin(math.pi * t)))) for t in turns])


def diagonal_honeycomb(p: Vec, size: tuple[float, float]) -> Column:
    cell = tuple(repeat_centered(x, sum(size)) for x in p[:2])
    return F.least(*[F.abs(plane(cell, v.vec(0, 0), v.vec(size[1], side * size[0]))) for side in (1, -1)])


def octet_honeycomb(p: Vec, size: tuple[float, float]) -> Column:
    walls = [wave_odd_positive(x, s) for x, s in zip(p[:2], size, strict=True)]
    turned = [(p[0] + p[1]) / math.sqrt(2), (p[0] - p[1]) / math.sqrt(2)]
    period = math.hypot(*size) * 0.5
    return F.least(square_honeycomb(p, size), *walls, *[wave_odd_positive(x, period) for x in turned])


# ---- further mathematics -----------------------------------------------------

#: Functions of one number, by the names of the field language; ``round`` goes up at the half, ``roundEven`` to the even.
MATH = {
    "radians": F.radians, "degrees": F.degrees, "asin": F.asin, "acos": F.acos, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "exp2": lambda x: F.pow(F.lit(2.0), x), "log2": F.log2, "inversesqrt": lambda x: 1.0 / F.sqrt(x), "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
    "round": lambda x: F.floor(x + 0.5).cast("double"), "roundEven": lambda x: F.bround(x, 0),
}


def step(edge: Column, x: Column) -> Column:
    return F.when(x < edge, 0.0).otherwise(1.0)


def reflect(i: v.Vec, n: v.Vec) -> v.Vec:
    """A direction mirrored at a plane of unit normal n."""
    return v.sub(i, v.scale(n, 2.0 * v.dot(n, i)))


def swizzle(p: v.Vec, names: str) -> v.Vec:
    """Components by name, ``xyzw`` or ``rgba``, in any order and repeated."""
    at = {c: i for group in ("xyzw", "rgba", "stpq") for i, c in enumerate(group)}
    return tuple(p[at[c]] for c in names)
