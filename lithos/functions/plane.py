"""Column builders for polylines, arcs, measures of entities, and small codecs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Millimetres for the unit codes of drawings.
UNIT_MM = {1: 25.4, 2: 304.8, 4: 1.0, 5: 10.0, 6: 1000.0, 8: 0.0000254, 9: 0.0254, 10: 914.4, 13: 0.001, 14: 100.0}
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def polyline_length(points: Column) -> Column:
    """Of an array of structs x, y, z; 0 for fewer than two."""
    n = F.size(points)
    part = lambda i: F.sqrt(sum(((F.get(points, i)[c] - F.get(points, i - 1)[c]) ** 2 for c in "yz"), (F.get(points, i)["x"] - F.get(points, i - 1)["x"]) ** 2))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), part), F.lit(0.0), lambda s, x: s + x))


def drop_repeats(items: Column) -> Column:
    """An array without the elements equal to the one before."""
    return F.filter(items, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(items, i - 1)))


def decimate_by(n: Column, at: Callable[[Column], Column], most: int) -> Column:
    """At most ``most`` of ``n`` elements (two at least), evenly spaced, both ends kept; ``at`` gives the element of a place from 0.

    Only the kept places are asked for, so elements that follow from their place need no list. Null for null.
    """
    n = n.cast("long")
    places = F.slice(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), F.lit(1), F.least(n, F.lit(most)).cast("int"))
    return F.when(n.isNotNull(), F.transform(places, lambda k: at(F.when(n <= most, k).otherwise(F.floor(k * (n - 1) / (most - 1) + 0.5)))))


def decimate(items: Column, most: int) -> Column:
    """``decimate_by`` of a list, which is evaluated once; null for null."""
    kept = lambda x: F.when(F.size(x) <= most, x).otherwise(decimate_by(F.size(x), lambda i: F.get(x, i.cast("int")), most))
    return F.get(F.transform(F.array(items), kept), F.lit(0))


def segment_distance(p: tuple[Column, ...], a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of a point to the segment from a to b, of any dimension."""
    along = sum(((y - x) * (q - x) for q, x, y in list(zip(p, a, b, strict=True))[1:]), (b[0] - a[0]) * (p[0] - a[0]))
    size = sum(((y - x) ** 2 for x, y in list(zip(a, b, strict=True))[1:]), (b[0] - a[0]) ** 2)
    t = F.least(F.greatest(F.coalesce(along / F.nullif(size, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    off = [(q - (x + (y - x) * t)) ** 2 for q, x, y in zip(p, a, b, strict=True)]
    return F.sqrt(sum(off[1:], off[0]))


def acute_angle(degrees: Column) -> Column:
    return F.when(degrees > 90, 180.0 - degrees).otherwise(degrees)


def circle_through(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """Struct x, y, radius of the circle through three points; null if they are in line."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    d = 2.0 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    safe = F.when(F.abs(d) > 1e-12, d)
    sa, sb, sc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    x, y = (sa * (by - cy) + sb * (cy - ay) + sc * (ay - by)) / safe, (sa * (cx - bx) + sb * (ax - cx) + sc * (bx - ax)) / safe
    return F.when(safe.isNotNull(), F.struct(x.alias("x"), y.alias("y"), F.hypot(ax - x, ay - y).alias("radius")))


def bulge_arc(x0: Column, y0: Column, x1: Column, y1: Column, bulge: Column) -> Column:
    """Struct cx, cy, radius, sweep (radians, signed) of a polyline's arc; null for a straight part."""
    sweep = 4.0 * F.atan(bulge)
    chord = F.hypot(x1 - x0, y1 - y0)
    radius = chord * (1.0 + bulge * bulge) / (4.0 * F.abs(bulge))
    lift = (1.0 - bulge * bulge) / (4.0 * bulge)  # from the chord's middle, in chords, to the left
    cx, cy = (x0 + x1) / 2.0 - (y1 - y0) * lift, (y0 + y1) / 2.0 + (x1 - x0) * lift
    return F.when((bulge != 0) & (chord > 0), F.struct(cx.alias("cx"), cy.alias("cy"), radius.alias("radius"), sweep.alias("sweep")))


def unit_scale(code: Column) -> Column:
    """Millimetres to a drawing's unit; null if it names none."""
    out = F.lit(None).cast("double")
    for k, mm in UNIT_MM.items():
        out = F.when(code == k, F.lit(mm)).otherwise(out)
    return out


def plain_mtext(text: Column) -> Column:
    """A drawing's formatted text without its codes: ``\\\\P`` is a line break, braces and ``\\\\X...;`` go."""
    out = F.regexp_replace(text, r"\\P", "\n")
    out = F.regexp_replace(out, r"\\~", " ")
    out = F.regexp_replace(out, r"\\S([^;^#/]*)[\^#/]([^;]*);", "$1/$2")
    out = F.regexp_replace(out, r"\\[ACcFfHhQTWp][^;\\{}]*;", "")
    out = F.regexp_replace(out, r"\\[LlOoKk]", "")
    return F.trim(F.regexp_replace(out, r"(?<!\\)[{}]", ""))


def base36(n: Column) -> Column:
    """Lower-case base 36 of a number from 0 on."""
    return F.lower(F.conv(n.cast("string"), 10, 36))


def uri_encoded(text: Column) -> Column:
    """Percent-encoded: all but letters, digits and ``-_.~`` by UTF-8 byte."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def disposition_name(name: Column) -> Column:
    """Header value for a download: an ASCII name and the encoded one."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7E]", "_"), r'["\\]', "_")
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), uri_encoded(name))


def normal_path(path: Column) -> Column:
    """A path with forward slashes, without empty or ``.`` segments; ``..`` takes back a segment, never the root."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, s: F.when(s != "..", F.concat(done, F.array(s))).when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def has_path_suffix(path: Column, suffix: Column) -> Column:
    """Whether the last segments of a path are those of ``suffix``, whole ones."""
    a, b = F.reverse(F.split(normal_path(path), "/")), F.reverse(F.split(F.ltrim(normal_path(suffix), F.lit("/")), "/"))
    return F.slice(a, F.lit(1), F.size(b)) == b


def mesh_uri_kind(uri: Column) -> Column:
    """package, absolute, relative, remote or invalid."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    package = uri.rlike(r"^package://[^/]+/+[^/]") & ~rest.rlike(r"(^|/)\.\.(/|$)")
    return (
        F.when(scheme == "package", F.when(package, "package").otherwise("invalid")).when(scheme == "file", F.when(rest.startswith("/"), "absolute").otherwise("relative"))
        .when(scheme != "", "remote").when(uri.startswith("/"), "absolute").otherwise("relative")
    )
