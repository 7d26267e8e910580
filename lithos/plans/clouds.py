"""Queries over points, boxes and fields; ``embeddings`` lends its first dimensions as coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fl
from ..functions import vec as v
from ..operators import boxes, cloud
from ..registry import query, table

XYZ = "vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z"
MASK = {"frame": "world", "include": [{"type": "aabb", "min": [-1, -1, -1], "max": [1, 1, 1]}, {"type": "sphere", "center": [0, 0, 0], "radius": 1.5}], "exclude": [{"type": "sphere", "center": [0.2, 0.1, 0], "radius": 0.4}]}
MASK_SQL = "((x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1) OR sqrt(x*x + y*y + z*z) <= 1.5) AND NOT sqrt((x-0.2)*(x-0.2) + (y-0.1)*(y-0.1) + z*z) <= 0.4"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")], e[3].cast("double").alias("u"), e[4].cast("double").alias("w"), e[5].cast("double").alias("t"))


def xyz() -> v.Vec:
    return tuple(F.col(c) for c in "xyz")


def near(x: object, digits: int = 6):  # noqa: ANN201
    """Rounded, without a minus zero."""
    return F.round(x, digits) + F.lit(0.0)


def sql_near(x: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE, {digits}) + 0.0"


@query(f"SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM (SELECT {XYZ} FROM embeddings)")
def cloud_fingerprint(spark, sf_dir):
    return cloud.fingerprint(points(spark, sf_dir))


_LINE = " || ' ' || ".join(f"CASE WHEN {c} = 0 THEN '0' ELSE printf('%.17g', {c}) END" for c in "xyz")


@query(f"SELECT count(*) AS n, sha256(string_agg({_LINE} || chr(10), '' ORDER BY idx)) AS sha256 FROM (SELECT {XYZ} FROM embeddings)")
def cloud_stream_hash(spark, sf_dir):
    return cloud.canonical_sha256(points(spark, sf_dir), 100)


@query(f"WITH p AS (SELECT {XYZ} FROM embeddings), e AS (SELECT * FROM p WHERE {MASK_SQL}), s AS (SELECT * FROM e ORDER BY sha256('{cloud.ALGORITHM}' || chr(0) || 'display' || chr(0) || '3' || chr(0) || idx || chr(0) || {_LINE}), idx LIMIT 40) SELECT 'masked-hash-rank' AS method, (SELECT count(*) FROM p) AS source_count, (SELECT count(*) FROM e) AS eligible_count, count(*) AS sample_count, {sql_near('100.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM p)')} AS coverage_percent, min(x) AS min_x, max(z) AS max_z FROM s")
def sample_report(spark, sf_dir):
    r = cloud.sample_report(points(spark, sf_dir), 40, "display", 3, MASK)
    return r.select("method", "source_count", "eligible_count", "sample_count", near("coverage_percent").alias("coverage_percent"), "min_x", "max_z")


@query()
def cloud_merkle_fingerprint(spark, sf_dir):
    return cloud.merkle_fingerprint(points(spark, sf_dir))


@query(f"SELECT idx, x, y, z FROM (SELECT {XYZ} FROM embeddings) WHERE {MASK_SQL}")
def mask_filter_aabb_sphere(spark, sf_dir):
    return points(spark, sf_dir).filter(cloud.mask_column(cloud.compile_mask(MASK, "world"), xyz())).select("idx", "x", "y", "z")


_FMT = " || ' ' || ".join(f"CASE WHEN {c} = 0 THEN '0' ELSE printf('%.17g', {c}) END" for c in "xyz")


@query(f"""WITH p AS (SELECT {XYZ} FROM embeddings), r AS (SELECT idx, sha256('{cloud.ALGORITHM}' || chr(0) || 'measurement' || chr(0) || '7' || chr(0) || idx || chr(0) || {_FMT}) AS rank FROM p WHERE {MASK_SQL})
SELECT idx, rank FROM r ORDER BY rank, idx LIMIT 50""")
def hash_rank_sample(spark, sf_dir):
    return cloud.hash_rank_sample(points(spark, sf_dir), 50, "measurement", 7, MASK).select("idx", "rank")


_NN = f"WITH p AS (SELECT {XYZ} FROM embeddings), t AS (SELECT -y AS x, x AS y, z FROM p), d AS (SELECT a.idx AS q, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS distance FROM p a, t b GROUP BY a.idx)"


def _distances(spark, sf_dir):
    """From every point of the cloud to the cloud turned by 90 degrees about z."""
    p = points(spark, sf_dir)
    turned = p.select((-F.col("y")).alias("x"), F.col("x").alias("y"), "z")
    return cloud.nearest(p.withColumnRenamed("idx", "q"), turned)


@query(f"{_NN} SELECT q, {sql_near('distance', 9)} AS distance FROM d")
def nn_distance(spark, sf_dir):
    return _distances(spark, sf_dir).select("q", near("distance", 9).alias("distance"))


@query(f"WITH p AS (SELECT {XYZ} FROM embeddings), k AS (SELECT *, CASE idx % 3 WHEN 0 THEN 1e200 WHEN 1 THEN 1e-200 ELSE 1.0 END AS s FROM p), q AS (SELECT idx, s, x * s AS x, y * s AS y, z * s AS z, greatest(abs(x), abs(y), abs(z)) * s AS m FROM k) SELECT idx AS q, {sql_near('m / s * sqrt((x / m) * (x / m) + (y / m) * (y / m) + (z / m) * (z / m))', 9)} AS distance FROM q")
def nn_magnitudes(spark, sf_dir):
    """Points scaled by 1e200, 1e-200 or 1, each cloud against the origin."""
    k, origin = F.col("idx") % 3, spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    out = None
    for i, s in enumerate((1e200, 1e-200, 1.0)):
        scaled = points(spark, sf_dir).filter(k == i).select(F.col("idx").alias("q"), *[(F.col(c) * s).alias(c) for c in "xyz"])
        part = cloud.nearest(scaled, origin).select("q", near(F.col("distance") / s, 9).alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_NN} SELECT count(*) AS n, {sql_near('avg(distance)')} AS mean, {sql_near('sqrt(avg(distance*distance))')} AS rms, {sql_near('max(distance)')} AS maximum, " + ", ".join(f"{sql_near(f'quantile_cont(distance, {p / 100})')} AS p{p}" for p in cloud.PERCENTILES) + f", {sql_near('100.0 * avg((distance <= 0.3)::INT)')} AS within_percent FROM d")
def nn_stats(spark, sf_dir):
    s = cloud.distance_statistics(_distances(spark, sf_dir), 0.3)
    return s.select("n", *[near(c).alias(c) for c in s.columns if c != "n"])


@query(f"""{_NN}, s AS (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS i, count(*) OVER () AS n, max(distance) OVER () AS scale, sum((distance <= 0.3)::INT) OVER () AS within FROM d),
c AS (SELECT DISTINCT unnest([0, n, within::BIGINT] || flatten(list_transform([50, 95, 98, 99], lambda p: [(n-1)*p//100, (n-1)*p//100+1, (n-1)*p//100 + ((n-1)*p%100 > 0)::INT, (n-1)*p//100 + ((n-1)*p%100 > 0)::INT + 1]))) AS c FROM s),
k AS (SELECT c FROM c WHERE c > 0 AND c <= (SELECT max(n) FROM s)),
b AS (SELECT s.*, (SELECT count(*) FROM k WHERE k.c <= s.i) AS block FROM s)
SELECT block, min(i) AS start_index, max(i) AS end_index, {sql_near('min(distance/scale)', 9)} AS first, {sql_near('max(distance/scale)', 9)} AS last, {sql_near('sum(distance/scale)')} AS sum, {sql_near('sum(distance/scale*distance/scale)')} AS sum_squares, CASE WHEN max(i) < max(within) THEN 'within' ELSE 'outside' END AS threshold_class FROM b GROUP BY block""")
def certificate_blocks(spark, sf_dir):
    c = cloud.certificate(_distances(spark, sf_dir), 0.3)
    return c.select("block", "start_index", "end_index", near("first", 9).alias("first"), near("last", 9).alias("last"), near("sum").alias("sum"), near("sum_squares").alias("sum_squares"), "threshold_class")


@query("SELECT 0::BIGINT AS findings")
def certificate_verification(spark, sf_dir):
    return cloud.verify_certificate(cloud.certificate(_distances(spark, sf_dir), 0.3)).agg(F.count("*").alias("findings"))


M = [0.0, -1.0, 0.0, 10.0, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0]
INV = [0.0, 1.0, 0.0, 2.0, -1.0, 0.0, 0.0, 10.0, 0.0, 0.0, 1.0, -0.5, 0.0, 0.0, 0.0, 1.0]


@query(f"SELECT idx, {sql_near('10 - y')} AS px, {sql_near('x - 2')} AS py, {sql_near('z + 0.5')} AS pz, {sql_near('-y')} AS dx, {sql_near('x')} AS dy, {sql_near('z')} AS dz FROM (SELECT {XYZ} FROM embeddings)")
def affine_transform(spark, sf_dir):
    p, d = v.apply_point(M, xyz()), v.apply_direction(M, xyz())
    return points(spark, sf_dir).select("idx", *[near(x).alias(f"p{c}") for x, c in zip(p, "xyz", strict=True)], *[near(x).alias(f"d{c}") for x, c in zip(d, "xyz", strict=True)])


_BOX = f"SELECT idx AS id, x - 0.05 AS lo_x, x + 0.05 AS hi_x, y - 0.05 AS lo_y, y + 0.05 AS hi_y, z - 0.05 AS lo_z, z + 0.05 AS hi_z FROM (SELECT {XYZ} FROM embeddings)"


def _boxes(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("idx").alias("id"), *[x for c in "xyz" for x in ((F.col(c) - 0.05).alias(f"lo_{c}"), (F.col(c) + 0.05).alias(f"hi_{c}"))])


@query(f"SELECT id, {sql_near('10 - hi_y')} AS lo_x, {sql_near('10 - lo_y')} AS hi_x, {sql_near('lo_x - 2')} AS lo_y, {sql_near('hi_x - 2')} AS hi_y, {sql_near('lo_z + 0.5')} AS lo_z, {sql_near('hi_z + 0.5')} AS hi_z FROM ({_BOX})")
def bbox_corners(spark, sf_dir):
    lo, hi = v.apply_box(M, tuple(F.col(f"lo_{c}") for c in "xyz"), tuple(F.col(f"hi_{c}") for c in "xyz"))
    return _boxes(spark, sf_dir).select("id", *[near(x).alias(f"{s}_{c}") for s, b in (("lo", lo), ("hi", hi)) for x, c in zip(b, "xyz", strict=True)])


@query(f"SELECT id, {sql_near('sqrt(3 * 0.01)')} AS diagonal, {sql_near('(lo_x + hi_x) / 2')} AS center_x, {sql_near('hi_z - lo_z')} AS size_z FROM ({_BOX})")
def bbox_facts(spark, sf_dir):
    size = tuple(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz")
    return _boxes(spark, sf_dir).select("id", near(v.length(size)).alias("diagonal"), near((F.col("lo_x") + F.col("hi_x")) / 2).alias("center_x"), near(size[2]).alias("size_z"))


@query(f"SELECT 8 * count(*) AS corners, true AS ok, 1.0::DOUBLE AS determinant, {sql_near('10 - max(hi_y)')} AS min_x FROM ({_BOX})")
def transform_canary(spark, sf_dir):
    return cloud.transform_canary(_boxes(spark, sf_dir), M, INV).select("corners", "ok", "determinant", near("min_x").alias("min_x"))


_LAP = "(greatest(least(a.hi_{0}, b.hi_{0}) - greatest(a.lo_{0}, b.lo_{0}), 0))"


@query(f"WITH b AS ({_BOX}) SELECT a.id AS a, b.id AS b, {sql_near(' * '.join(_LAP.format(c) for c in 'xyz'))} AS volume FROM b a JOIN b ON a.id < b.id " + " ".join(f"AND a.lo_{c} - 1e-6 <= b.hi_{c} + 1e-6 AND b.lo_{c} - 1e-6 <= a.hi_{c} + 1e-6" for c in "xyz"))
def bbox_overlap_join(spark, sf_dir):
    return boxes.overlaps(_boxes(spark, sf_dir), 0.1).select("a", "b", near("volume").alias("volume"))


@query(f"""WITH p AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM (SELECT {XYZ} FROM embeddings)), g AS (SELECT *, greatest(abs(x), abs(y), abs(z)) / n AS magnitude FROM p)
SELECT idx, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 'x' WHEN abs(y) >= abs(z) THEN 'y' ELSE 'z' END AS axis, CASE WHEN (CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN x WHEN abs(y) >= abs(z) THEN y ELSE z END) >= 0 THEN 1 ELSE -1 END AS sign, {sql_near('magnitude')} AS magnitude, magnitude >= 0.985 AS aligned FROM g WHERE n > 0""")
def dominant_axis(spark, sf_dir):
    a = v.dominant_axis(xyz())
    return points(spark, sf_dir).select("idx", a.alias("a")).filter("a is not null").select("idx", "a.axis", "a.sign", near("a.magnitude").alias("magnitude"), "a.aligned")


_DOT = "(x*u + y*w + z*t) / (sqrt(x*x+y*y+z*z) * sqrt(u*u+w*w+t*t))"
_SIX = "vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS w, embedding[6]::DOUBLE AS t"


@query(f"SELECT idx, CASE WHEN c <= -0.985 THEN 'opposed' WHEN c >= 0.985 THEN 'parallel' WHEN abs(c) <= 1 - 0.985 THEN 'perpendicular' ELSE 'angled' END AS relation, {sql_near('degrees(acos(c))')} AS angle FROM (SELECT idx, {_DOT} AS c FROM (SELECT {_SIX} FROM embeddings))")
def vector_relationship(spark, sf_dir):
    q = tuple(F.col(c) for c in "uwt")
    return points(spark, sf_dir).select("idx", v.relationship(xyz(), q).alias("relation"), near(v.angle_degrees(xyz(), q)).alias("angle"))


@query(f"SELECT idx, {sql_near('sqrt((x-u)*(x-u)+(y-w)*(y-w)+(z-t)*(z-t))')} AS distance, {sql_near('y*t - z*w')} AS cross_x, {sql_near('x*u + y*w + z*t')} AS dot FROM (SELECT {_SIX} FROM embeddings)")
def vector_algebra(spark, sf_dir):
    q = tuple(F.col(c) for c in "uwt")
    return points(spark, sf_dir).select("idx", near(v.length(v.sub(xyz(), q))).alias("distance"), near(v.cross(xyz(), q)[0]).alias("cross_x"), near(v.dot(xyz(), q)).alias("dot"))


_EIG = "SELECT vec_id AS idx, embedding[1]::DOUBLE + 1 AS a, embedding[2]::DOUBLE + 1 AS b, embedding[3]::DOUBLE + 1 AS c, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS w, embedding[6]::DOUBLE AS t FROM embeddings"


@query(f"SELECT idx, {sql_near('a+b+c')} AS trace, {sql_near('a*a + b*b + c*c + 2*(u*u + w*w + t*t)')} AS squares, {sql_near('a*(b*c - t*t) - u*(u*c - t*w) + w*(u*t - b*w)')} AS determinant, true AS ordered FROM ({_EIG})")
def symmetric_eigenvalues(spark, sf_dir):
    """Sum, sum of squares and product settle the three values."""
    x, y, z = (F.col(c) + 1.0 for c in "xyz")
    e = v.symmetric_eigenvalues(x, y, z, F.col("u"), F.col("w"), F.col("t"))
    p = points(spark, sf_dir).select("idx", F.array(*e).alias("e")).select("idx", *[F.col("e")[i].alias(f"e{i}") for i in range(3)])
    e = [F.col(f"e{i}") for i in range(3)]
    return p.select("idx", near(e[0] + e[1] + e[2]).alias("trace"), near(e[0] ** 2 + e[1] ** 2 + e[2] ** 2).alias("squares"), near(e[0] * e[1] * e[2]).alias("determinant"), ((e[0] >= e[1] - 1e-9) & (e[1] >= e[2] - 1e-9)).alias("ordered"))


_RPY = ["cos(z)*cos(y)", "cos(z)*sin(y)*sin(x) - sin(z)*cos(x)", "cos(z)*sin(y)*cos(x) + sin(z)*sin(x)", "sin(z)*cos(y)", "sin(z)*sin(y)*sin(x) + cos(z)*cos(x)", "sin(z)*sin(y)*cos(x) - cos(z)*sin(x)", "-sin(y)", "cos(y)*sin(x)", "cos(y)*cos(x)"]


@query("SELECT idx, " + ", ".join(f"{sql_near(m)} AS m{i}" for i, m in enumerate(_RPY)) + ", " + ", ".join(f"{sql_near(m)} AS q{i}" for i, m in enumerate(_RPY)) + f", {sql_near('1.0')} AS q_norm FROM (SELECT {XYZ} FROM embeddings)")
def rpy_rotation(spark, sf_dir):
    """The matrix, and the one that the quaternion stands for."""
    m, q = v.rpy_matrix(*xyz()), v.rpy_quaternion(*xyz())
    p = points(spark, sf_dir).select("idx", F.array(*m).alias("m"), F.array(*q).alias("q")).select("idx", "m", *[F.col("q")[i].alias(c) for i, c in enumerate("abcd")])
    a, b, c, d = (F.col(n) for n in "abcd")
    turned = [1 - 2 * (b * b + c * c), 2 * (a * b - c * d), 2 * (a * c + b * d), 2 * (a * b + c * d), 1 - 2 * (a * a + c * c), 2 * (b * c - a * d), 2 * (a * c - b * d), 2 * (b * c + a * d), 1 - 2 * (a * a + b * b)]
    return p.select("idx", *[near(F.col("m")[i]).alias(f"m{i}") for i in range(9)], *[near(x).alias(f"q{i}") for i, x in enumerate(turned)], near(a * a + b * b + c * c + d * d).alias("q_norm"))


_SRGB = "CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END"


@query(f"SELECT p_partkey, {sql_near(_SRGB)} AS linear, {sql_near('c')} AS back FROM (SELECT p_partkey, (p_partkey % 256) / 255.0 AS c FROM part)")
def colour_round_trip(spark, sf_dir):
    text = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lit("0000"))
    lin = v.srgb_to_linear(v.hex_channel(text, 0))
    return table(spark, sf_dir, "part").select("p_partkey", near(lin).alias("linear"), near(v.linear_to_srgb(lin)).alias("back"))


@query(f"SELECT idx, {sql_near('abs((x*w - u*y) + (u*t - z*w) + (z*y - x*t)) / 2')} AS triangle, {sql_near('abs(x - u) * abs(y - w)')} AS box FROM (SELECT {_SIX} FROM embeddings)")
def polygon_area(spark, sf_dir):
    """A triangle and a rectangle for each row."""
    x, y, u, w, z, t = (F.col(c) for c in ("x", "y", "u", "w", "z", "t"))
    p = points(spark, sf_dir).select("idx", F.array(x, u, z).alias("tx"), F.array(y, w, t).alias("ty"), F.array(x, u, u, x).alias("bx"), F.array(y, y, w, w).alias("by"))
    return p.select("idx", near(v.polygon_area(F.col("tx"), F.col("ty"))).alias("triangle"), near(v.polygon_area(F.col("bx"), F.col("by"))).alias("box"))


# ---- fields ----------------------------------------------------------------

STEP = 12
_GRID = f"SELECT i, j, k, -1.5 + 3.0 * i / {STEP} AS x, -1.5 + 3.0 * j / {STEP} AS y, -1.5 + 3.0 * k / {STEP} AS z FROM range({STEP + 1}) a(i), range({STEP + 1}) b(j), range({STEP + 1}) c(k)"


def grid(spark: SparkSession, n: int = STEP, lo: float = -1.5, hi: float = 1.5) -> DataFrame:
    """The lattice of (n + 1) cubed points, from one range: no product of tables."""
    side = n + 1
    cells = spark.range(side**3).select(F.floor(F.col("id") / side**2).alias("i"), (F.floor(F.col("id") / side) % side).alias("j"), (F.col("id") % side).alias("k"))
    return cells.select("i", "j", "k", *[(lo + (hi - lo) * F.col(c) / n).alias(a) for c, a in zip("ijk", "xyz", strict=True)])


@query(f"SELECT i, j, k, {sql_near('sqrt(x*x+y*y+z*z) - 1')} AS sphere, {sql_near('sqrt(pow(sqrt(x*x+y*y)-1,2)+z*z)-0.25')} AS torus, {sql_near('greatest(sqrt(x*x+y*y)-0.5, -z-1, z-1)')} AS cylinder, {sql_near('abs(sqrt(x*x+y*y+z*z)-1) - 0.1')} AS shell FROM ({_GRID})")
def field_grid(spark, sf_dir):
    o, s = v.vec(0, 0, 0), fl.sphere(xyz(), v.vec(0, 0, 0), 1)
    return grid(spark).select("i", "j", "k", near(s).alias("sphere"), near(fl.torus(xyz(), 1, 0.25)).alias("torus"), near(fl.capped_cylinder(xyz(), v.vec(0, 0, -1), v.vec(0, 0, 1), 0.5)).alias("cylinder"), near(fl.shell(s, 0.2)).alias("shell"))


_AB = f"SELECT i, j, k, sqrt(x*x+y*y+z*z) - 1 AS a, x - 0.3 AS b FROM ({_GRID})"
_ROUND = "least(-0.2::DOUBLE, greatest(a, b)) + sqrt(pow(greatest(a+0.2,0),2) + pow(greatest(b+0.2,0),2))"


@query(f"""SELECT i, j, k, {sql_near('greatest(a,b)')} AS sharp, {sql_near(_ROUND)} AS round, {sql_near('greatest(a, b, (a+b+0.2)*sqrt(0.5))')} AS chamfer, {sql_near('0.1*ln(exp(a/0.1)+exp(b/0.1))')} AS exp,
{sql_near('least(-0.2::DOUBLE, greatest(a, b)) + pow(pow(greatest(a+0.2,0),3) + pow(greatest(b+0.2,0),3), 1/3.0)')} AS norm, {sql_near('least(a,b)')} AS either FROM ({_AB})""")
def csg_blends(spark, sf_dir):
    a, b = fl.sphere(xyz(), v.vec(0, 0, 0), 1), F.col("x") - 0.3
    return grid(spark).select("i", "j", "k", near(F.greatest(a, b)).alias("sharp"), near(fl.both_round(a, b, 0.2)).alias("round"), near(fl.both_chamfer(a, b, 0.2)).alias("chamfer"), near(fl.both_exp(a, b, 0.2)).alias("exp"), near(fl.both_norm(a, b, 0.2, 3)).alias("norm"), near(F.least(a, b)).alias("either"))


_T = "2*pi()*"


@query(f"""SELECT i, j, k, {sql_near(f'(sin({_T}x)*cos({_T}y)+sin({_T}y)*cos({_T}z)+sin({_T}z)*cos({_T}x))*3/18', 5)} AS gyroid, {sql_near(f'-(cos({_T}x)+cos({_T}y)+cos({_T}z))*3/36', 5)} AS schwarz,
{sql_near(f'(2*(cos({_T}x)*cos({_T}y)+cos({_T}y)*cos({_T}z)+cos({_T}z)*cos({_T}x)) - (cos(4*pi()*x)+cos(4*pi()*y)+cos(4*pi()*z)))*3/48', 5)} AS iwp FROM ({_GRID})""")
def tpms(spark, sf_dir):
    one = (1.0, 1.0, 1.0)
    return grid(spark).select("i", "j", "k", near(fl.gyroid(xyz(), one), 5).alias("gyroid"), near(fl.schwarz(xyz(), one), 5).alias("schwarz"), near(fl.iwp(xyz(), one), 5).alias("iwp"))


def _cyclic(term: str) -> str:
    """Sum of a term over the three cyclic choices of axes I, J, K."""
    return "(" + " + ".join(term.replace("I", a).replace("J", b).replace("K", c) for a, b, c in ("xyz", "yzx", "zxy")) + ")"


_tri = lambda c, p=1.0: f"({p} * 0.5 - abs(({c}) + {p} * 0.5 - {p} * floor((({c}) + {p} * 0.5) / {p}) - {p} * 0.5))"
_mid = lambda c, p: f"(({c}) + {p} * 0.5 - {p} * floor((({c}) + {p} * 0.5) / {p}) - {p} * 0.5)"
_SQUARE = f"least({_tri('x')}, {_tri('y', 0.8)})"
_PERIODIC = {
    "diamond": f"(sx*sy*sz + {_cyclic('sI*cJ*cK')}) * 3 / (12 * sqrt(8.0))", "lidinoid": f"({_cyclic('sK*cJ*s2I')} - {_cyclic('c2I*c2J')}) * 3 / 72", "neovius": "(-(cx + cy + cz) - 4 / 3.0 * cx * cy * cz) * 3 / 52",
    "split_p": f"{_cyclic('-1.1*s2I*cJ*sK - 0.2*s2I*c2I - 0.4*c2I')} * 3 / 36", "cubic": f"least({_tri('x')}, {_tri('y')}, {_tri('z')})", "square": _SQUARE,
    "reinforced": f"least({_SQUARE}, abs({_mid('x', 1.0)} * cos(pi() / 4) + {_mid('y', 0.8)} * sin(pi() / 4)))", "diagonal": f"least(abs({_mid('x', 1.8)} * 0.8 + {_mid('y', 1.8)}), abs({_mid('x', 1.8)} * 0.8 - {_mid('y', 1.8)})) / sqrt(1.64)",
    "octet": f"least({_SQUARE}, {_tri('x - 0.5')}, {_tri('y - 0.4', 0.8)}, {_tri('(x + y) / sqrt(2.0) - sqrt(1.64) / 4', '(sqrt(1.64) / 2)')}, {_tri('(x - y) / sqrt(2.0) - sqrt(1.64) / 4', '(sqrt(1.64) / 2)')})",
}
_WAVES = ", ".join(f"sin({m} * pi() * {c}) AS s{n}{c}, cos({m} * pi() * {c}) AS c{n}{c}" for c in "xyz" for m, n in ((2, ""), (4, "2")))


@query(f"SELECT i, j, k, {', '.join(f'{sql_near(q)} AS {n}' for n, q in _PERIODIC.items())} FROM (SELECT *, {_WAVES} FROM ({_GRID}))")
def periodic_fields(spark, sf_dir):
    """The other surfaces and lattices."""
    one, two = (1.0, 1.0, 1.0), (1.0, 0.8)
    made = {"diamond": fl.diamond(xyz(), one), "lidinoid": fl.lidinoid(xyz(), one), "neovius": fl.neovius(xyz(), one), "split_p": fl.split_p(xyz(), one), "cubic": fl.cubic_grid(xyz(), one), "square": fl.square_honeycomb(xyz(), two), "reinforced": fl.reinforced_honeycomb(xyz(), two), "diagonal": fl.diagonal_honeycomb(xyz(), two), "octet": fl.octet_honeycomb(xyz(), two)}
    return grid(spark).select("i", "j", "k", *[near(c).alias(n) for n, c in made.items()])


_RHO, _ON = "sqrt(x*x + y*y)", "greatest(-1, least(1, z))"
_PRIMITIVES = {
    "box": "sqrt(pow(greatest(abs(x-0.1)-0.5,0),2) + pow(greatest(abs(y)-1,0),2) + pow(greatest(abs(z)-0.25,0),2)) + least(greatest(abs(x-0.1)-0.5, abs(y)-1, abs(z)-0.25), 0)", "plane": "(x - 1 + y + z) / sqrt(3.0)",
    "segment": f"sqrt(x*x + y*y + pow(z - {_ON}, 2))", "axis": "sqrt(pow(x - 0.5, 2) + y*y)", "cylinder": "sqrt(pow(x - 0.5, 2) + y*y) - 0.3", "capsule": f"sqrt(x*x + y*y + pow(z - {_ON}, 2)) - 0.2", "cone_capsule": f"sqrt(x*x + y*y + pow(z - {_ON}, 2)) - (0.8 - 0.25 * ({_ON} + 1))",
    "cone": f"{_RHO} - (1 - z) * tan(0.5)", "capped_cone": f"greatest({_RHO} - (1 - z) * 0.25 - 0.3, -z - 1, z - 1)", "line2": "sqrt(pow(x - greatest(-1, least(1, x)), 2) + y*y)", "plane2": "(x + y - 0.5) / sqrt(2.0)",
    "turned_x": "0.2 + (x - 0.2) * cos(0.5) - y * sin(0.5)", "turned_y": "(x - 0.2) * sin(0.5) + y * cos(0.5)", "unrolled": "atan2(y, x) * 3 / (2 * pi())",
}


@query(f"SELECT i, j, k, {', '.join(f'{sql_near(q)} AS {n}' for n, q in _PRIMITIVES.items())} FROM ({_GRID})")
def field_primitives(spark, sf_dir):
    p, lo, hi, up = xyz(), v.vec(0, 0, -1), v.vec(0, 0, 1), v.vec(0, 0, 2)
    side, turned = v.vec(0.5, 0, 0), fl.rotate_axis(p, v.vec(0.2, 0, 0), up, 0.5)
    made = {
        "box": fl.box(p, v.vec(1, 2, 0.5), v.vec(0.1, 0, 0)), "plane": fl.plane(p, v.vec(1, 0, 0), v.vec(2, 2, 2)), "segment": fl.segment(p, lo, hi), "axis": fl.axis(p, side, up), "cylinder": fl.cylinder(p, side, up, 0.3), "capsule": fl.capsule(p, lo, hi, 0.2),
        "cone_capsule": fl.cone_capsule(p, lo, hi, 0.8, 0.3), "cone": fl.cone(p, hi, v.vec(0, 0, -3), 0.5), "capped_cone": fl.capped_cone(p, lo, hi, 0.8, 0.3), "line2": fl.segment(p[:2], v.vec(-1, 0), v.vec(1, 0)), "plane2": fl.plane(p[:2], v.vec(0.5, 0), v.vec(1, 1)),
        "turned_x": turned[0], "turned_y": turned[1], "unrolled": fl.remap_cylindrical(p, 3)[1],
    }
    return grid(spark).select("i", "j", "k", *[near(c).alias(n) for n, c in made.items()])


@query(f"""SELECT i, j, k, {sql_near('0.25 - abs((x + 0.5 - floor(x + 0.5)) - 0.5)')} AS wave, {sql_near('x + 0.5 - floor(x + 0.5) - 0.5')} AS centered, {sql_near('least(greatest((x+1)*2-1, -1), 1)')} AS ramp, {sql_near('least(greatest(x,0),1)*least(greatest(x,0),1)*(3-2*least(greatest(x,0),1))')} AS smooth FROM ({_GRID})""")
def field_helpers(spark, sf_dir):
    x = F.col("x")
    return grid(spark).select("i", "j", "k", near(fl.wave_even(x, 1)).alias("wave"), near(fl.repeat_centered(x, 1)).alias("centered"), near(fl.ramp(x, -1, 0, -1, 1)).alias("ramp"), near(fl.smoothstep(0, 1, x)).alias("smooth"))
