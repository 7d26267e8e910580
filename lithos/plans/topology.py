"""Queries over topology tables: each supplier lends a cube of edge 1 + key modulo 3, each customer an occurrence of a cube."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec as v
from ..operators import topology as tp
from ..registry import query, table
from .clouds import near, sql_near

FIELDS = {"kind": "string", "row": "int", "id": "string", "ordinal": "int", "type": "string", **{f"{g}{c}": "double" for g in "cnlhd" for c in "xyz"}, **{f"{g}_{x}": "int" for g in ("face", "edge", "vertex") for x in ("start", "count")}}


def _cube() -> tuple[list[dict], list[dict]]:
    """Entities and adjacency of the unit cube: corners by the bits of their number, edges by axis, faces by axis and side."""
    corner = lambda b: [float(b >> i & 1) for i in range(3)]
    ends = [(b, b | 1 << a) for a in range(3) for b in range(8) if not b >> a & 1]
    sides = [(a, s) for a in range(3) for s in (0, 1)]
    on = [[e for e, pair in enumerate(ends) if all(b >> a & 1 == s for b in pair)] for a, s in sides]
    rows, flat = [], []

    def add(kind: str, row: int, points: list[list[float]], normal: list[float] | None = None, direction: list[float] | None = None, **more: object) -> None:
        lo, hi = [min(p) for p in zip(*points, strict=True)], [max(p) for p in zip(*points, strict=True)]
        groups = {"c": [(a + b) / 2 for a, b in zip(lo, hi, strict=True)], "n": normal, "l": lo, "h": hi, "d": direction}
        values = {f"{g}{c}": None if p is None else p[i] for g, p in groups.items() for i, c in enumerate("xyz")}
        rows.append(dict.fromkeys(FIELDS) | {"kind": kind, "row": row, "id": f"o1.{kind[0]}{row + 1}", "ordinal": row + 1} | values | more)

    every = [corner(b) for b in range(8)]
    add("occurrence", 0, every, id="o1", ordinal=None)
    add("shape", 0, every, face_start=0, face_count=6, edge_start=0, edge_count=12)
    for f, (a, s) in enumerate(sides):
        add("face", f, [corner(b) for b in range(8) if b >> a & 1 == s], [float((2 * s - 1) * (i == a)) for i in range(3)], type="plane", edge_start=4 * f, edge_count=4)
    for e, pair in enumerate(ends):
        add("edge", e, [corner(b) for b in pair], direction=[float(i == e // 4) for i in range(3)], type="line", face_start=2 * e, face_count=2, vertex_start=2 * e, vertex_count=2)
    for b in range(8):
        add("vertex", b, [corner(b)], edge_start=3 * b, edge_count=3, **({"ordinal": None} if b % 2 else {}))
    lists = {"faceEdge": on, "edgeFace": [[f for f, es in enumerate(on) if e in es] for e in range(12)], "edgeVertex": ends, "vertexEdge": [[e for e, pair in enumerate(ends) if b in pair] for b in range(8)]}
    for name, parts in lists.items():
        flat += [{"relation": name, "pos": i, "target": t} for i, t in enumerate(itertools.chain(*parts))]
    return rows, flat


ROWS, FLAT = _cube()
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}


def _unnest(rows: list[dict], fields: dict[str, str]) -> str:
    shape = json.dumps([{k: _TYPES[t] for k, t in fields.items()}])
    return f"(SELECT unnest(from_json('{json.dumps(rows)}', '{shape}'), max_depth := 2))"


_FLAT_FIELDS = {"relation": "string", "pos": "int", "target": "int"}
#: The rows of all cubes; the last face of every fourth has no name.
SQL_ROWS = f"(SELECT s_suppkey AS comp, 1.0 + s_suppkey % 3 AS len, * REPLACE (CASE WHEN s_suppkey % 4 = 0 AND kind = 'face' AND row = 5 THEN NULL ELSE ordinal END AS ordinal, CASE WHEN s_suppkey % 4 = 0 AND kind = 'face' AND row = 5 THEN '' ELSE id END AS id) FROM (SELECT s_suppkey FROM supplier) s, {_unnest(ROWS, FIELDS)} t)"
SQL_FLAT = f"(SELECT s_suppkey AS comp, t.* FROM supplier, {_unnest(FLAT, _FLAT_FIELDS)} t)"
TURN = [0.0, -1.0, 0.0, None, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def _literal(rows: list[dict], fields: dict[str, str]):  # noqa: ANN202
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{','.join(f'`{k}`:{t}' for k, t in fields.items())}>>")


def entities(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("comp"), (1.0 + F.col("s_suppkey") % 3).alias("len"), F.explode(_literal(ROWS, FIELDS)).alias("t")).select("comp", "len", "t.*")
    nameless = (F.col("comp") % 4 == 0) & (F.col("kind") == "face") & (F.col("row") == 5)
    at = lambda g: F.when(F.col(f"{g}x").isNotNull(), F.array(*[F.col(f"{g}{c}") * F.col("len") for c in "xyz"]))
    unit = lambda g: F.when(F.col(f"{g}x").isNotNull(), F.array(*[F.col(f"{g}{c}") for c in "xyz"]))
    none = F.lit(None).cast("array<double>")
    params = F.when(F.col("kind") == "edge", F.struct(at("l").alias("origin"), none.alias("center"), none.alias("axis"), unit("d").alias("direction"), F.lit(None).cast("double").alias("radius")))
    return rows.select(
        "comp", "kind", "row", F.when(nameless, "").otherwise(F.col("id")).alias("id"), F.when(~nameless, F.col("ordinal")).alias("ordinal"),
        F.when(F.col("kind").isin("face", "edge"), "o1.s1").alias("shape"), "type", F.when(F.col("kind") == "face", F.col("len") * F.col("len")).alias("area"), F.when(F.col("kind") == "edge", F.col("len")).alias("length"),
        at("c").alias("center"), unit("n").alias("normal"), at("l").alias("lo"), at("h").alias("hi"), params.alias("params"), *[f"{g}_{x}" for g in ("face", "edge", "vertex") for x in ("start", "count")],
    )


def relations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("comp"), F.explode(_literal(FLAT, _FLAT_FIELDS)).alias("t")).select("comp", "t.*")


def occurrences(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    turn = F.array(*[k.cast("double") if x is None else F.lit(x) for x in TURN])
    return table(spark, sf_dir, "customer").select(k.alias("seq"), F.concat(F.lit("o1."), k).alias("occ"), (k % 10).alias("comp"), turn.alias("transform"))


@query("SELECT s_suppkey AS comp, i::BIGINT AS row, 'o1.f' || (i + 1) AS id, (i + 1)::BIGINT AS ordinal, (1.5 * s_suppkey)::DOUBLE AS area FROM supplier, range(3) r(i) WHERE i <> 1")
def manifest_rows(spark, sf_dir):
    """Tables of JSON manifests: the second row is no list, the first has a value too many, the last one too few."""
    k = F.col("s_suppkey")
    doc = F.concat(F.lit('{"tables":{"faceColumns":["id","ordinal","area","more"]},"faces":[["o1.f1",1,'), F.round(k * 1.5, 6), F.lit(',null,7],{"id":"x"},["o1.f3",3,'), F.round(k * 1.5, 6), F.lit("]]}"))
    rows = tp.table_rows(table(spark, sf_dir, "supplier").select(k.alias("comp"), doc.alias("manifest")), "faces", "faceColumns")
    return rows.select("comp", F.col("row").cast("long").alias("row"), F.col("values.id").alias("id"), F.col("values.ordinal").cast("long").alias("ordinal"), F.col("values.area").cast("double").alias("area"))


@query(f"""WITH e AS (SELECT * FROM {SQL_ROWS} WHERE comp = 1), r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'f' || (1 + p_partkey % 8) WHEN 1 THEN 'o1.e' || (1 + p_partkey % 15) WHEN 2 THEN 'o1' WHEN 3 THEN 's' || (1 + p_partkey % 2) ELSE 'o1.v' || (1 + p_partkey % 9) END AS ref FROM part)
SELECT p_partkey, ref, CASE WHEN regexp_full_match(ref, '[sfev][0-9]+') THEN 'o1.' || ref ELSE ref END AS selector, kind, row FROM r LEFT JOIN e ON e.id = CASE WHEN regexp_full_match(ref, '[sfev][0-9]+') THEN 'o1.' || ref ELSE ref END""")
def selector_lookup(spark, sf_dir):
    k = F.col("p_partkey")
    ref = F.when(k % 5 == 0, F.concat(F.lit("f"), 1 + k % 8)).when(k % 5 == 1, F.concat(F.lit("o1.e"), 1 + k % 15)).when(k % 5 == 2, "o1").when(k % 5 == 3, F.concat(F.lit("s"), 1 + k % 2)).otherwise(F.concat(F.lit("o1.v"), 1 + k % 9))
    return tp.lookup(table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref")), entities(spark, sf_dir).filter("comp = 1"), single=F.lit("o1"))


def _adjacent(spark, sf_dir, relation: str) -> DataFrame:
    holder, target = tp.RELATIONS[relation]
    e, flat = entities(spark, sf_dir), relations(spark, sf_dir).filter(F.col("relation") == relation)
    return tp.adjacent(e.filter(F.col("kind") == holder).withColumn("id", F.concat(F.col("kind"), F.lit(":"), "row")), flat, e.filter(F.col("kind") == target), f"{target}_start", f"{target}_count", ("comp",))


@query(f"""SELECT h.comp, h.kind || ':' || h.row AS id, f.pos AS at, t.id AS target, relation FROM {SQL_ROWS} h JOIN {SQL_FLAT} f USING (comp) JOIN {SQL_ROWS} t USING (comp)
WHERE f.target = t.row AND ((relation = 'faceEdge' AND h.kind = 'face' AND t.kind = 'edge' AND pos BETWEEN h.edge_start AND h.edge_start + h.edge_count - 1) OR (relation = 'edgeFace' AND h.kind = 'edge' AND t.kind = 'face' AND pos BETWEEN h.face_start AND h.face_start + h.face_count - 1)
OR (relation = 'edgeVertex' AND h.kind = 'edge' AND t.kind = 'vertex' AND pos BETWEEN h.vertex_start AND h.vertex_start + h.vertex_count - 1) OR (relation = 'vertexEdge' AND h.kind = 'vertex' AND t.kind = 'edge' AND pos BETWEEN h.edge_start AND h.edge_start + h.edge_count - 1))""")
def csr_adjacency(spark, sf_dir):
    out = None
    for r in tp.RELATIONS:
        part = _adjacent(spark, sf_dir, r).withColumn("relation", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH e AS (SELECT * FROM {SQL_ROWS}), a AS (SELECT v.comp, v.row AS vertex, x.pos AS p, x.target AS edge FROM e v JOIN {SQL_FLAT} x ON x.comp = v.comp AND x.relation = 'vertexEdge' AND x.pos BETWEEN v.edge_start AND v.edge_start + v.edge_count - 1 WHERE v.kind = 'vertex'),
b AS (SELECT a.comp, vertex, f.id, min(p * 1000 + y.pos) AS seen FROM a JOIN {SQL_FLAT} y ON y.comp = a.comp AND y.relation = 'edgeFace' AND y.pos // 2 = a.edge JOIN e f ON f.comp = a.comp AND f.kind = 'face' AND f.row = y.target GROUP BY ALL)
SELECT comp, 'vertex:' || vertex AS id, string_agg(id, ',' ORDER BY seen) AS faces FROM b GROUP BY ALL""")
def two_hop(spark, sf_dir):
    """Faces around each vertex, in the order first seen."""
    first = _adjacent(spark, sf_dir, "vertexEdge").withColumn("target", F.regexp_extract("target", "[0-9]+$", 0).cast("int") - 1)
    second = _adjacent(spark, sf_dir, "edgeFace").withColumn("id", F.substring_index("id", ":", -1).cast("int"))
    return tp.two_hop(first, second, ("comp",)).select("comp", "id", F.array_join("targets", ",").alias("faces"))


_BASED = """(SELECT *, seq AS s, coalesce(sum(nf) OVER w, 0)::BIGINT AS bf, 12 * (seq_no - 1) AS be, 8 * (seq_no - 1) AS bv, (seq_no - 1) AS bs, 24 * (seq_no - 1) AS br FROM
(SELECT c_custkey AS seq, 'o1.' || c_custkey AS occ, c_custkey % 10 AS comp, 6 - ((c_custkey % 10) % 4 = 0)::INT AS nf, row_number() OVER (ORDER BY c_custkey) AS seq_no FROM customer) WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _merged(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tp.merge_assembly(occurrences(spark, sf_dir), entities(spark, sf_dir), relations(spark, sf_dir))


@query(f"""SELECT kind, occ || '.' || kind[1] || (row + 1) AS id, (CASE kind WHEN 'face' THEN bf WHEN 'edge' THEN be WHEN 'vertex' THEN bv ELSE bs END + row)::BIGINT AS row, CASE WHEN kind IN ('face', 'edge') THEN occ || '.s1' END AS shape,
CASE kind WHEN 'shape' THEN bf + face_start WHEN 'edge' THEN br + face_start END::BIGINT AS face_start, CASE kind WHEN 'shape' THEN be + edge_start WHEN 'face' THEN br + edge_start WHEN 'vertex' THEN br + edge_start END::BIGINT AS edge_start, CASE kind WHEN 'edge' THEN br + vertex_start END::BIGINT AS vertex_start,
{sql_near('seq - cy * len')} AS x, {sql_near('2 + cx * len')} AS y, {sql_near('cz * len')} AS z, {sql_near('-ny')} AS nx, {sql_near('seq - hy * len')} AS lo_x, {sql_near('2 + hx * len')} AS hi_y, {sql_near("CASE WHEN kind = 'edge' THEN 2 + lx * len END")} AS origin_y, true AS first FROM {_BASED} JOIN {SQL_ROWS} USING (comp) WHERE kind <> 'occurrence' AND id <> ''""")
def assembly_merge(spark, sf_dir):
    m = _merged(spark, sf_dir)[0]
    at = lambda c, i: near(F.get(c, F.lit(i)))
    return m.select(
        "kind", "id", F.col("row").cast("long").alias("row"), "shape", *[F.col(f"{k}_start").cast("long").alias(f"{k}_start") for k in ("face", "edge", "vertex")],
        at("center", 0).alias("x"), at("center", 1).alias("y"), at("center", 2).alias("z"), at("normal", 0).alias("nx"), at("lo", 0).alias("lo_x"), at("hi", 1).alias("hi_y"), at("params.origin", 1).alias("origin_y"), "first",
    )


@query(f"SELECT occ, relation, (br + pos)::BIGINT AS pos, (CASE relation WHEN 'edgeFace' THEN bf WHEN 'edgeVertex' THEN bv ELSE be END + target)::BIGINT AS target FROM {_BASED} JOIN {SQL_FLAT} USING (comp)")
def assembly_relations(spark, sf_dir):
    return _merged(spark, sf_dir)[1].select("occ", "relation", F.col("pos").cast("long").alias("pos"), F.col("target").cast("long").alias("target"))


@query(f"SELECT seq, occ, bs::BIGINT AS shape_start, 1::BIGINT AS shape_count, bf::BIGINT AS face_start, 6::BIGINT AS face_count, be::BIGINT AS edge_start, 12::BIGINT AS edge_count FROM {_BASED}")
def assembly_ranges(spark, sf_dir):
    r = _merged(spark, sf_dir)[2]
    return r.select("seq", "occ", *[F.col(f"{k}_{x}").cast("long").alias(f"{k}_{x}") for k in ("shape", "face", "edge") for x in ("start", "count")])


@query("SELECT c_custkey AS seq, c_custkey::DOUBLE AS tx, 2.0::DOUBLE AS ty, 1.0::DOUBLE AS x_y, -1.0::DOUBLE AS y_x, 0.0::DOUBLE AS z_x, 1.0::DOUBLE AS z_z FROM customer")
def frame_facts(spark, sf_dir):
    """Axes of a frame whose columns are scaled by the key: their lengths are one again."""
    k = F.col("seq")
    scaled = occurrences(spark, sf_dir).withColumn("transform", F.transform("transform", lambda x, i: F.when(i % 4 < 3, x * (k + 1)).otherwise(x)))
    f = scaled.select("seq", tp.frame_facts().alias("f"))
    at = lambda c, i: near(F.get(c, F.lit(i)))
    return f.select("seq", at("f.translation", 0).alias("tx"), at("f.translation", 1).alias("ty"), at("f.x", 1).alias("x_y"), at("f.y", 0).alias("y_x"), at("f.z", 0).alias("z_x"), at("f.z", 2).alias("z_z"))


@query(f"""SELECT comp, kind, row, {sql_near("CASE WHEN kind = 'edge' THEN lx * len ELSE cx * len END")} AS point_x, CASE WHEN kind = 'face' THEN substr('xyz', row // 2 + 1, 1) WHEN kind = 'edge' THEN substr('xyz', row // 4 + 1, 1) END AS axis, CASE WHEN kind = 'face' THEN 2 * (row % 2) - 1 WHEN kind = 'edge' THEN 1 END AS sign,
{sql_near("CASE WHEN kind = 'face' THEN (row % 2) * len WHEN kind = 'edge' THEN len / 2 END")} AS coordinate, {sql_near("CASE WHEN kind = 'face' THEN (row % 2) * len END")} AS plane_offset FROM {SQL_ROWS}""")
def positioning_facts(spark, sf_dir):
    f = tp.positioning_facts(entities(spark, sf_dir)).select("comp", "kind", "row", "facts")
    return f.select("comp", "kind", "row", near(F.get("facts.point", F.lit(0))).alias("point_x"), "facts.axis", "facts.alignment.sign", near("facts.coordinate").alias("coordinate"), near("facts.plane_offset").alias("plane_offset"))


@query(f"SELECT comp, kind, row, {sql_near('len * sqrt((hx-lx)*(hx-lx) + (hy-ly)*(hy-ly) + (hz-lz)*(hz-lz))')} AS diag, CASE WHEN kind = 'face' THEN substr('xyz', row // 2 + 1, 1) END AS normal_axis, CASE WHEN kind = 'edge' THEN substr('xyz', row // 4 + 1, 1) END AS direction_axis, {sql_near('''CASE WHEN kind = 'face' THEN (row % 2) * len END''')} AS plane_coordinate FROM {SQL_ROWS}")
def geometry_facts(spark, sf_dir):
    g = tp.geometry_facts(entities(spark, sf_dir))
    return g.select("comp", "kind", "row", near("diag").alias("diag"), F.col("normal_axis.axis").alias("normal_axis"), F.col("direction_axis.axis").alias("direction_axis"), near("plane_coordinate").alias("plane_coordinate"))


@query("SELECT s_suppkey AS comp, 5 AS row FROM supplier WHERE s_suppkey % 3 = 1")
def planar_faces(spark, sf_dir):
    return tp.planar_faces(entities(spark, sf_dir), (0.0, 0.0, 1.0), 2.0).select("comp", "row")


@query("SELECT 'o1.' || c_custkey AS id FROM customer WHERE c_custkey IN (1, 12)")
def subtree_selection(spark, sf_dir):
    """A reference takes what is below it, not what merely begins like it."""
    return tp.selected(occurrences(spark, sf_dir).select(F.col("occ").alias("id")), ["o1.1", "o1.12.3", "o1.12"])


@query(f"""WITH f AS (SELECT *, CASE kind WHEN 'face' THEN row // 2 END AS a FROM {SQL_ROWS} WHERE kind = 'face') SELECT substr('xyz', a + 1, 1) AS axis, {sql_near('(row % 2) * len')} AS coordinate, count(*) AS faces, {sql_near('sum(len * len)')} AS area, {sql_near('min(lx * len)')} AS lo_x, {sql_near('max(hz * len)')} AS hi_z, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, CASE WHEN (row % 2) * len > 0 THEN 1 ELSE -1 END AS sign
FROM f GROUP BY a, (row % 2) * len HAVING sum(len * len) >= 0.05 * (SELECT sum(len * len) FROM f) ORDER BY sum(len * len) DESC, 1, 2 LIMIT 8""")
def plane_groups(spark, sf_dir):
    """The eight largest groups of coplanar faces, a report."""
    g = tp.plane_groups(entities(spark, sf_dir), 1e-3, 0.05, 8)
    return g.select("axis", near("coordinate").alias("coordinate"), "faces", near("area").alias("area"), near(F.get("lo", F.lit(0))).alias("lo_x"), near(F.get("hi", F.lit(2))).alias("hi_z"), F.array_join("ids", ",").alias("ids"), "sign")


@query("""SELECT class, count(*) AS edges FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'degenerate' WHEN l_partkey % 7 = 1 AND l_linenumber % 2 = 0 THEN 'seam' WHEN l_partkey % 7 = 0 THEN 'unknown' WHEN l_partkey % 7 = 1 THEN 'boundary' WHEN l_partkey % 7 <> 2 THEN 'non-manifold' WHEN l_suppkey % 90 >= 30 THEN 'hard' ELSE 'tangent' END AS class FROM lineitem) GROUP BY ALL""")
def edge_classes(spark, sf_dir):
    k = F.col("l_partkey") % 7
    cls = tp.edge_class(F.when(k > 0, k), F.col("l_linenumber") % 2 == 0, F.when(F.col("l_linenumber") == 7, 0.0).otherwise(1.0), F.col("l_suppkey") % 90)
    return table(spark, sf_dir, "lineitem").groupBy(cls.alias("class")).agg(F.count("*").alias("edges"))


@query(f"SELECT count(*) FILTER (kind = 'occurrence') AS n_occurrence, count(*) FILTER (kind = 'shape') AS n_shape, count(*) FILTER (kind = 'face') AS n_face, count(*) FILTER (kind = 'edge') AS n_edge, count(*) FILTER (kind = 'vertex') AS n_vertex, (SELECT count(*) FROM customer) AS n_leaf FROM (SELECT kind FROM {SQL_ROWS} WHERE comp = 1 UNION ALL SELECT 'occurrence' FROM customer)")
def entry_summary(spark, sf_dir):
    one = entities(spark, sf_dir).filter("comp = 1").select("id", "kind")
    return tp.entry_summary(one.unionByName(occurrences(spark, sf_dir).select(F.col("occ").alias("id"), F.lit("occurrence").alias("kind"))))


@query(f"""WITH a AS (SELECT kind, count(*) AS n FROM {SQL_ROWS} WHERE comp = 1 GROUP BY kind), b AS (SELECT kind, count(*) AS n FROM {SQL_ROWS} WHERE comp = 4 GROUP BY kind)
SELECT kind, a.n AS n_left, b.n AS n_right, b.n - a.n AS delta, kind <> 'face' AS same_ids, true AS same_geometry, {sql_near('0')} AS center_moved, {sql_near('0')} AS diag_delta FROM a JOIN b USING (kind)
UNION ALL SELECT 'side', 3, 0, -3, false, false, NULL, NULL""")
def manifest_diff(spark, sf_dir):
    """Cubes 1 and 4 are of one size, but the last face of the latter has no name."""
    e = entities(spark, sf_dir)
    left = e.filter("comp = 1")
    d = tp.manifest_diff(left.unionByName(left.filter("kind = 'face' and row < 3").withColumn("kind", F.lit("side"))), e.filter("comp = 4"))
    return d.select("kind", "n_left", "n_right", "delta", "same_ids", "same_geometry", near("center_moved").alias("center_moved"), near("diag_delta").alias("diag_delta"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Each cube's second and fifth face against its other faces."""
    f = tp.positioning_facts(entities(spark, sf_dir).filter("kind = 'face'")).select("comp", "row", "facts")
    a = f.filter("row in (1, 4)").select("comp", F.col("row").alias("a"), F.col("facts").alias("left"))
    return a.join(f.select("comp", F.col("row").alias("b"), F.col("facts").alias("right")), "comp").filter("a <> b")


_PAIRS = f"(SELECT x.comp, x.row AS a, y.row AS b, x.len, x.row // 2 AS ax, y.row // 2 AS bx, x.cx AS x1, x.cy AS y1, x.cz AS z1, y.cx AS x2, y.cy AS y2, y.cz AS z2 FROM {SQL_ROWS} x JOIN {SQL_ROWS} y USING (comp) WHERE x.kind = 'face' AND y.kind = 'face' AND x.row IN (1, 4) AND x.row <> y.row)"
_GAP = "len * CASE ax WHEN 0 THEN x2 - x1 WHEN 1 THEN y2 - y1 ELSE z2 - z1 END"


@query(f"SELECT comp, a, b, substr('xyz', ax + 1, 1) AS axis, {sql_near(_GAP)} AS signed, {sql_near(f'abs({_GAP})')} AS absolute, {sql_near('len * sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1) + (z2-z1)*(z2-z1))')} AS straight, CASE WHEN ax = bx THEN 'opposed' ELSE 'perpendicular' END AS relation FROM {_PAIRS}")
def measure_pairs(spark, sf_dir):
    m = tp.measure(_pairs(spark, sf_dir))
    return m.select("comp", "a", "b", "axis", near("signed").alias("signed"), near("absolute").alias("absolute"), near("straight").alias("straight"), "relation")


@query(f"SELECT comp, a, b, {sql_near(f'CASE ax WHEN 0 THEN {_GAP} + 0.25 ELSE 0 END')} AS flush_x, {sql_near(f'CASE ax WHEN 2 THEN {_GAP} + 0.25 ELSE 0 END')} AS flush_z, {sql_near('len * (x2 - x1)')} AS center_x FROM {_PAIRS}")
def align_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    flush = tp.align(p, "flush", 0.25).select("comp", "a", "b", *[near(F.get("translation", F.lit(i))).alias(f"flush_{c}") for i, c in ((0, "x"), (2, "z"))])
    return flush.join(tp.align(p, "center").select("comp", "a", "b", near(F.get("translation", F.lit(0))).alias("center_x")), ["comp", "a", "b"])


@query("SELECT 'o1.' || c_custkey || '.f' || (c_custkey % 6) AS ref, CASE WHEN c_custkey % 2 = 0 THEN 'o1.' || c_custkey ELSE 'o1' END AS node FROM customer")
def assign_by_prefix(spark, sf_dir):
    occ = occurrences(spark, sf_dir)
    nodes = occ.filter("seq % 2 = 0").select(F.col("occ").alias("node")).unionByName(spark.createDataFrame([("o1",)], "node string"))
    return tp.assign_by_prefix(nodes, occ.select(F.concat("occ", F.lit(".f"), F.col("seq") % 6).alias("ref")))
