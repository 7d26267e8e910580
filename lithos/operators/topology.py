"""Topology tables: manifests, selectors, adjacency, assemblies, facts, measures.

Entities are rows ``(comp, kind, row, id, ordinal, shape, type, area, length,
center, normal, lo, hi, params)``: kind is occurrence, shape, face, edge or
vertex; row is the place in its table; points and vectors are arrays of three
numbers; params is a struct ``origin, center, axis, direction, radius``.
Adjacency is one flat list for each relation, ``(comp, relation, pos,
target)``, of which an entity has the range from ``start``, ``count`` long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as v
from .prefix import running_totals

#: Tables in the order they are probed, with the letter of their selectors.
KINDS = {"occurrence": "o", "shape": "s", "face": "f", "edge": "e", "vertex": "v"}
#: Relation, the kind that holds the ranges, the kind it points to.
RELATIONS = {"faceEdge": ("face", "edge"), "edgeFace": ("edge", "face"), "edgeVertex": ("edge", "vertex"), "vertexEdge": ("vertex", "edge")}
#: Shares in which the occurrences of one component meet its counts.
SHARES = 8


def three(c: Column | str) -> v.Vec:
    c = F.col(c) if isinstance(c, str) else c
    return tuple(F.get(c, i) for i in range(3))


def array(p: v.Vec) -> Column:
    return F.when(p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull(), F.array(*p))


def array_once(p: v.Vec) -> Column:
    """``array`` for long expressions: each is evaluated once, and not in one method with the rest of the row, which the JVM would leave uncompiled."""
    return F.get(F.transform(F.array(F.array(*p)), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), a)), F.lit(0))


def table_rows(manifests: DataFrame, rows: str, columns: str, doc: str = "manifest") -> DataFrame:
    """Rows of one table of JSON manifests, as ``(*others, row, values)``: a map by the declared column names.

    A row that is no list is skipped, values beyond the header or names beyond
    the row are left out, a manifest without the table gives no row.
    """
    header = F.from_json(F.get_json_object(doc, f"$.tables.{columns}"), "array<string>")
    lists = F.from_json(F.get_json_object(doc, f"$.{rows}"), "array<string>")
    others = [c for c in manifests.columns if c != doc]
    each = manifests.select(*others, header.alias("_names"), F.posexplode(lists).alias("row", "_text")).withColumn("_values", F.when(F.col("_text").startswith("["), F.from_json("_text", "array<string>")))
    n = F.least(F.size("_names"), F.size("_values"))
    return each.filter("_names is not null and _values is not null").select(*others, "row", F.map_from_arrays(F.slice("_names", F.lit(1), n), F.slice("_values", F.lit(1), n)).alias("values"))


def canonical_selector(text: Column, single: Column) -> Column:
    """A bare ``f3`` gets the only occurrence, if there is one; null if it then names nothing."""
    local = text.rlike("^[sfev][0-9]+$")
    return F.when(local, F.concat(single, F.lit("."), text)).otherwise(F.when(text != "", text))


def display_selector(text: Column, single: Column) -> Column:
    tail = F.substr(text, F.length(single) + 2)
    return F.when(text.startswith(F.concat(single, F.lit("."))) & tail.rlike("^[sfev]"), tail).otherwise(text)


def lookup(refs: DataFrame, entities: DataFrame, ref: str = "ref", single: Column | None = None) -> DataFrame:
    """``refs`` with kind and row of the entity of that id; of several tables the first in their fixed order, null if none."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    known = entities.groupBy(F.col("id").alias("_id")).agg(F.min(F.struct(rank.alias("_r"), "row", "kind")).alias("_hit"))
    named = refs.withColumn("selector", canonical_selector(F.col(ref), F.lit(None).cast("string") if single is None else single))
    return named.join(known, F.col("selector") == F.col("_id"), "left").select(*refs.columns, "selector", F.col("_hit.kind").alias("kind"), F.col("_hit.row").alias("row"))


def adjacent(holders: DataFrame, flat: DataFrame, targets: DataFrame, start: str, count: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, id, at, target)``: the entities in the range of each holder, in order; what is out of range is left out."""
    last = F.col(start) + F.col(count) - 1
    places = holders.filter(F.col(count) > 0).select(*keys, "id", F.explode(F.sequence(F.col(start), last)).alias("pos")).withColumnRenamed("id", "holder")
    rows = places.join(flat.withColumnRenamed("target", "row"), [*keys, "pos"]).join(targets.select(*keys, "row", F.col("id").alias("target")), [*keys, "row"])
    return rows.select(*keys, F.col("holder").alias("id"), F.col("pos").alias("at"), "target")


def two_hop(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, id, targets)``: what the targets of ``first`` point to by ``second``, each once, in the order first seen."""
    a = first.select(*keys, F.col("id").alias("_from"), F.col("at").alias("_a"), F.col("target").alias("id"))
    pairs = a.join(second, [*keys, "id"]).groupBy(*keys, "_from", "target").agg(F.min(F.struct("_a", "at")).alias("seen"))
    rows = pairs.groupBy(*keys, "_from").agg(F.array_sort(F.collect_list(F.struct("seen", "target"))).alias("l"))  # the neighbours of one entity
    return rows.select(*keys, F.col("_from").alias("id"), F.transform("l", lambda x: x["target"]).alias("targets"))


def place(rows: DataFrame, matrix: str = "transform") -> DataFrame:
    """Entities moved by a 4x4 matrix (16 numbers by row): points, directions, boxes by their corners; what cannot be placed is null."""
    m = [F.get(F.col(matrix), i) for i in range(16)]
    m[12:] = [F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]
    point = lambda c: array_once(v.apply_point(m, three(c)))
    way = lambda c: array_once(v.apply_direction(m, three(c)))
    lo, hi = v.apply_box(m, three("lo"), three("hi"))
    p = F.col("params")
    params = F.struct(point(p["origin"]).alias("origin"), point(p["center"]).alias("center"), way(p["axis"]).alias("axis"), way(p["direction"]).alias("direction"), p["radius"].alias("radius"))
    return rows.withColumns({"center": point("center"), "normal": way("normal"), "lo": array_once(lo), "hi": array_once(hi), "params": F.when(p.isNotNull(), params)})


def entity_name(local: Column, letter: Column, ordinal: Column) -> Column:
    """``f19`` from the row's ordinal (a whole number), else from the end of its own id; null if it has neither. It holds no dot."""
    tail = F.element_at(F.split(local, r"\."), -1)
    return F.when(ordinal.isNotNull(), F.concat(letter, ordinal.cast("string"))).when(F.length(tail) > 0, tail)


def merge_assembly(occurrences: DataFrame, entities: DataFrame, flat: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, adjacency and ranges of all occurrences ``(seq, occ, comp, transform)`` of components.

    Ids, ranges, row numbers and shape names are rebased as the tables of the
    components are set one after the other in order of seq; rows that cannot
    be named are left out, their component's counts stay. Of equal ids the
    first is ``first``. An id is its occurrence and a name without a dot, so
    equal ids are looked for in the component's own table, and among all rows
    only where several occurrences bear one name. Tables of components can be
    large whatever their files' size says: they are merge-joined, never
    broadcast; occurrences of one hot component are left to skew splitting.
    """
    letter = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")]
    local = entities.filter("kind <> 'occurrence'").withColumn("_named", F.col("ordinal").isNotNull() | (F.length(F.element_at(F.split("id", r"\."), -1)) > 0))
    kinds = [k for k in KINDS if k != "occurrence"]
    sizes = local.groupBy("comp").agg(*[F.sum(F.when((F.col("kind") == k) & F.col("_named"), 1).otherwise(0)).alias(f"n_{k}") for k in kinds], *[F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"all_{k}") for k in kinds])
    spans = flat.groupBy("comp").agg(*[F.sum(F.when(F.col("relation") == r, 1).otherwise(0)).alias(f"n_{r}") for r in RELATIONS])
    counted = [f"n_{x}" for x in (*kinds, *RELATIONS)]
    # the counts of a component are one row, which each share of its occurrences meets
    counts = sizes.join(spans.hint("merge"), "comp", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    placed = occurrences.withColumn("_share", F.pmod(F.hash("seq"), F.lit(SHARES))).join(counts.hint("merge"), ["comp", "_share"]).drop("_share").na.fill(0, counted)
    based = running_totals(placed, ["seq"], {f"b_{c[2:]}": c for c in counted})
    # a row's place among the rows of its component that have a name
    slot = Window.partitionBy("comp", "kind").orderBy("row")  # one component's table
    rows = local.filter("_named").withColumns({"_slot": F.row_number().over(slot) - 1, "_name": entity_name(F.col("id"), letter, F.col("ordinal"))})
    rows = rows.withColumn("_head", F.min("_slot").over(Window.partitionBy("comp", "kind", "_name")))
    shapes = rows.filter("kind = 'shape'").select("comp", F.col("id").alias("shape"), F.col("_name").alias("_shape"))
    rows = rows.withColumnRenamed("id", "local_id").join(shapes.hint("merge"), ["comp", "shape"], "left")
    per = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(f"b_{k}"))])[F.col("kind")]

    def rebased(part: DataFrame) -> DataFrame:
        return part.join(rows.hint("merge"), "comp").withColumns({
            "id": F.concat("occ", F.lit("."), "_name"), "row": per + F.col("_slot"), "shape": F.coalesce(F.concat("occ", F.lit("."), "_shape"), "shape"), "_first": per + F.col("_head"),
            "face_start": F.when(F.col("kind") == "shape", F.col("face_start") + F.col("b_face")).when(F.col("kind") == "edge", F.col("face_start") + F.col("b_edgeFace")),
            "edge_start": F.when(F.col("kind") == "shape", F.col("edge_start") + F.col("b_edge")).when(F.col("kind") == "face", F.col("edge_start") + F.col("b_faceEdge")).when(F.col("kind") == "vertex", F.col("edge_start") + F.col("b_vertexEdge")),
            "vertex_start": F.when(F.col("kind") == "edge", F.col("vertex_start") + F.col("b_edgeVertex")),
        }).filter("id is not null")

    named = based.filter("occ is not null")
    shared = named.groupBy("occ").agg(F.count("*").alias("_n")).filter("_n > 1").select("occ").hint("merge")
    again = rebased(named.join(shared, "occ", "left_semi")).drop("_first")
    firsts = again.groupBy("kind", "id").agg(F.min("row").alias("_first")).hint("merge")
    full = rebased(named.join(shared, "occ", "left_anti")).unionByName(again.join(firsts, ["kind", "id"]))
    merged = place(full).withColumn("first", F.col("row") == F.col("_first"))
    base = F.create_map(*[x for r in RELATIONS for x in (F.lit(r), F.col(f"b_{r}"))])[F.col("relation")]
    to = F.create_map(*[x for r, (_, k) in RELATIONS.items() for x in (F.lit(r), F.col(f"b_{k}"))])[F.col("relation")]
    relations = based.select("comp", "occ", *[f"b_{x}" for x in (*kinds, *RELATIONS)]).join(flat.hint("merge"), "comp").select("occ", "relation", (F.col("pos") + base).alias("pos"), (F.col("target") + to).alias("target"))
    ranges = based.select("seq", "occ", *[x for k in ("shape", "face", "edge") for x in (F.col(f"b_{k}").alias(f"{k}_start"), F.col(f"all_{k}").alias(f"{k}_count"))])
    return merged, relations, ranges


# ---- facts -------------------------------------------------------------------


def frame_facts(matrix: str = "transform") -> Column:
    """translation and the local axes of unit length; an axis without length stays as it is."""
    m = [F.get(F.col(matrix), i) for i in range(16)]
    axes = []
    for j, name in enumerate("xyz"):
        col = (m[j], m[4 + j], m[8 + j])
        axes.append(F.coalesce(array(v.unit(col)), F.array(*col)).alias(name))
    return F.when(F.size(F.col(matrix)) == 16, F.struct(F.array(m[3], m[7], m[11]).alias("translation"), *axes))


def positioning_facts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``facts``: where an entity is and how it points, by its kind.

    A struct point, normal, axis_vector, alignment (axis, sign, magnitude,
    aligned), axis, coordinate, plane_offset, radius. A face looks along its
    normal; cylinders, cones and tori align by their axis; lines by their
    direction; circles and ellipses by their axis.
    """
    # in steps, each of plain columns: one expression would hold the first steps hundreds of times
    face, edge = F.col("kind") == "face", F.col("kind") == "edge"
    curve = edge & F.col("type").isin("circle", "ellipse")
    line, round_ = edge & (F.col("type") == "line"), face & F.col("type").isin("cylinder", "cone", "torus")
    p = F.col("params")
    out = rows.withColumns({
        "_center": F.coalesce(F.col("center"), array(v.scale(v.add(three("lo"), three("hi")), 0.5))),
        "_way": F.when(face, F.coalesce(F.col("normal"), p["axis"])).when(line, p["direction"]), "_turn": F.when(round_ | curve, p["axis"]),
    })
    out = out.withColumns({"_way": unit_array("_way"), "_turn": unit_array("_turn"), "_origin": F.when(face | line, F.coalesce(p["origin"], F.col("_center")))})
    out = out.withColumns({"_by_way": alignment("_way"), "_by_turn": alignment("_turn"), "_middle": F.when(curve | (face & (F.col("type") == "sphere")), F.coalesce(p["center"], F.col("_center"))).otherwise(F.col("_center"))})
    out = out.withColumn("_at", F.when(face, F.col("_origin")).when(line, F.col("_center")))
    out = out.withColumn("_axis", F.when(F.col("_by_way.aligned") & F.col("_at").isNotNull(), F.col("_by_way.axis")))
    facts = F.struct(
        F.coalesce("_origin", "_middle").alias("point"), F.col("_way").alias("direction"), F.col("_turn").alias("axis_vector"), F.coalesce("_by_turn", "_by_way").alias("alignment"),
        F.col("_axis").alias("axis"), by_axis("_at", F.col("_axis")).alias("coordinate"), F.when(face, v.dot(three("_way"), three("_origin"))).alias("plane_offset"),
        F.when(face | curve, p["radius"]).alias("radius"),
    )
    return out.withColumn("facts", facts).drop("_center", "_way", "_turn", "_origin", "_by_way", "_by_turn", "_middle", "_at", "_axis")


def unit_array(c: str) -> Column:
    """An array of three numbers at length one; null without length."""
    n = F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.col(c), lambda x: x / F.nullif(n, F.lit(0.0)))


def alignment(c: str) -> Column:
    """``dominant_axis`` of a unit vector in an array, the first of equal components; null for null or without length."""
    size = F.array_max(F.transform(F.col(c), lambda x: F.abs(x)))
    at = (F.array_position(F.transform(F.col(c), lambda x: F.abs(x)), size) - 1).cast("int")
    found = F.struct(F.get(F.array(*map(F.lit, "xyz")), at).alias("axis"), F.when(F.get(F.col(c), at) >= 0, 1).otherwise(-1).alias("sign"), size.alias("magnitude"), (size >= v.ALIGNED).alias("aligned"))
    return F.when(size.isNotNull(), found)


def by_axis(p: Column | str, axis: Column) -> Column:
    """The component of a point, an array, along the axis of that name."""
    return F.get(F.col(p) if isinstance(p, str) else p, F.when(axis == "x", 0).when(axis == "y", 1).when(axis == "z", 2))


def geometry_facts(rows: DataFrame) -> DataFrame:
    """``rows`` with size, diag, normal_axis and plane_coordinate of faces, direction_axis of edges."""
    p = F.col("params")
    out = rows.withColumns({"size": array(v.sub(three("hi"), three("lo"))), "diag": v.length(v.sub(three("hi"), three("lo")))})
    out = out.withColumns({"_n": F.when(F.col("kind") == "face", F.coalesce(F.col("normal"), p["axis"])), "_d": F.when(F.col("kind") == "edge", F.coalesce(p["direction"], p["axis"], F.col("size")))})
    out = out.withColumns({"_n": unit_array("_n"), "_d": unit_array("_d")})
    out = out.withColumns({"normal_axis": alignment("_n"), "direction_axis": alignment("_d")}).drop("_n", "_d")
    return out.withColumn("plane_coordinate", F.when(F.col("normal_axis.aligned"), by_axis("center", F.col("normal_axis.axis"))))


def planar_faces(rows: DataFrame, normal: tuple[float, float, float], at: float, tol: float = 1e-3, least: float = 0.0) -> DataFrame:
    """Plane faces along ``normal`` (0.02 a component) at coordinate ``at`` of its main axis, with over ``least`` of area."""
    axis = max(range(3), key=lambda i: abs(normal[i]))
    close = [F.abs(x - n) <= 0.02 for x, n in zip(three("normal"), normal, strict=True)]
    return rows.filter((F.col("kind") == "face") & (F.col("type") == "plane") & close[0] & close[1] & close[2] & (F.abs(F.get("center", F.lit(axis)) - at) <= tol) & (F.col("area") > least))


def selected(rows: DataFrame, refs: list[str], col: str = "id") -> DataFrame:
    """Rows of the named occurrences and of all below them; all rows if none is named."""
    if not refs:
        return rows
    hit = F.lit(False)
    for r in refs:
        hit = hit | (F.col(col) == r) | F.col(col).startswith(f"{r}.")
    return rows.filter(hit)


def plane_groups(faces: DataFrame, tol: float = 1e-3, share: float = 0.0, top: int | None = None) -> DataFrame:
    """Aligned plane faces by axis and rounded coordinate: area-weighted coordinate, faces, area, box, ids, sign of the first normal.

    Groups below ``share`` of the area of all aligned plane faces are left out; largest first.
    """
    f = geometry_facts(faces).filter((F.col("kind") == "face") & (F.col("type") == "plane") & F.col("normal_axis.aligned"))
    f = f.withColumn("slot", F.bround(F.col("plane_coordinate") / tol))
    each = lambda side, fn: F.array(*[fn(F.get(side, F.lit(i))) for i in range(3)])
    groups = f.groupBy(F.col("normal_axis.axis").alias("axis"), "slot").agg(
        (F.sum(F.col("plane_coordinate") * F.col("area")) / F.sum("area")).alias("coordinate"), F.count("*").alias("faces"), F.sum("area").alias("area"),
        each("lo", F.min).alias("lo"), each("hi", F.max).alias("hi"), F.array_sort(F.collect_set("id")).alias("ids"), F.min_by("normal_axis.sign", "row").alias("sign"),
    )
    total = f.agg(F.sum("area").alias("_all"))
    out = groups.join(F.broadcast(total), F.lit(True)).filter(F.col("area") >= share * F.col("_all")).drop("_all", "slot")
    return out.orderBy(F.desc("area"), "axis", "coordinate").limit(top) if top else out


def edge_class(faces: Column, closed: Column, length: Column, dihedral: Column, hard: float = 30.0) -> Column:
    """degenerate, seam, unknown, boundary, non-manifold, hard or tangent, by faces at the edge and the angle between them (degrees)."""
    return (
        F.when(length <= 1e-9, "degenerate").when(closed & (faces == 1), "seam").when(faces.isNull(), "unknown").when(faces == 1, "boundary")
        .when(faces != 2, "non-manifold").when(dihedral >= hard, "hard").otherwise("tangent")
    )


def entry_summary(rows: DataFrame) -> DataFrame:
    """Counts by kind and of leaf occurrences."""
    occ = rows.filter("kind = 'occurrence'")
    parents = occ.select(F.regexp_replace("id", r"\.[0-9]+$", "").alias("id")).distinct().withColumn("_up", F.lit(True))
    marked = rows.join(parents, "id", "left")
    return marked.agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS], F.count(F.when((F.col("kind") == "occurrence") & F.col("_up").isNull(), 1)).alias("n_leaf"))


def table_digest(rows: DataFrame, key: str, value: Column, order: str, run: int = 4096) -> DataFrame:
    """``(key, digest)``: SHA-256 over the values of a table in order, in runs of ``run`` rows, each hashed, then all of them."""
    runs = rows.groupBy(key, F.floor(F.col(order) / run).alias("_run")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.cast("string").alias("t")))).alias("l"))
    hashed = runs.select(key, "_run", F.sha2(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), 256).alias("h"))
    return hashed.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_run", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def manifest_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """A row a kind: counts, their difference, whether ids and whether geometry agree in order, and how the box moved and grew."""
    shape = F.to_json(F.struct("type", *[F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("center", "normal", "lo", "hi")], F.round("area", 6).alias("area"), F.round("length", 6).alias("length")))
    sides = []
    for rows in (left, right):
        ids, geometry = table_digest(rows, "kind", F.col("id"), "row"), table_digest(rows, "kind", shape, "row").withColumnRenamed("digest", "geometry")
        box = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(3)]
        sides.append(rows.groupBy("kind").agg(F.count("*").alias("n"), *box).join(ids, "kind").join(geometry, "kind"))
    a, b = [s.select("kind", *[F.col(c).alias(f"{p}_{c}") for c in s.columns if c != "kind"]) for p, s in zip("ab", sides, strict=True)]
    size = lambda p: v.length(tuple(F.col(f"{p}_hi{i}") - F.col(f"{p}_lo{i}") for i in range(3)))
    moved = v.length(tuple((F.col(f"b_hi{i}") + F.col(f"b_lo{i}") - F.col(f"a_hi{i}") - F.col(f"a_lo{i}")) / 2.0 for i in range(3)))
    return a.join(b, "kind", "full").select(
        "kind", F.coalesce("a_n", F.lit(0)).alias("n_left"), F.coalesce("b_n", F.lit(0)).alias("n_right"), (F.coalesce("b_n", F.lit(0)) - F.coalesce("a_n", F.lit(0))).alias("delta"),
        F.coalesce(F.col("a_digest") == F.col("b_digest"), F.lit(False)).alias("same_ids"), F.coalesce(F.col("a_geometry") == F.col("b_geometry"), F.lit(False)).alias("same_geometry"),
        moved.alias("center_moved"), (size("b") - size("a")).alias("diag_delta"),
    )


def measure(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Signed, absolute and straight distance between two entities' facts, along the axis both align to, else the one that has a coordinate."""
    a, b = F.col(left), F.col(right)
    la, lb = [F.when(x["alignment"]["aligned"], x["alignment"]["axis"]) for x in (a, b)]
    axis = F.when(la.isNull() | lb.isNull() | (la == lb), F.coalesce(la, lb))
    out = pairs.withColumn("axis", F.coalesce(axis, a["axis"], b["axis"]))
    at = lambda x: F.coalesce(F.when(x["axis"] == F.col("axis"), x["coordinate"]), by_axis(x["point"], F.col("axis")))
    out = out.withColumns({"signed": at(b) - at(a), "straight": v.length(v.sub(three(b["point"]), three(a["point"]))), "_a": F.coalesce(a["direction"], a["axis_vector"]), "_b": F.coalesce(b["direction"], b["axis_vector"])})
    d = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)  # both of length one
    relation = F.when(d <= -v.ALIGNED, "opposed").when(d >= v.ALIGNED, "parallel").when(F.abs(d) <= 1 - v.ALIGNED, "perpendicular").when(d.isNotNull(), "angled")
    return out.withColumns({"absolute": F.abs("signed"), "relation": relation}).drop("_a", "_b")


def align(pairs: DataFrame, mode: str = "flush", offset: float = 0.0, left: str = "left", right: str = "right") -> DataFrame:
    """The translation that puts the left entity flush with (along the axis) or centred on (in space) the right one."""
    m = measure(pairs, left, right)
    if mode == "center":
        step = v.sub(three(F.col(right)["point"]), three(F.col(left)["point"]))
        return m.withColumn("translation", F.array(*step))
    return m.withColumn("translation", F.array(*[F.when(F.col("axis") == c, F.col("signed") + offset).otherwise(F.lit(0.0)) for c in "xyz"]))


def assign_by_prefix(nodes: DataFrame, refs: DataFrame, node: str = "node", ref: str = "ref") -> DataFrame:
    """``refs`` with the longest node whose dotted id is the ref or stands before it: an equi-join on all prefixes."""
    parts = F.split(ref, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = refs.select(ref, F.posexplode(heads).alias("_n", "_head"))
    hit = each.join(nodes.select(F.col(node).alias("_head")).distinct(), "_head").groupBy(ref).agg(F.max_by("_head", "_n").alias(node))
    return refs.join(hit, ref, "left")
