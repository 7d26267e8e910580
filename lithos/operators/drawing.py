"""Drawing exchange files as rows: group codes, entities, layer intents, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plane
from ..store import checkpointed

#: Words of layer names and what they mean, the first kind that has one counts; words of line types; kinds of entities.
INTENTS = {
    "cut": ["cut", "profile"],
    "bend": ["bend", "fold"],
    "engrave": ["engrave", "etch"],
    "reference": """ref reference note notes annotation construction dim dims dimension dimensions section sections hidden center centre
    centerline centreline phantom title titleblock border frame viewport hatch text label labels leader axis""".split(),
}
ANNOTATION_LINES = "hidden hidden2 hiddenx2 center center2 centerx2 centre phantom phantom2 phantomx2 dashdot dashdot2 dashdotx2 divide dot".split()
ANNOTATIONS = ["TEXT", "MTEXT", "DIMENSION", "LEADER", "MULTILEADER", "HATCH"]
APPARATUS = ["DIMENSION", "LEADER", "MULTILEADER", "ARC_DIMENSION", "VIEWPORT"]


def words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def layer_intent(name: Column) -> Column:
    """cut, bend, engrave or reference, by the words of a layer's name; cut if none is known."""
    out = F.lit("cut")
    for kind in reversed(INTENTS):
        out = F.when(F.arrays_overlap(words(name), F.array(*map(F.lit, INTENTS[kind]))), kind).otherwise(out)
    return out


def group_codes(files: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``(doc, at, code, value)``: the pairs of lines of each file; a file is one row and one task's work."""
    lines = F.split(F.regexp_replace(F.col(text), "\r", ""), "\n")
    each = files.select(F.col(doc).alias("doc"), F.posexplode(lines).alias("n", "line"))
    pairs = each.groupBy("doc", F.floor(F.col("n") / 2).alias("at")).agg(F.max(F.when(F.col("n") % 2 == 0, F.trim("line"))).alias("code"), F.max(F.when(F.col("n") % 2 == 1, F.trim("line"))).alias("value"))
    return pairs.filter(F.col("code").rlike("^[0-9]+$") & F.col("value").isNotNull()).withColumn("code", F.col("code").cast("int"))


def header(codes: DataFrame) -> DataFrame:
    """``(doc, name, code, value)`` of the variables of the header."""
    w = Window.partitionBy("doc").orderBy("at")
    marked = codes.withColumn("_name", F.last(F.when(F.col("code") == 9, F.col("value")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("code <> 9 and code <> 0 and _name is not null").select("doc", F.col("_name").alias("name"), "code", "value").dropDuplicates(["doc", "name"])


def entities(codes: DataFrame) -> DataFrame:
    """``(doc, section, seq, kind, layer, groups)``: what starts with code 0, with its groups as an array of code and value in order."""
    run = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("code") == 0) & F.col("value").isin("SECTION")
    named = (F.col("code") == 2) & (F.lag("value").over(Window.partitionBy("doc").orderBy("at")) == "SECTION")
    marked = codes.withColumn("_named", named).withColumn("seq", F.count(F.when(F.col("code") == 0, 1)).over(run))
    marked = marked.withColumn("section", F.last(F.when(F.col("_named"), F.col("value")).when(opens, F.lit("")), True).over(run))
    grouped = marked.groupBy("doc", "section", "seq").agg(F.array_sort(F.collect_list(F.struct("at", "code", "value"))).alias("groups"))  # one entity
    first = lambda c: F.get(F.filter("groups", lambda g: g["code"] == c), F.lit(0))["value"]
    return grouped.withColumn("kind", first(0)).filter(~F.col("kind").isin("SECTION", "ENDSEC", "EOF")).withColumn("layer", F.coalesce(first(8), F.lit("0"))).select("doc", "section", "seq", "kind", "layer", "groups")


def number(code: int, default: float | None = None) -> Column:
    found = F.get(F.filter("groups", lambda g: g["code"] == code), F.lit(0))["value"].try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def geometry(rows: DataFrame) -> DataFrame:
    """Adds points (x, y of the corners or ends), closed, radius, start, end (degrees) of lines, circles, arcs and light polylines."""
    every = lambda code: F.transform(F.filter("groups", lambda g: g["code"] == code), lambda g: g["value"].try_cast("double"))
    xs, ys = every(10), every(20)
    kind, at = F.col("kind"), lambda x, y: F.struct(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    end = lambda a: at(number(10, 0.0) + number(40, 0.0) * F.cos(F.radians(a)), number(20, 0.0) + number(40, 0.0) * F.sin(F.radians(a)))
    points = (
        F.when(kind == "LINE", F.array(at(number(10, 0.0), number(20, 0.0)), at(number(11, 0.0), number(21, 0.0))))
        .when(kind == "ARC", F.array(end(number(50, 0.0)), end(number(51, 360.0)))).when(kind == "CIRCLE", F.array(at(number(10, 0.0), number(20, 0.0))))
        .when(kind.isin("LWPOLYLINE", "SPLINE"), F.zip_with(xs, ys, at))
    )
    closed = F.coalesce(number(70).cast("int").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return rows.withColumns({"points": points, "closed": closed, "radius": F.when(kind.isin("CIRCLE", "ARC"), F.round(number(40, 0.0), 6)), "start": F.when(kind == "ARC", number(50, 0.0)), "end": F.when(kind == "ARC", number(51, 360.0))})


def layer_summary(rows: DataFrame) -> DataFrame:
    """``(doc, layer, n, min_x ... max_y)``: entities and bounds by layer; circles by their radius."""
    p = rows.select("doc", "layer", "seq", F.explode_outer("points").alias("p"), F.when(F.col("kind") == "CIRCLE", F.col("radius")).otherwise(0.0).alias("r"))
    return p.groupBy("doc", "layer").agg(F.count_distinct("seq").alias("n"), *[f(F.col(f"p.{c}") + s * F.col("r")).alias(f"{f.__name__}_{c}") for c in "xy" for f, s in ((F.min, -1), (F.max, 1))])


def findings(files: DataFrame) -> DataFrame:
    """``(doc, severity, code, subject)`` of drawings ``(doc, text)``.

    Closure is asked of cut layers of files that are no dimensioned drawings:
    polylines must close, and each end of lines, arcs and splines of a layer
    must be shared by an even number of ends.
    """
    codes = group_codes(files)
    heads = header(codes).filter("name = '$INSUNITS' and code = 70").select("doc", F.col("value").try_cast("int").alias("units"))
    rows = checkpointed(geometry(entities(codes)))  # read by every rule
    table, model = rows.filter("section = 'TABLES' and kind = 'LAYER'"), rows.filter("section = 'ENTITIES'")
    text = lambda c: F.get(F.filter("groups", lambda g: g["code"] == c), F.lit(0))["value"]
    line_type = F.arrays_overlap(words(text(6)), F.array(*map(F.lit, ANNOTATION_LINES)))
    declared = table.select("doc", text(2).alias("layer"), F.when((number(290) == 0) | line_type, "reference").alias("declared")).filter("declared is not null").dropDuplicates(["doc", "layer"])
    paper = (number(67) == 1) | F.col("kind").isin(APPARATUS)
    facts = model.groupBy("doc").agg(F.max(F.coalesce(paper, F.lit(False))).alias("drawing"), F.count(F.when(~F.col("kind").isin(ANNOTATIONS), 1)).alias("n"))
    docs = files.select("doc").distinct().join(heads, "doc", "left").join(facts, "doc", "left")
    code = lambda df, severity, name, subject: df.select("doc", F.lit(severity).alias("severity"), F.lit(name).alias("code"), subject.cast("string").alias("subject"))
    none = F.lit("")
    out = [code(docs.filter("coalesce(units, 0) <= 0"), "error", "units_not_set", none), code(docs.filter("drawing"), "info", "drawing_document", none), code(docs.filter("coalesce(n, 0) = 0"), "error", "empty_drawing", none)]
    shapes = model.filter(~F.col("kind").isin(ANNOTATIONS))
    flat = ((F.col("kind") == "LINE") | (F.col("kind") == "LWPOLYLINE")) & (F.size(F.array_distinct("points")) < 2)
    nothing = flat | (F.col("kind").isin("CIRCLE", "ARC") & (F.col("radius") <= 0))
    out.append(code(shapes.filter(nothing), "error", "zero_length_entity", F.col("seq")))
    own = F.when(F.col("kind") == "LINE", F.array_sort("points")).otherwise(F.col("points"))
    known = shapes.filter(~nothing).withColumn("_sig", F.when(F.col("kind").isin("LINE", "CIRCLE", "ARC", "LWPOLYLINE"), F.to_json(F.struct("kind", "layer", own.alias("p"), "closed", "radius", "start", "end"))).otherwise(F.col("seq").cast("string")))
    firsts = known.groupBy("doc", "_sig").agg(F.min("seq").alias("_first"))
    known = known.join(firsts, ["doc", "_sig"])
    out.append(code(known.filter("seq > _first"), "error", "duplicate_entity", F.col("seq")))
    cut = known.filter("seq = _first").join(docs.filter("not drawing").select("doc"), "doc").join(declared, ["doc", "layer"], "left").filter(F.col("declared").isNull() & (layer_intent(F.col("layer")) == "cut"))
    shut = (F.size("points") >= 3) & (F.col("closed") | (F.get("points", F.lit(0)) == F.element_at("points", -1)))
    out.append(code(cut.filter((F.col("kind") == "LWPOLYLINE") & ~shut), "error", "open_cut_profile", F.col("layer")))
    curves = cut.filter(F.col("kind").isin("LINE", "ARC") | ((F.col("kind") == "SPLINE") & ~F.col("closed") & (F.size("points") >= 2)))
    ends = curves.select("doc", "layer", F.explode(F.array(F.get("points", F.lit(0)), F.element_at("points", -1))).alias("end")).groupBy("doc", "layer", "end").count().filter("count % 2 = 1")
    out.append(code(ends.select("doc", "layer").distinct(), "error", "open_cut_profile", F.col("layer")))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def scaled_to_mm(rows: DataFrame, units: Column) -> DataFrame:
    """Points and radius in millimetres; a unit without a name counts as millimetres."""
    k = F.coalesce(plane.unit_scale(units), F.lit(1.0))
    return rows.withColumns({"points": F.transform("points", lambda p: F.struct((p["x"] * k).alias("x"), (p["y"] * k).alias("y"))), "radius": F.col("radius") * k})
