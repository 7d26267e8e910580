"""Queries over drawings: each nation lends a sound drawing, and one for each way to break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drawing
from ..registry import query, table
from .clouds import near, sql_near


def _line(x0: float, y0: float, x1: float, y1: float, layer: str = "CUT") -> str:
    return f"0\nLINE\n8\n{layer}\n10\n{x0}\n20\n{y0}\n11\n{x1}\n21\n{y1}\n"


_UNITS = "0\nSECTION\n2\nHEADER\n9\n$INSUNITS\n70\n4\n0\nENDSEC\n"
_LAYERS = "0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n0\nLAYER\n2\nplan\n70\n0\n6\nHIDDEN2\n0\nLAYER\n2\nsteel\n6\nCONTINUOUS\n0\nENDTAB\n0\nENDSEC\n"
_SQUARE = _line(0, 0, 2, 0) + _line(2, 0, 2, 3) + _line(2, 3, 0, 3) + _line(0, 3, 0, 0)
_HOLE = "0\nCIRCLE\n8\nCUT\n10\n1\n20\n1\n40\n0.5\n"
_END = "0\nENDSEC\n0\nEOF\n"
DXF = _UNITS + _LAYERS + "0\nSECTION\n2\nENTITIES\n" + _SQUARE + _HOLE + _END
_ARCS = "0\nARC\n8\nCUT\n10\n9\n20\n0\n40\n1\n50\n0\n51\n180\n0\nARC\n8\nCUT\n10\n9\n20\n0\n40\n1\n50\n180\n51\n360\n"
_POLY = "0\nLWPOLYLINE\n8\n{}\n90\n3\n70\n{}\n10\n0\n20\n0\n10\n1\n20\n0\n10\n1\n20\n{}\n"
#: What is put before the end of the entities (or in place of what), and the findings that follow.
CASES: list[tuple[str, str, str]] = [
    ("", "", ""), (_UNITS, "", "units_not_set"), ("70\n4\n", "70\n0\n", "units_not_set"), (_SQUARE + _HOLE, "", "empty_drawing"), (_SQUARE + _HOLE, "0\nTEXT\n8\nCUT\n1\nnote\n", "empty_drawing"),
    (_END, _line(5, 5, 5, 5) + _END, "zero_length_entity"), ("40\n0.5", "40\n0", "zero_length_entity"), (_END, _POLY.format("CUT", 1, 0).replace("10\n1\n20\n0\n", "10\n0\n20\n0\n") + _END, "open_cut_profile"),
    (_END, _line(2, 0, 0, 0) + _END, "duplicate_entity"), (_END, _HOLE + _END, "duplicate_entity"), (_END, _line(5, 5, 6, 5) + _END, "open_cut_profile"), (_END, _line(5, 5, 6, 5, "Bend 1") + _END, ""), (_END, _line(5, 5, 6, 5, "PREFORM") + _END, "open_cut_profile"),
    (_END, _line(5, 5, 6, 5, "plan") + _END, ""), (_END, _line(5, 5, 6, 5, "steel") + _END, "open_cut_profile"), (_END, _line(5, 5, 6, 5, "cut_section") + _END, "open_cut_profile"), (_END, _ARCS + _END, ""),
    (_END, _POLY.format("CUT", 0, 1) + _END, "open_cut_profile"), (_END, _POLY.format("CUT", 1, 1) + _END, ""), (_END, "0\nDIMENSION\n8\nx\n" + _line(5, 5, 6, 5) + _END, "drawing_document"), (_END, _line(5, 5, 6, 5).replace("LINE\n", "LINE\n67\n1\n") + _END, "drawing_document"),
]
CASES[7] = (_END, _POLY.format("CUT", 1, 0).replace("10\n1\n", "10\n0\n") + _END, "zero_length_entity")


def files(spark, sf_dir) -> DataFrame:
    texts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(DXF.replace(a, b, 1) if a else DXF).alias("text")) for i, (a, b, _) in enumerate(CASES)])
    each = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(texts).alias("t"))
    return each.select(F.concat("n_nationkey", F.lit("/"), "t.i").alias("doc"), "t.text")


_ROWS = ", ".join(f"({i}, '{c}')" for i, (_, _, codes) in enumerate(CASES) for c in codes.split())


@query(f"SELECT n_nationkey || '/' || i AS doc, code FROM nation, (VALUES {_ROWS}) t(i, code)")
def drawing_rules(spark, sf_dir):
    """Codes found on each broken drawing; none on the sound ones."""
    return drawing.findings(files(spark, sf_dir)).select("doc", "code").distinct()


@query(f"SELECT n_nationkey || '/0' AS doc, 'CUT' AS layer, 5::BIGINT AS n, {sql_near('0')} AS min_x, {sql_near('50.8')} AS max_x, {sql_near('0')} AS min_y, {sql_near('76.2')} AS max_y FROM nation")
def drawing_layers(spark, sf_dir):
    """Bounds by layer of the sound drawings, their unit taken for inches."""
    rows = drawing.geometry(drawing.entities(drawing.group_codes(files(spark, sf_dir).filter("doc like '%/0'")))).filter("section = 'ENTITIES'")
    s = drawing.layer_summary(drawing.scaled_to_mm(rows, F.lit(1)))
    return s.select("doc", "layer", "n", *[near(c).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


_NAMES = ["CUT_SECTION", "bend-1", "PREFORM", "Etch", "title block", "", "Center.2", "profile note"]
_WANT = ["cut", "bend", "cut", "engrave", "cut", "cut", "reference", "cut"]
_WANT[4] = "reference"


@query("SELECT p_partkey, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WANT)) + " END AS intent FROM part")
def layer_intents(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", drawing.layer_intent(F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 8).cast("int"))).alias("intent"))
