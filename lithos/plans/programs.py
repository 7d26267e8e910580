"""Queries over machine programs; ``events`` lends its rows as lines, a user is a program."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gcode
from ..registry import query, table

#: Text of a line by event: a number of commands in turn, with coordinates from the row.
_CASES = ["G1 X{v} Y5 E{v}", "g0 x{v}", "G91", "G1 E{v} ; add", "G90", "M83", "M82 ; note", "G92 E{v}", "M104 S200", "; only a note", "T1", "FOO 1", "G1 X-{v} Z3 X{v}", "M18", "G20", "M900 K0.{v}", "m105"]
_V = "round(abs(value), 2)"


def lines(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.format_string("%.2f", F.abs("value")).alias("v"))
    text = F.lit(None).cast("string")
    for i, c in enumerate(_CASES):
        text = F.when(F.col("event_id") % len(_CASES) == i, F.replace(F.lit(c), F.lit("{v}"), F.col("v"))).otherwise(text)
    return ev.select(F.col("user_id").alias("program"), F.col("event_id").alias("line"), text.alias("text"))


_TEXT = "CASE event_id % " + str(len(_CASES)) + " " + " ".join(f"WHEN {i} THEN replace('{c}', '{{v}}', printf('%.2f', abs(value)))" for i, c in enumerate(_CASES)) + " END"
_num = lambda a: f"TRY_CAST(list_extract(regexp_extract_all(body, '{a}([-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+))', 1), -1) AS DOUBLE)"
_MOVE = "command IN ('G0','G1','G2','G3')"
_SQL = f"""
WITH l AS (SELECT user_id AS program, event_id AS line, {_TEXT} AS text FROM events),
c AS (SELECT *, upper(trim(split_part(text, ';', 1))) AS full_body FROM l), b AS (SELECT *, regexp_replace(full_body, '^\\S*', '') AS body FROM c),
p AS (SELECT program, line, regexp_extract(full_body, '^(\\S*)', 1) AS command, body, {_num('X')} AS x, {_num('Y')} AS y, {_num('Z')} AS z, {_num('E')} AS e FROM b),
m AS (SELECT *, coalesce(last_value(CASE command WHEN 'G90' THEN true WHEN 'G91' THEN false END IGNORE NULLS) OVER w, true) AS absolute,
  coalesce(last_value(CASE WHEN command IN ('G90','M82') THEN true WHEN command IN ('G91','M83') THEN false END IGNORE NULLS) OVER w, true) AS e_absolute FROM p WINDOW w AS (PARTITION BY program ORDER BY line)),
s AS (SELECT *, CASE WHEN command = 'G92' AND e IS NOT NULL THEN e WHEN {_MOVE} AND e IS NOT NULL AND e_absolute THEN e END AS sets, CASE WHEN {_MOVE} AND e IS NOT NULL AND NOT e_absolute THEN e ELSE 0 END AS adds FROM m),
g AS (SELECT *, count(sets) OVER (PARTITION BY program ORDER BY line) AS grp FROM s),
a AS (SELECT *, coalesce(first_value(sets) OVER i, 0) + sum(adds) OVER i AS e_after FROM g WINDOW i AS (PARTITION BY program, grp ORDER BY line)),
x AS (SELECT *, coalesce(lag(e_after) OVER (PARTITION BY program ORDER BY line), 0) AS e_before FROM a)
"""


def _rows(spark, sf_dir):
    return gcode.with_extruder(gcode.with_modes(gcode.parse(lines(spark, sf_dir))))


@query(_SQL + "SELECT program, line, command, x, y, z, e FROM p")
def gcode_parse(spark, sf_dir):
    return gcode.parse(lines(spark, sf_dir)).select("program", "line", "command", "x", "y", "z", "e")


@query(_SQL + "SELECT program, line, list_extract(regexp_extract_all(body, 'K([-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+))', 1), -1)::DOUBLE AS k, len(list_distinct(regexp_extract_all(body, '([A-Z])[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)', 1))) AS n_words FROM p")
def gcode_words(spark, sf_dir):
    return gcode.parse(lines(spark, sf_dir)).select("program", "line", F.try_element_at("words", F.lit("K")).alias("k"), F.size("words").cast("long").alias("n_words"))


@query(_SQL + "SELECT program, line, absolute, e_absolute FROM m")
def modal_state(spark, sf_dir):
    return gcode.with_modes(gcode.parse(lines(spark, sf_dir))).select("program", "line", "absolute", "e_absolute")


@query(_SQL + "SELECT program, line, round(e_before, 4) + 0.0 AS e_before, round(e_after, 4) + 0.0 AS e_after FROM x")
def reset_sum(spark, sf_dir):
    return _rows(spark, sf_dir).select("program", "line", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("e_before", "e_after")])


@query(_SQL + f"SELECT program, count(*) AS lines, count(*) FILTER (command <> '') AS commands, count(*) FILTER ({_MOVE}) AS moves, count(*) FILTER ({_MOVE} AND e IS NOT NULL AND e_after > e_before + 1e-9) AS extrusions, count(*) FILTER (command IN ('M104','M109','M140','M190')) AS heating FROM x GROUP BY program")
def gcode_stats(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("e_before", F.col("e_before") + 1e-9)
    return gcode.stats(rows)


_ODD = "command <> '' AND command NOT IN (" + ", ".join(f"'{c}'" for c in gcode.KNOWN) + ") AND NOT regexp_full_match(command, 'T[0-9]+')"


@query(_SQL + f"SELECT * FROM (SELECT program, command, min(line) AS line FROM p WHERE {_ODD} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY program ORDER BY command) <= 12")
def unknown_commands(spark, sf_dir):
    return gcode.unknown_commands(_rows(spark, sf_dir))


_OUT = " UNION ALL ".join(f"SELECT program, 'error' AS severity, 'out_of_range_{a}' AS code, line FROM x WHERE {_MOVE} AND absolute AND NOT {a} BETWEEN 0 AND {hi}" for a, hi in (("x", 100), ("y", 4)))
_NONE = " UNION ALL ".join(f"SELECT program, 'error', 'no_{c}', NULL FROM x GROUP BY program HAVING count(*) FILTER ({f}) = 0" for c, f in (("commands", "command <> ''"), ("moves", _MOVE), ("extrusions", f"{_MOVE} AND e IS NOT NULL AND e_after > e_before"), ("heating", "command IN ('M104','M109','M140','M190')")))


@query(_SQL + f"{_OUT} UNION ALL SELECT program, 'warning', 'relative_positioning', min(line) FROM x WHERE command = 'G91' GROUP BY program UNION ALL {_NONE} UNION ALL SELECT program, 'warning', 'unknown_command', min(line) FROM p WHERE {_ODD} GROUP BY program, command UNION ALL SELECT -1, 'error', 'empty_program', NULL")
def gcode_findings(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    programs = rows.select("program").unionByName(spark.createDataFrame([(-1,)], "program long"))
    return gcode.findings(rows, {"x": (0.0, 100.0), "y": (0.0, 4.0)}, programs)
