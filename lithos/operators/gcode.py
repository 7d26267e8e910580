"""Machine programs: lines ``(program, line, text)`` to commands, with the modes that hold at each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The commands that count as moves and as heating, those that are known, and the form of a word: a letter and a decimal number.
MOVES = ["G0", "G1", "G2", "G3"]
HEATING = ["M104", "M109", "M140", "M190"]
KNOWN = """G0 G1 G2 G3 G4 G21 G28 G29 G90 G91 G92 M18 M73 M82 M83 M84 M104 M106 M107 M109 M117 M118
M140 M190 M201 M203 M204 M205 M220 M221 M400 M500 M501 M900""".split()
WORD = r"([A-Z])([-+]?(?:\d+(?:\.\d*)?|\.\d+))"


def words(body: Column) -> Column:
    """Letter to number, of repeated letters the last."""
    letters, numbers = F.regexp_extract_all(body, F.lit(WORD), 1), F.regexp_extract_all(body, F.lit(WORD), 2)
    names = F.array_distinct(letters)
    last = F.transform(names, lambda n: F.element_at(numbers, (F.size(letters) + 1 - F.array_position(F.reverse(letters), n)).cast("int")).cast("double"))
    return F.map_from_arrays(names, last)


def parse(lines: DataFrame) -> DataFrame:
    """Adds command (upper case, empty for a comment), words (letter to number, behind the command) and those of X, Y, Z, E."""
    body = F.upper(F.trim(F.substring_index("text", ";", 1)))
    out = lines.withColumn("command", F.regexp_extract(body, r"^(\S*)", 1))
    out = out.withColumn("words", words(F.regexp_replace(body, r"^\S*", "")))
    for axis in "XYZE":
        out = out.withColumn(axis.lower(), F.try_element_at("words", F.lit(axis)))
    return out


def with_modes(commands: DataFrame) -> DataFrame:
    """Adds absolute and e_absolute, in force behind each line; G90 and G91 set both, M82 and M83 the extruder only."""
    w = Window.partitionBy("program").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(True))
    c = F.col("command")
    return commands.withColumn("absolute", last(F.when(c == "G90", True).when(c == "G91", False))).withColumn("e_absolute", last(F.when(c.isin("G90", "M82"), True).when(c.isin("G91", "M83"), False)))


def with_extruder(rows: DataFrame) -> DataFrame:
    """Adds e_before and e_after. Absolute moves and G92 set the position; relative moves add to the last that was set."""
    c, move = F.col("command"), F.col("command").isin(MOVES) & F.col("e").isNotNull()
    sets = F.when((c == "G92") & F.col("e").isNotNull(), F.col("e")).when(move & F.col("e_absolute"), F.col("e"))
    w = Window.partitionBy("program").orderBy("line")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_set", sets).withColumn("_add", F.when(move & ~F.col("e_absolute"), F.col("e")).otherwise(0.0))
    marked = marked.withColumn("_group", F.count("_set").over(run))
    inside = Window.partitionBy("program", "_group").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.coalesce(F.first("_set").over(inside), F.lit(0.0)) + F.sum("_add").over(inside)
    return marked.withColumn("e_after", after).withColumn("e_before", F.coalesce(F.lag("e_after").over(w), F.lit(0.0))).drop("_set", "_add", "_group")


def stats(rows: DataFrame) -> DataFrame:
    """Counts by program of lines, commands, moves, extrusions and heating."""
    move = F.col("command").isin(MOVES)
    n = lambda c: F.count_if(c).cast("long")
    return rows.groupBy("program").agg(
        F.count("*").alias("lines"), n(F.col("command") != "").alias("commands"), n(move).alias("moves"),
        n(move & F.col("e").isNotNull() & (F.col("e_after") > F.col("e_before"))).alias("extrusions"), n(F.col("command").isin(HEATING)).alias("heating"),
    )


def known(command: Column) -> Column:
    return command.isin(KNOWN) | command.rlike(r"^T\d+$") | (command == "")


def unknown_commands(rows: DataFrame, k: int = 12) -> DataFrame:
    """The first line of each unknown command; k of them a program, by name: a report."""
    first = rows.filter(~known(F.col("command"))).groupBy("program", "command").agg(F.min("line").alias("line"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("program").orderBy("command"))).filter(F.col("_n") <= k).drop("_n")


def findings(rows: DataFrame, bounds: dict[str, tuple[float, float]], programs: DataFrame | None = None) -> DataFrame:
    """``(program, severity, code, line)``: moves out of bounds while absolute, relative mode, missing kinds of commands, unknown commands; of ``programs``, those without a line are empty."""
    move = F.col("command").isin(MOVES) & F.col("absolute")
    out = [F.when(move & ~F.col(a).between(lo, hi), F.lit(f"out_of_range_{a}")) for a, (lo, hi) in bounds.items()]
    far = rows.select("program", F.lit("error").alias("severity"), F.explode(F.array_compact(F.array(*out))).alias("code"), "line")
    rel = rows.filter("command = 'G91'").groupBy("program").agg(F.min("line").alias("line")).select("program", F.lit("warning").alias("severity"), F.lit("relative_positioning").alias("code"), "line")
    none = stats(rows).select("program", F.lit("error").alias("severity"), F.explode(F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(f"no_{c}")) for c in ("commands", "moves", "extrusions", "heating")]))).alias("code"), F.lit(None).cast("long").alias("line"))
    odd = unknown_commands(rows).select("program", F.lit("warning").alias("severity"), F.lit("unknown_command").alias("code"), "line")
    out = far.unionByName(rel).unionByName(none).unionByName(odd)
    if programs is None:
        return out
    empty = programs.select("program").distinct().join(rows.select("program").distinct(), "program", "left_anti")
    return out.unionByName(empty.select("program", F.lit("error").alias("severity"), F.lit("empty_program").alias("code"), F.lit(None).cast("long").alias("line")))
