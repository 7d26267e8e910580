"""Point files: XYZ-like text and ASCII PLY, with each point's ordinal in its file; and the XYZ writer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strict_double
from ..operators.cloud import canonical

#: The scalar types of PLY, and the bounds of the whole-number ones.
FLOATS = {"float", "double", "float32", "float64"}
INTS = {"char": (-128, 127), "int8": (-128, 127), "uchar": (0, 255), "uint8": (0, 255), "short": (-32768, 32767), "int16": (-32768, 32767), "ushort": (0, 65535), "uint16": (0, 65535), "int": (-(2**31), 2**31 - 1), "int32": (-(2**31), 2**31 - 1), "uint": (0, 2**32 - 1), "uint32": (0, 2**32 - 1)}


def detect(path: str, head: str = "") -> str:
    """By suffix, then by the first line; else xyz."""
    name = path.lower()
    if name.endswith(".ply"):
        return "ply"
    if name.endswith((".xyz", ".csv", ".asc", ".pts", ".txt")):
        return "xyz"
    return "ply" if head.split("\n", 1)[0].strip() == "ply" else "xyz"


def read_xyz(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """``(file, idx, x, y, z)``: a point a line, fields split by commas or blanks, the first three read.

    Blank lines and those that start with ``#``, ``//`` or ``;`` are no
    points; a line that is none of these and no point is an error. idx
    counts the points of a file, which is read as one row, so that order
    does not depend on how files are split.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = files.select("file", F.slice(F.split("value", r"\r?\n"), skip + 1, 2**31 - 1 - skip).alias("lines"))
    kept = F.filter(F.transform("lines", lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(r"^(?:#|//|;)"))
    rows = lines.select("file", F.posexplode(kept).alias("idx", "line"))
    parts = F.split(F.trim(F.col("line")), r"\s*,\s*|\s+")
    point = [strict_double(F.get(parts, i)) for i in range(3)]
    bad = F.raise_error(F.concat(F.lit("not a point: "), "file", F.lit(" point "), F.col("idx").cast("string"))).cast("double")
    return rows.select("file", F.col("idx").cast("long").alias("idx"), *[F.coalesce(p, bad).alias(c) for p, c in zip(point, "xyz", strict=True)])


def parse_ply(text: str) -> list[tuple[float, float, float]]:
    """The vertices of an ASCII PLY text; ValueError for anything that is not one to the letter."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "ply" or len(lines) < 3 or lines[1].split() != ["format", "ascii", "1.0"]:
        raise ValueError("no ASCII PLY")
    elements: list[tuple[str, int, list[tuple[str, ...]]]] = []
    at = 2
    for at, line in enumerate(lines[2:], 2):
        words = line.split()
        if words == ["end_header"]:
            break
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "element" and len(words) == 3 and words[2].isdigit():
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property" and elements and (len(words) == 3 and words[1] in FLOATS | set(INTS) or len(words) == 5 and words[1] == "list" and words[2] in INTS and words[3] in FLOATS | set(INTS)):
            elements[-1][2].append(tuple(words[1:]))
        else:
            raise ValueError(f"bad PLY header line {at + 1}")
    else:
        raise ValueError("PLY header has no end")
    if not elements or elements[0][0] != "vertex" or any(p[0] == "list" for p in elements[0][2]):
        raise ValueError("PLY must start with vertices of scalars")
    names = [p[-1] for p in elements[0][2]]
    if len(set(names)) != len(names) or not {"x", "y", "z"} <= set(names):
        raise ValueError("PLY vertices need x, y and z once")

    def scalar(kind: str, word: str) -> float:
        if kind in FLOATS:
            n = float(word)
            if n != n or abs(n) == float("inf"):
                raise ValueError("PLY number is not finite")
            return n
        n = int(word)
        if not INTS[kind][0] <= n <= INTS[kind][1]:
            raise ValueError("PLY number out of range")
        return n

    body = iter([x for x in lines[at + 1 :] if x.strip()])
    points = []
    for name, count, props in elements:
        for _ in range(count):
            words = next(body, "").split()
            i, values = 0, {}
            for p in props:
                if i >= len(words):
                    raise ValueError("PLY record is short")
                if p[0] == "list":
                    n = int(scalar(p[1], words[i]))
                    [scalar(p[2], w) for w in words[i + 1 : i + 1 + n]]
                    i += n + 1
                else:
                    values[p[1]] = scalar(p[0], words[i])
                    i += 1
            if i != len(words):
                raise ValueError("PLY record does not fit its properties")
            if name == "vertex":
                points.append((float(values["x"]), float(values["y"]), float(values["z"])))
    if next(body, None) is not None:
        raise ValueError("data behind the last PLY record")
    return points


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """``(file, idx, x, y, z)`` of ASCII PLY files; one file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"], strict=True):
                points = parse_ply(text)
                yield pd.DataFrame({"file": file, "idx": range(len(points)), **{c: [p[i] for p in points] for i, c in enumerate("xyz")}})

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.mapInPandas(run, "file string, idx long, x double, y double, z double")


def source_identity(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of files: compare before and after a scan to see that they stayed."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_xyz(points: DataFrame, path: str) -> None:
    """Canonical lines in the order of idx, as text files whose names sort in that order; an existing path is an error."""
    lines = points.repartitionByRange("idx").sortWithinPartitions("idx").select(F.concat_ws(" ", canonical("x"), canonical("y"), canonical("z")).alias("value"))
    lines.write.mode("errorifexists").text(path)
