"""Structured Streaming forms of the windowed counts and of the modal interpretation of programs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """``(start, event_type, n, total)`` of tables and streams; a stream drops events later than ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    counts = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def modes(lines: DataFrame) -> DataFrame:
    """``(program, line, absolute, e_absolute)`` of a stream of ``(program, line, command)``, in order within a program.

    The state of a program is its two modes, kept from batch to batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        both, own = state.get if state.exists else (True, True)
        rows = pd.concat(list(batches)).sort_values("line")
        out = []
        for line, command in zip(rows["line"], rows["command"], strict=True):
            both = {"G90": True, "G91": False}.get(command, both)
            own = {"G90": True, "M82": True, "G91": False, "M83": False}.get(command, own)
            out.append((key[0], line, both, own))
        state.update((bool(both), bool(own)))
        yield pd.DataFrame(out, columns=["program", "line", "absolute", "e_absolute"])

    return lines.groupBy("program").applyInPandasWithState(step, "program long, line long, absolute boolean, e_absolute boolean", "absolute boolean, e_absolute boolean", "append", "NoTimeout")
