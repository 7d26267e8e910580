"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import fresh, materialize

#: Share of a host's pages from which a line is boilerplate, and the pages it takes at least.
RATIO, LEAST, SMALL = 0.05, 10, 100_000
#: For the pipeline: characters from which a line is a passage, and the share of a host's pages from which that is boilerplate.
LONG, LONG_RATIO = 40, 0.01
#: A run of blanks within a line that is not a single space.
_odd = r"\x20*[\t\x0B\f\r][\x20\t\x0B\f\r]*|\x20{2,}"


def plain_lines(text: Column) -> Column:
    """The lines of a text for comparison: lower case, runs of ASCII blanks one space, none at the ends; empty ones stay.

    The text is normalised as a whole before it is split, and only runs that
    differ from a single space are touched.
    """
    return F.transform(F.split(F.regexp_replace(F.lower(text), _odd, " "), "\n", -1), lambda line: F.trim(line))


def line_hashes(text: Column, long: int | None = None) -> Column:
    """A hash for each line of a text; null for a line without a word. With ``long``, the lowest bit tells lines of as many characters."""

    def key(line: Column) -> Column:
        h = F.xxhash64(line)
        return h if long is None else h.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR((F.length(line) >= long).cast("long"))

    return F.transform(plain_lines(text), lambda line: F.when(line != "", key(line)))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST, long: int | None = None, long_ratio: float = LONG_RATIO) -> DataFrame:
    """``(host, line)``: hashes of the lines on over ``ratio`` of a host's pages, and on ``least`` pages.

    Pages are counted by their texts: copies of a page are one page, or a
    much copied page would turn into boilerplate as a whole. Null hosts are
    one host; null texts are empty pages and count as one page. With
    ``long``, lines of as many characters go from ``long_ratio`` on.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.array_compact(F.array_distinct(line_hashes(text, long)))
    # a line of each page stands for the page itself in the totals
    pages = docs.select(F.col(host_col).alias("host"), F.xxhash64(text, F.length(text)).alias("page"), F.explode(F.concat(lines, F.array(F.lit(None).cast("long")))).alias("line"))
    counts = pages.distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = materialize(counts.filter((F.col("n") >= least) | F.col("line").isNull()), "lines")
    totals = counts.filter("line is null").select(F.col("host").alias("h"), F.col("n").alias("total"))
    often = counts.filter("line is not null").join(totals, F.col("host").eqNullSafe(F.col("h")))
    share = F.lit(ratio) if long is None else F.when(F.col("line").bitwiseAND(F.lit(1).cast("long")) == 1, long_ratio).otherwise(ratio)
    return often.filter(F.col("n") > share * F.col("total")).select("host", "line", "n", "total")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", chars_col: str | None = "n_chars", ratio: float = RATIO, least: int = LEAST, extra: bool = False, long: int | None = None, long_ratio: float = LONG_RATIO) -> DataFrame:
    """``docs`` with boilerplate lines (see ``boilerplate``) dropped from the texts.

    All rows and columns stay; unchanged texts stay as they are, with their
    blank lines; chars_col, if the table has it, holds the new number of
    characters of changed texts. A host has at most its lines a page divided
    by the least ratio such lines, so they are one array a host, joined once; the
    table of hosts is broadcast only if it has 100,000 lines at most. With
    ``extra``, the columns n_lines and n_dropped (lines with a word) follow.

    An empty table stays empty; a long text costs time for its lines times the
    common lines of its host that it holds.
    """
    found = materialize(boilerplate(docs, host_col, text_col, ratio, least, long, long_ratio), "boilerplate")
    host, drop = fresh(docs, "_host"), fresh(docs, "_drop")
    by_host = found.groupBy(F.col("host").alias(host)).agg(F.collect_list("line").alias(drop))
    if found.count() <= SMALL:
        by_host = F.broadcast(by_host)
    rows = docs.join(by_host, docs[host_col].eqNullSafe(by_host[host]), "left")
    safe = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    done = fresh(docs, "_done")

    def judged(z: Column) -> Column:
        kept = F.filter(z, lambda x: ~F.coalesce(F.array_contains(drop, x["h"]), F.lit(False)))
        return F.struct(F.size(z).alias("n"), F.size(F.filter(z, lambda x: x["h"].isNotNull())).alias("worded"), F.size(kept).alias("left"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))

    pairs = F.arrays_zip(F.split(safe, "\n", -1).alias("line"), line_hashes(safe, long).alias("h"))
    found = F.transform(F.array(pairs), judged)[0]
    rows = rows.withColumn(done, found if extra else F.when(F.col(drop).isNotNull(), found))
    touched = F.coalesce(F.col(done)["left"] < F.col(done)["n"], F.lit(False))
    new = {text_col: F.when(touched, F.col(done)["text"]).otherwise(F.col(text_col))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(touched, F.length(F.col(done)["text"])).otherwise(F.col(chars_col))
    cols = [new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in docs.columns]
    if extra:
        cols += [F.col(done)["worded"].cast("long").alias("n_lines"), (F.col(done)["n"] - F.col(done)["left"]).cast("long").alias("n_dropped")]
    return rows.select(*cols)
