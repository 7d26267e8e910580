"""Quality rules: counts within a text, and the frequency of lines across documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import fresh, materialize
from .line_dedup import plain_lines

BLANK = r"[\x20\x09-\x0D]+"
#: A line is common beyond this share of a host's documents and this many; a document is depleted below this share of its words.
SHARE, LEAST, REST, SMALL = 0.1, 20, 0.3, 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK, -1), "")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value computed once, not at each use."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words of ``w`` that lie in a 3-word window found at least twice.

    Windows are compared by 64-bit hash, sorted with their places, so the
    cost is n log n and no text is quadratic.
    """
    n = F.size(w)
    rest = F.greatest(n - 2, F.lit(0))
    hashes = F.transform(F.arrays_zip(F.slice(w, 1, rest).alias("a"), F.slice(w, 2, rest).alias("b"), F.slice(w, 3, rest).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
        twice = let(ranked, lambda s: F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(n >= 4, found).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of each distinct normalised line."""
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    own = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    lines = let(
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.transform(F.filter(plain_lines(text), lambda line: line != ""), lambda line: F.struct(F.xxhash64(line).alias("line"), (F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1).alias("n"))).alias("lines"),
        ),
    )
    return F.struct(own.alias("own"), symbols.cast("long").alias("n_symbols"), lines.alias("by_line"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least: int = LEAST, rest: float = REST) -> DataFrame:
    """A row for each row of ``docs``: doc_id, the measures, base_failed, n_common_words, kept; and key, a hash of the row's id, host and text.

    A normalised line is common on a host if more than ``share`` of its
    documents, and ``least`` documents, have it; documents are counted by
    text, so copies count once and no text becomes common by being copied. A
    document whose other lines hold under ``rest`` of its words is depleted.
    kept: neither base_failed nor depleted. A null text has no words, and
    fails; null hosts are one host; repeated rows get the same verdict each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(F.col(id_col), F.col(host_col), text).alias("key"), F.xxhash64(text, F.length(text)).alias("page"), text.alias("text"))
    wide = rows.select("doc_id", "host", "key", "page", measures(F.col("text")).alias("m"))
    wide = wide.select("doc_id", "host", "key", "page", "m.own.*", "m.n_symbols", "m.by_line.*")
    wide = materialize(wide, "measures")
    lines = wide.filter("n_words > 0").select("host", "key", "page", "n_words", F.explode("lines").alias("x")).select("host", "key", "page", "n_words", "x.line", "x.n")
    pages = wide.select("host", "page", F.explode(F.concat(F.transform("lines", lambda x: x["line"]), F.array(F.lit(None).cast("long")))).alias("line"))
    counts = pages.distinct().groupBy("host", "line").agg(F.count("*").alias("docs"))
    counts = materialize(counts.filter((F.col("docs") >= least) | F.col("line").isNull()), "counts")
    totals = counts.filter("line is null").select(F.col("host").alias("th"), F.col("docs").alias("total"))
    common = counts.filter("line is not null").join(totals, F.col("host").eqNullSafe(F.col("th"))).filter(F.col("docs") > share * F.col("total")).select(F.col("host").alias("ch"), F.col("line").alias("cl"))
    common = materialize(common, "common")
    if common.count() <= SMALL:
        common = F.broadcast(common)
    # repeated rows share a key and add up alike above and below the line of the ratio
    gone = lines.join(common, (F.col("line") == F.col("cl")) & F.col("host").eqNullSafe(F.col("ch"))).groupBy("key").agg(F.sum("n").alias("gone"), F.sum("n_words").alias("_"))
    copies = wide.groupBy("key").agg(F.count("*").alias("copies"))
    gone = gone.join(copies, "key").select("key", (F.col("gone") / F.col("copies")).cast("long").alias("n_common_words"))
    judged = wide.drop("lines", "page", "host").join(gone, "key", "left").withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_common_words")) < rest * F.col("n_words")
    return judged.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all columns.

    All columns stay, whatever their names; an empty table stays empty.
    """
    key = fresh(docs, "_key")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bad = judge(docs, id_col, text_col, host_col).filter(~F.col("kept")).select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(host_col), text))
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
