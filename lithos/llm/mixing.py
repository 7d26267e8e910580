"""Mixing sources to target weights with hash-random order and exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import fresh, materialize
from .quality import words

#: Fixed values of the production mix: weights of the sources in order, repeating; words to take by all words; epochs at most.
WEIGHTS, TOTAL, EPOCHS = (3, 1, 2), 1.5, 2
SLICE, SMALL = 10_000, 10_000


def capped_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS) -> DataFrame:
    """``(source, source_size, rows, target)`` from ``(source, source_size, rows)``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``total`` times all words. No target passes ``epochs`` times its source;
    what is above goes to the others by weight. The sources that end at
    their cap are those of least cap by weight: with sources in that order,
    source i is capped if and only if its cap is at most its share of what
    the sources before it leave.
    """
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    mix = ranked.withColumn("_w", pick).withColumn("_cap", epochs * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    mix = mix.withColumn("_all", total * F.sum("source_size").over(Window.partitionBy()))
    mix = mix.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), zero))
    mix = mix.withColumn("_weights", F.sum("_w").over(Window.partitionBy()) - F.coalesce(F.sum("_w").over(before), zero))
    level = F.col("_left") / F.col("_weights")
    mix = mix.withColumn("_open", F.col("_cap") > F.col("_w") * level)
    # the first open source in this order fixes the level of all that follow
    first = F.first(F.when(F.col("_open"), level), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mix = mix.withColumn("_level", first)
    target = F.when(F.col("_open"), F.col("_w") * F.col("_level")).otherwise(F.col("_cap"))
    return mix.select("source", "source_size", "rows", target.cast("double").alias("target"))


def order_key(id_col: Column, size: Column, seed: str) -> Column:
    """The random key of a row: hex digest of the seed, the id and the size."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), size.cast("string")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS, seed: str = "mix-1") -> DataFrame:
    """``(doc_id, key, source, size, source_size, target, taken)``, a row for each row of ``docs``.

    Each source is in the order of its rows' hash keys, ties by doc_id, and
    is read from the start, again and again, until its target's whole words
    are taken; the last row may be taken in part. So a row is taken whole
    once for each full epoch, and once more if it ends before the cut.

    The keys are uniform, so equal intervals of them are slices of about
    10,000 rows of a source; their word counts, added up in order, tell
    where each slice starts. Only the slice of the cut is sorted; every other
    row knows from its slice whether it is before or after. A null text has
    no words; null sources are one source; repeated rows count each; an empty
    table gives no row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(text).alias("page"))
    rows = materialize(rows.select("doc_id", "source", "size", order_key(F.col("doc_id"), F.col("size"), seed).alias("key"), "page"), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = materialize(capped_targets(sizes, weights, total, epochs).withColumn("slices", F.ceil(F.col("rows") / SLICE)), "targets")
    safe_size = F.greatest("source_size", F.lit(1))
    budget = F.floor("target").cast("long")
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "slices", F.floor(budget / safe_size).cast("long").alias("full"), (budget % safe_size).alias("rest"))
    small = plan.count() <= SMALL
    joined = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    joined = joined.withColumn("slice", F.floor(unit * F.col("slices")).cast("long"))
    sums = joined.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0).cast("long")))
    cuts = sums.filter("before <= rest and rest < before + words").select(F.col("source").alias("s"), F.col("slice").alias("cut"), "before")
    cuts = materialize(cuts, "cuts")
    cuts = F.broadcast(cuts) if small else cuts
    placed = joined.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    once = F.when(F.col("slice") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long"))
    away = placed.filter("cut is null or slice <> cut").withColumn("part", once)
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "page").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.filter("slice = cut").withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    at = at.withColumn("part", F.least("size", F.greatest(F.col("rest") - F.col("start"), F.lit(0).cast("long")))).drop("start")
    both = away.unionByName(at)
    taken = (F.col("full") * F.col("size") + F.col("part")).cast("long")
    return both.select("doc_id", "key", "source", "size", "source_size", "target", taken.alias("taken"), "page")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of ``docs``, with epoch (from 0) and taken, the words of the text to read, all or the first ones.

    Rows of which no word is taken go. Rows that agree in id, source and
    text get the shares of any of them in the order of a hash of all their
    columns (but maps), so that reruns agree. An empty table stays empty; a long
    text is read once for its words.
    """
    epoch, taken, nth, size = (fresh(docs, c) for c in ("epoch", "taken", "_nth", "_size"))
    ident = [F.col(id_col), F.col(source_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shares = mix(docs, id_col, text_col, source_col)
    key = fresh(docs, "_key")
    shares = shares.filter("taken > 0").select(F.xxhash64("doc_id", "source", "page").alias(key), F.col("taken").alias(taken), F.col("size").alias(size))
    shares = shares.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.col(taken).desc())))
    keyed = docs.withColumn(key, F.xxhash64(*ident, F.xxhash64(text)))
    repeated = shares.filter(F.col(nth) > 1)
    if repeated.isEmpty():
        rows = keyed.join(shares.drop(nth), key)
    else:
        numbered = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]))))
        rows = numbered.join(shares, [key, nth])
    steps = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(taken) / F.col(size)).cast("long") - 1)
    out = rows.withColumn(epoch, F.explode(steps))
    left = F.least(F.col(size), F.col(taken) - F.col(epoch) * F.col(size))
    return out.select(*docs.columns, epoch, left.cast("long").alias(taken))
