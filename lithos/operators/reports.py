"""Small operators on findings, trees, samples and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import checkpointed
from .prefix import running_totals


def bounded_findings(findings: DataFrame, by: str, order: list[str], most: int = 256) -> DataFrame:
    """The first ``most`` distinct findings of each subject, with ``truncated``: whether there were more. A report."""
    distinct = findings.dropDuplicates()
    top = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
    return top.join(distinct.groupBy(by).agg((F.count("*") > most).alias("truncated")), by)


def append_unique(rows: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """``(key, items)``: the items of each key once, in the order first seen."""
    first = rows.groupBy(key, item).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", item))), lambda x: x[item]).alias("items"))


def stride_sample(rows: DataFrame, at: str, most: int) -> DataFrame:
    """Every k-th row by its number, k the least that leaves ``most`` rows or fewer."""
    n = rows.count()
    return rows.filter(F.col(at) % max(1, -(-n // most)) == 0)


def area_sample(faces: DataFrame, face: str, area: str, draws: int, seed: int = 0) -> DataFrame:
    """``(draw, face)``: faces drawn with replacement, by area: the same ones for a seed, however rows are dealt.

    Each draw is a number from a hash of seed and draw; the face is the one in
    whose span of the running areas it lies, found by merging both in order.
    """
    spans = running_totals(faces.select(F.col(face).alias("_f"), F.col(area).cast("double").alias("_w")).filter("_w > 0"), ["_f"], {"_from": "_w"})
    total = spans.agg(F.sum("_w")).first()[0]
    if not total:
        return faces.sparkSession.createDataFrame([], f"draw long, {face} {faces.schema[face].dataType.simpleString()}")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) / float(1 << 52) * total
    picks = faces.sparkSession.range(draws).select(F.col("id").alias("draw"), u.alias("_from"))
    both = spans.select("_from", F.lit(None).cast("long").alias("draw"), "_f").unionByName(picks.withColumn("_f", F.lit(None).cast(faces.schema[face].dataType)))
    # the face of a draw: the last before it, carried over range partitions
    parts = checkpointed(both.repartitionByRange("_from").withColumn("_p", F.spark_partition_id()))
    ends = parts.filter("draw is null").groupBy("_p").agg(F.max_by("_f", F.struct("_from", "_f")).alias("_end"))
    carry = parts.select("_p").distinct().join(ends, "_p", "left").withColumn("_carry", F.last("_end", True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    inside = F.last("_f", True).over(Window.partitionBy("_p").orderBy("_from", F.col("draw").isNotNull(), "_f").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_in", inside).join(F.broadcast(carry.select("_p", "_carry")), "_p").filter("draw is not null").select("draw", F.coalesce("_in", "_carry").alias(face))


def clashes(pairs: DataFrame, most: int | None = None, tol: float = 1e-6) -> DataFrame:
    """Pairs ``(a, b, volume)`` that clash: of the first ``most`` pairs by (a, b), those of over ``tol`` of volume, largest first."""
    tried = pairs.orderBy("a", "b").limit(most) if most else pairs
    return tried.filter(F.col("volume") > tol).orderBy(F.desc("volume"), "a", "b")


def units_suspect(lo: Column, hi: Column, least: float = 1.0) -> Column:
    """Whether a body's diagonal is below ``least``: metres or inches taken for millimetres."""
    return F.sqrt(F.aggregate(F.zip_with(lo, hi, lambda a, b: (b - a) * (b - a)), F.lit(0.0), lambda s, x: s + x)) < least


def render_cost(parts: DataFrame, key: str, triangles: int = 1_000_000, size: int = 160 << 20) -> DataFrame:
    """Triangles (of the index or the sum of parts, the larger), bytes, and whether that is a large mesh."""
    out = parts.groupBy(key).agg(F.greatest(F.max("index_triangles"), F.sum("triangles")).alias("triangles"), F.sum("bytes").alias("bytes"))
    return out.withColumn("large", (F.col("triangles") >= triangles) | (F.col("bytes") >= size))


def tree_digest(files: DataFrame, key: str) -> DataFrame:
    """``(key, digest)``: SHA-256 over path, mode, size and hash of each file, by path; files are hashed in runs of 4,096."""
    from .topology import table_digest

    order = Window.partitionBy(key).orderBy("path")
    numbered = files.withColumn("_n", F.row_number().over(order))
    return table_digest(numbered, key, F.concat_ws("\t", "path", "mode", "size", "sha256"), "_n")


def solid_verdicts(solids: DataFrame, key: str) -> DataFrame:
    """``(key, solids, invalid, reasons, ok)``: what is wrong with the solids of each model; an unknown answer is no fault."""
    found = F.array_compact(F.array(
        F.when(~F.col("valid"), "invalid_topology"), F.when(F.col("volume") <= 0, "non_positive_volume"), F.when(~F.col("closed"), "open_shell"), F.when(F.col("self_intersecting"), "self_intersecting"),
    ))
    rows = solids.withColumn("_r", found)
    out = rows.groupBy(key).agg(F.count("solid").alias("solids"), F.count(F.when(F.size("_r") > 0, 1)).alias("invalid"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_r")))).alias("reasons"))
    out = out.withColumn("reasons", F.when(F.col("solids") == 0, F.array(F.lit("no_solid"))).otherwise(F.col("reasons")))
    return out.withColumn("ok", F.size("reasons") == 0)


def close(a: Column, b: Column, rel: float = 1e-12, absolute: float = 0.0) -> Column:
    """Whether two numbers agree within the larger of both tolerances; null if either is."""
    return (a == b) | (F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)))


def freshness(artifacts: DataFrame, schema: int) -> DataFrame:
    """Adds code: the first reason why an artifact is stale, null if it is fresh."""
    code = (
        F.when(F.col("path").isNull(), "missing_artifact").when(F.col("schema_version") != schema, "schema_mismatch").when(F.col("kind") != F.col("wanted_kind"), "kind_mismatch")
        .when(F.col("source_path") != F.col("wanted_path"), "path_mismatch").when(F.col("source_hash").isNull(), "missing_hash").when(F.col("source_hash") != F.col("wanted_hash"), "hash_mismatch")
    )
    return artifacts.withColumn("code", code)


def downstream(edges: DataFrame, stale: DataFrame) -> DataFrame:
    """``(node)``: what must be rebuilt: the stale nodes and all that depend on them, by edges ``(source, target)``; a round a level."""
    front = seen = checkpointed(stale.select("node").distinct())
    while not front.isEmpty():
        step = edges.join(front.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node")).distinct()
        front = checkpointed(step.join(seen, "node", "left_anti"))
        seen = checkpointed(seen.unionByName(front))
    return seen


def tree_search(nodes: DataFrame, ids: str, text: Column, query: str) -> DataFrame:
    """Nodes of dotted ids whose text holds the query in either case, or that have such a node below them; ``matched`` tells which.

    The matches name their ancestors by the prefixes of their own ids, so
    there is one join and no walk.
    """
    hit = nodes.filter(F.contains(F.lower(text), F.lit(query.lower()))).select(F.col(ids).alias("_id"))
    parts = F.split("_id", r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    keep = hit.select(F.posexplode(heads).alias("_n", "_head"), F.size(parts).alias("_of")).groupBy("_head").agg(F.max(F.col("_n") + 1 == F.col("_of")).alias("matched"))
    return nodes.join(keep.withColumnRenamed("_head", ids), ids)


def visible_rows(nodes: DataFrame, ids: str, expanded: DataFrame) -> DataFrame:
    """``(id, depth, row)`` of the nodes of which all ancestors are expanded, in the order of the tree (numbers by value)."""
    parts = F.split(ids, r"\.")
    heads = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))
    each = nodes.select(ids, F.explode_outer(heads).alias("_up"))
    closed = each.filter("_up is not null").join(expanded.select(F.col(ids).alias("_up")), "_up", "left_anti").select(ids).distinct()
    path = F.transform(F.split(F.regexp_replace(ids, "^[a-z]+", ""), r"\."), lambda x: x.cast("int"))
    shown = nodes.join(closed, ids, "left_anti").select(ids, (F.size(parts) - 1).alias("depth"), path.alias("_path"))
    return running_totals(shown.withColumn("_one", F.lit(1)), ["_path"], {"row": "_one"}).drop("_path", "_one")


def breadcrumb(ids: Column) -> Column:
    """The dotted ids from the root to a node."""
    parts = F.split(ids, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def leaves_below(nodes: DataFrame, ids: str) -> DataFrame:
    """``(id, leaves)``: leaf descendants of every node, itself if it is one: leaves count at each of their prefixes."""
    inner = nodes.select(F.regexp_replace(ids, r"\.[^.]*$", "").alias(ids), F.col(ids).alias("_c")).filter(F.col(ids) != F.col("_c")).select(ids).distinct()
    leaves = nodes.join(inner, ids, "left_anti").select(F.explode(breadcrumb(F.col(ids))).alias(ids))
    return nodes.select(ids).join(leaves.groupBy(ids).agg(F.count("*").alias("leaves")), ids, "left").na.fill(0, ["leaves"])


def throttled(events: DataFrame, key: str, at: str, phase: str, interval: float) -> DataFrame:
    """Progress events that are shown: the first of each phase of a run, and those in a new slot of ``interval`` seconds within it."""
    slot = F.floor(F.col(at).cast("double") / interval)
    w = Window.partitionBy(key, phase, slot).orderBy(at)
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def json_report(rows: DataFrame, *cols: str) -> DataFrame:
    """One JSON text a row with sorted keys and without white space; a number that is not finite raises."""
    names = sorted(cols or rows.columns)
    checked = []
    for n in names:
        c = F.col(n)
        if rows.schema[n].dataType.typeName() in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{n} is not finite")).cast("double")).otherwise(c)
        checked.append(c.alias(n))
    return rows.select(F.to_json(F.struct(*checked), {"ignoreNullFields": "false"}).alias("report"))
