"""Queries over catalogs, texts, findings and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import router
from ..functions import text as tx
from ..registry import query, table


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 13, 20) AND p_brand <> 'x' AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'a') AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), '1')")
def facet_search(spark, sf_dir):
    """Any value within a facet, all facets, and every word of the query somewhere."""
    hay = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    words = F.array(F.lit("a"), F.lit("1"))
    return table(spark, sf_dir, "part").filter(F.col("p_size").isin(1, 5, 9, 13, 20) & (F.col("p_brand") != "x")).withColumn("hay", hay).filter(F.forall(words, lambda w: F.contains(F.col("hay"), w))).select("p_partkey")


@query("SELECT CASE WHEN p_brand IS NULL THEN 'type' ELSE 'brand' END AS facet, coalesce(p_brand, p_type) AS value, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type))")
def facet_counts(spark, sf_dir):
    pairs = F.array(F.struct(F.lit("brand").alias("facet"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("p_type").alias("value")))
    return table(spark, sf_dir, "part").select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25 OFFSET 50")
def paginate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(50).limit(25)


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) > 1 AS repeated FROM documents")
def first_seen_duplicates(spark, sf_dir):
    """Flags rows whose text came before; digests are grouped, not texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").select("doc_id", (F.col("doc_id") != F.col("first")).alias("repeated"))


@query("SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT source, CASE WHEN bool_or(toxic = 1) THEN 'fail' WHEN bool_or(quality = 0) THEN 'inconclusive' WHEN count(l.doc_id) > 0 THEN 'pass' ELSE 'not-evaluated' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def status_aggregate(spark, sf_dir):
    """fail before inconclusive before pass; without evidence nothing is claimed."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left")
    rank = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 0, 2).when(F.col("id").isNotNull(), 1).otherwise(0)
    names = F.array(*map(F.lit, ["not-evaluated", "pass", "inconclusive", "fail"]))
    return j.groupBy("source").agg(F.get(names, F.max(rank)).alias("status"))


_REQUESTS = [
    ("Rebuild the lid.", "operate", "scoped"), ("How do I rebuild the lid?", "read-only", "none"), ("How would it look? Rebuild it.", "operate", "scoped"), ("Could you tell why, and repair it?", "operate", "scoped"), ("Should we repair it?", "read-only", "none"),
    ("Inspect the lid", "read-only", "none"), ("Inspect and repair the lid, read-only", "read-only", "none"), ("Don\u2019t worry, look at this build", "fallback", "none"), ("Provision a box, then align the parts", "linux-open-source", "scoped"), ("Align and combine both", "stack-selection", "scoped"),
    ("A mesh-first lid", "read-only", "none"), ("Rebuilding", "fallback", "none"), ("\uff26\uff29\uff38 it", "operate", "scoped"), ("", "fallback", "none"), ("Look; build", "operate", "scoped"), ("Why the export failed", "read-only", "none"),
]


@query("SELECT p_partkey, route, mutation FROM part JOIN (VALUES " + ", ".join(f"({i}, '{r}', '{m}')" for i, (_, r, m) in enumerate(_REQUESTS)) + f") v(i, route, mutation) ON p_partkey % {len(_REQUESTS)} = i")
def route_text(spark, sf_dir):
    """What requests ask for, by the precedence of the rules."""
    texts = F.array(*[F.lit(t) for t, _, _ in _REQUESTS])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(texts, (F.col("p_partkey") % len(_REQUESTS)).cast("int")).alias("text"))
    return router.route(rows, "text").select("p_partkey", "route", "mutation")


_ASSESS = """SELECT s_suppkey AS component, CASE s_suppkey % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' WHEN 3 THEN 'incompatible' WHEN 4 THEN 'tested' WHEN 5 THEN 'present_unverified' WHEN 6 THEN 'present_unverified' WHEN 7 THEN 'tested' WHEN 8 THEN 'present_unverified' ELSE 'unknown' END AS status FROM supplier"""


def _assessed(spark, sf_dir):
    k = F.col("s_suppkey")
    m = k % 10
    base = table(spark, sf_dir, "supplier")
    found = base.select(k.alias("component"), F.when(m == 0, "missing").otherwise("detected").alias("state"), F.lit("1.2").alias("version"), m.isin(4, 7).alias("verified"))
    declared = base.filter(m != 1).select(k.alias("component"), (m == 2).alias("deployment"), F.when(m.isin(7, 8), "1.2").otherwise("9").alias("locked"))
    seen = base.select(k.alias("component"), F.when(m == 3, "incompatible").when(m.isin(4, 5), "tested").when(m == 6, "probe_only").otherwise("tested").alias("kind"), F.when(m.isin(3, 4, 5, 6), "1.2").otherwise("1.1").alias("version"))
    return router.assess(found, declared, seen)


@query(_ASSESS)
def compatibility(spark, sf_dir):
    return _assessed(spark, sf_dir).select("component", "status")


@query(f"WITH a AS ({_ASSESS}), r AS (SELECT DISTINCT l_orderkey AS route, CASE WHEN l_orderkey % 50 = 0 THEN -1 WHEN l_orderkey % 3 = 0 THEN 4 + 3 * (l_suppkey % 2) WHEN l_orderkey % 3 = 1 THEN 4 + l_suppkey % 3 ELSE l_suppkey END AS component FROM lineitem) SELECT route, CASE WHEN bool_or(status IS NULL) THEN 'unknown' WHEN bool_or(status = 'incompatible') THEN 'blocked_incompatible' WHEN bool_or(status = 'missing') THEN 'blocked_missing' WHEN bool_or(status = 'unknown') THEN 'unknown' WHEN bool_or(status = 'present_unverified') THEN 'available_unverified' ELSE 'available' END AS status FROM r LEFT JOIN a USING (component) GROUP BY route")
def route_compatibility(spark, sf_dir):
    """An order is a route that requires the suppliers of its lines."""
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    part = F.when(o % 50 == 0, -1).when(o % 3 == 0, 4 + 3 * (s % 2)).when(o % 3 == 1, 4 + s % 3).otherwise(s)
    return router.route_status(table(spark, sf_dir, "lineitem").select(o.alias("route"), part.cast("long").alias("component")).distinct(), _assessed(spark, sf_dir))


_P = {n: p.replace("'", "''") for n, p in tx.PRIVATE.items()}


@query("SELECT doc_id, code FROM documents, (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _P.items()) + ") v(code, pattern) WHERE regexp_matches(coalesce(text, ''), pattern)")
def privacy_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.private_codes(F.coalesce("text", F.lit("")))).alias("code"))


_FORM = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in tx.FORMS) + " ELSE 'label' END"


@query(f"WITH t AS (SELECT p_partkey, list_extract(['o1.' || p_partkey, 'o1.2.f' || p_partkey, 'f' || p_partkey, 'bracket_' || p_size, 'arm.e' || p_size, 'm' || p_size], (p_partkey % 6 + 1)::INT) AS s FROM part) SELECT p_partkey, s AS selector, {_FORM} AS form FROM t")
def selector_grammar(spark, sf_dir):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("o1."), k), F.concat(F.lit("o1.2.f"), k), F.concat(F.lit("f"), k), F.concat(F.lit("bracket_"), z), F.concat(F.lit("arm.e"), z), F.concat(F.lit("m"), z))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(forms, (F.col("p_partkey") % 6).cast("int")).alias("selector"))
    return rows.withColumn("form", tx.selector_form(F.col("selector")))


@query("WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'o' || event_id ELSE 'f' || event_id END AS s FROM events) SELECT event_id, CASE WHEN s LIKE 'o%' THEN s ELSE coalesce(last_value(CASE WHEN s LIKE 'o%' THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) || '.', '') || s END AS full_selector FROM t")
def inherited_selectors(spark, sf_dir):
    """A bare selector takes the last occurrence before it in its list."""
    id_ = F.col("event_id").cast("string")
    t = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("o"), id_)).otherwise(F.concat(F.lit("f"), id_)).alias("s"))
    own = F.when(F.col("s").startswith("o"), F.col("s"))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.select("event_id", F.coalesce(own, F.concat(F.coalesce(F.concat(last, F.lit(".")), F.lit("")), "s")).alias("full_selector"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(replace(props, ' ', '')) AS sha FROM events")
def canonical_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), tx.canonical_json_sha256("props").alias("sha"))


@query("SELECT p_partkey, '/parts/' || replace(replace(p_name, '~', '~0'), '/', '~1') AS pointer FROM part")
def json_pointers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.json_pointer(F.lit("parts"), F.col("p_name")).alias("pointer"))


@query()
def natural_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy(tx.natural_key("p_name"), "p_partkey")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """Hourly counts by type; ``streaming.events.hourly`` gives the same from a stream."""
    from ..streaming.events import hourly

    return hourly(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts FROM s GROUP BY ALL")
def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTE"), 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT o_custkey, '1.' || max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END)::VARCHAR AS minor_seen, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN '2.0.0' WHEN bool_or(o_orderpriority = '2-HIGH') THEN '1.3.0' ELSE '1.2.4' END AS version FROM orders GROUP BY 1")
def version_bumps(spark, sf_dir):
    """Each customer's orders as commit messages: urgent ones are breaking, high ones features; the highest decides."""
    kind = F.col("o_orderpriority")
    message = F.when(kind == "1-URGENT", "fix(core)!: turn").when(kind == "2-HIGH", "feat: add").otherwise("fix: mend")
    rank = tx.bump_rank(message)
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("rank"), F.max(F.when(rank == 1, 1).otherwise(0)).alias("m"))
    return by.select("o_custkey", F.concat(F.lit("1."), F.col("m").cast("string")).alias("minor_seen"), tx.bumped(F.lit("1.2.3"), F.col("rank")).alias("version"))
