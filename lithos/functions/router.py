"""Routing of requests by rules over whole words: what is asked for, and whether anything may be changed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rule table. The first route changes nothing; later ones do, and are tried in order.
CONTRACT = {
    "read_only_phrases": ["read only", "readonly", "do not change", "don't change", "no edits", "without editing"],
    "question_words": "how why what when where which who whose whom".split(),
    "advisory_auxiliaries": "should shall do does did is are am may might".split(),
    "advisory_subjects": ["i", "we"],
    "direct_auxiliaries": "can could would will".split(),
    "determiners": "this that these those the a an".split(),
    "default": "fallback",
    "routes": [
        ("read-only", """analyze architect assess audit blend blender bridge browser choose compare decide diagnose explain hybrid inspect
        investigate linux occt opencascade organic review select understand""".split(), ["cad sketcher", "geometry nodes", "mesh first", "open source"]),
        ("linux-open-source", ["containerize", "provision"], []),
        ("stack-selection", ["combine", "integrate", "orchestrate"], []),
        ("operate", """add align build change clean compress create crop delete edit export extract fix implement loft optimise optimize rebuild
        reconstruct refactor register remove repair segment simplify stitch thicken trace turn update write""".split(), []),
    ],
}


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Compatibility form and full case folding, which the JVM has no expression for."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold() if t is not None else "")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), 0)


def _spaced(phrase: str) -> str:
    import re

    return " " + " ".join(re.findall("[a-z0-9]+", phrase.lower())) + " "


def route(requests: DataFrame, text: str, contract: dict = CONTRACT) -> DataFrame:
    """``requests`` with route and mutation (none or scoped).

    A read-only phrase decides first. Then a question (a sentence that begins
    with a question word, or asks what "should we") is read-only unless a
    sentence begins with a term of a changing route or asks "can you". Then the
    first changing route with a term that no determiner precedes, or with a
    phrase; then the read-only rule; then the default. Null is empty.
    """
    among = lambda w, names: w.isin(list(names)) if names else F.lit(False)
    (calm, calm_terms, calm_phrases), *acting = contract["routes"]
    terms = [t for _, ts, _ in acting for t in ts]
    has = lambda phrases: F.exists(F.array(*[F.lit(_spaced(p)) for p in phrases]), lambda p: F.contains(F.col("_spaced"), p)) if phrases else F.lit(False)
    out = requests.withColumn("_text", folded(F.col(text)))
    out = out.withColumns({"_words": _words(F.col("_text")), "_sentences": F.filter(F.transform(F.split("_text", r"[.!?\n;]"), _words), lambda s: F.size(s) > 0)})
    out = out.withColumn("_spaced", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    first = lambda names: F.exists("_sentences", lambda s: among(s[0], names))
    advisory = F.exists("_sentences", lambda s: (F.size(s) > 1) & among(s[0], contract["advisory_auxiliaries"]) & among(F.get(s, F.lit(1)), contract["advisory_subjects"]))
    polite = F.exists("_sentences", lambda s: F.exists(F.transform(s, lambda w, i: among(w, contract["direct_auxiliaries"]) & F.coalesce(F.get(s, i + 1) == "you", F.lit(False))), lambda x: x))
    asked = F.flatten(F.transform("_sentences", lambda s: F.filter(s, lambda w, i: among(w, terms) & ~((i > 0) & F.coalesce(among(F.get(s, i - 1), contract["determiners"]), F.lit(False))))))
    out = out.withColumns({"_calm": has(contract["read_only_phrases"]) | (~polite & (first(contract["question_words"]) | advisory) & ~first(terms)), "_asked": asked})
    chosen = F.lit(None).cast("string")
    for name, ts, phrases in reversed(acting):
        chosen = F.when(F.arrays_overlap("_asked", F.array(*map(F.lit, ts))) | has(phrases), name).otherwise(chosen)
    out = out.withColumn("_chosen", F.when(~F.col("_calm"), chosen))
    looks = F.arrays_overlap("_words", F.array(*map(F.lit, calm_terms))) | has(calm_phrases)
    named = F.when(F.col("_calm"), calm).when(F.col("_chosen").isNotNull(), F.col("_chosen")).when(looks, calm).otherwise(contract["default"])
    return out.select(*requests.columns, named.alias("route"), F.when(F.col("_chosen").isNotNull(), "scoped").otherwise("none").alias("mutation"))


def assess(detections: DataFrame, declarations: DataFrame, observations: DataFrame) -> DataFrame:
    """``detections`` (component, state, version, verified) with status: missing, incompatible, unknown, tested or present_unverified.

    declarations ``(component, deployment, locked)``: deployment is true where
    no version says anything; observations ``(component, kind, version)``,
    kind incompatible, tested or probe_only. What was found decides first,
    then that nothing is declared, then incompatible, tested and probe-only
    observations of the very version, then a locked version.
    """
    same = observations.select("component", "version", "kind").distinct().groupBy("component", "version").agg(F.collect_set("kind").alias("_kinds"))
    d = detections.join(declarations.withColumn("_declared", F.lit(True)), "component", "left").join(same, ["component", "version"], "left")
    seen = lambda kind: F.coalesce(F.array_contains("_kinds", kind), F.lit(False))
    run = F.col("verified")
    status = (
        F.when(F.col("state").isin("missing", "incompatible", "unknown"), F.col("state")).when(F.col("_declared").isNull() | F.col("deployment"), "unknown").when(seen("incompatible"), "incompatible")
        .when(seen("tested"), F.when((F.col("state") != "detected") | ~F.coalesce(run, F.lit(True)), "present_unverified").otherwise("tested")).when(seen("probe_only"), "present_unverified")
        .when(F.col("locked") == F.col("version"), F.when(F.coalesce(run, F.lit(False)), "tested").otherwise("present_unverified")).otherwise("unknown")
    )
    return d.select(*detections.columns, status.alias("status"))


def route_status(required: DataFrame, assessed: DataFrame) -> DataFrame:
    """``(route, status)`` of routes that require components ``(route, component)``: the worst decides; one that was not looked at leaves it unknown."""
    d = required.join(assessed.select("component", "status", F.lit(True).alias("_known")), "component", "left")
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    s = F.col("status")
    g = d.groupBy("route").agg(any_(F.col("_known").isNull()).alias("lost"), any_(s == "incompatible").alias("bad"), any_(s == "missing").alias("gone"), any_(s == "unknown").alias("odd"), any_(s == "present_unverified").alias("unproved"))
    return g.select("route", F.when(F.col("lost"), "unknown").when(F.col("bad"), "blocked_incompatible").when(F.col("gone"), "blocked_missing").when(F.col("odd"), "unknown").when(F.col("unproved"), "available_unverified").otherwise("available").alias("status"))
