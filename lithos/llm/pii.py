"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier over spans decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize
from .quality import let

#: The base kinds in order. Each is the contract's pattern; where it repeats a class, the form that never
#: tries a run of characters twice (possessive, and only from the start of a run or the end of the last match).
BASE = ["email", "ip", "card", "phone"]
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    # the method's own kind: grouped numbers without a plus sign, as of local telephones
    r"(?<![0-9A-Za-z+.,-])\(?0[0-9]{1,4}\)?[\x20/-][0-9](?:[\x20/-]?[0-9]){4,9}(?![0-9A-Za-z]|[.,-][0-9])",
]
KINDS = [*BASE, "local"]
#: Gazetteers of the labelers.
TLDS = "com org net edu gov info biz io de fr es it uk nl eu us ca au ch at be jp cn br in ru pl se no dk fi pt".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 359 370 371 372 380 385 420 421 971 972".split()
CUES = r"(?i)(?:e-?mail|mailto|contact|write|phone|tel|telefon|téléphone|teléfono|call|fax|mobile|handy|card|karte|carte|tarjeta|visa|iban|account|konto|compte|cuenta|ip|host|server|address)\W{0,4}$"
LABELERS, ROUNDS, CERTAIN, BLOCK, LEFT, BUCKETS = 4, 30, 0.9, 64, 24, 64


def _starts(pieces: Column, matches: Column) -> Column:
    """Where each match starts: lengths of all that stands before, summed in blocks so that n matches cost n times a constant."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def placed(s: Column) -> Column:
        n = F.size(s)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: add(F.slice(s, b * BLOCK + 1, BLOCK)))
        ahead = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(ahead, lambda a: F.transform(pieces, lambda p, i: F.get(a, F.floor(i / BLOCK).cast("int")) + add(F.slice(s, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)) + F.length(p)))

    return let(steps, placed)


def _valid(kind: int, m: Column) -> Column:
    """Whether a match is a span of its kind."""
    digits = F.length(F.regexp_replace(m, r"[^0-9]", ""))
    if kind == 1:
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|\z)){4}\z")
    if kind == 2:
        return F.when(digits.between(13, 19), F.call_function("luhn_check", F.regexp_replace(m, r"[\x20-]", ""))).otherwise(F.lit(False))
    if kind == 3:
        return digits.between(9, 15)
    return F.lit(True) if kind == 0 else digits.between(7, 12)


def _votes(kind: int, m: Column, ok: Column, left: Column, right: Column) -> list[Column]:
    """Votes of the labelers on a candidate: 1 for, -1 against, 0 abstains."""
    say = lambda c, no=-1: F.when(c, 1).otherwise(no)
    shape = m.rlike(r"\.[A-Za-z]{2,24}\z") & ~m.contains("..") if kind == 0 else ok
    if kind == 0:
        listed = F.lower(F.substring_index(m, ".", -1)).isin(TLDS)
    elif kind == 1:
        listed = ~m.rlike(r"^(?:0|127|255|224)\.")
    elif kind == 2:
        listed = m.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")
    elif kind == 3:
        listed = m.rlike(r"^\+(?:" + "|".join(CALLING) + ")")
    else:
        listed = m.rlike(r"^\(?0[1-9]")
    edge = left.rlike(r"[0-9A-Za-z_]\z") | right.rlike(r"[0-9A-Za-z_]")
    return [say(shape), say(listed), say(left.rlike(CUES), 0), F.when(edge, -1).otherwise(1)]


def _candidates(text: Column, kind: int) -> Column:
    """Array of candidates of a kind in order: kind, start, end, ok, votes, word (bucket of the word before), size."""
    one = "struct<kind:int,start:int,end:int,ok:boolean,votes:array<int>,word:int,size:int>"
    none = F.array().cast(f"array<{one}>")
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)

    def built(ms: Column) -> Column:
        def rows(pieces: Column) -> Column:
            def row(z: Column, i: Column) -> Column:
                m, at = z["m"], z["at"]
                left, right = F.right(z["p"], F.lit(LEFT)), F.substring(F.get(pieces, i + 1), 1, 1)

                def out(x: Column) -> Column:
                    votes = _votes(kind, m, x["ok"], x["left"], right)
                    word = F.pmod(F.hash(F.lower(F.regexp_extract(x["left"], r"(\p{L}+)\P{L}*\z", 1))), F.lit(BUCKETS))
                    return F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), x["ok"].alias("ok"), F.array(*votes).alias("votes"), word.alias("word"), F.least(F.length(m), F.lit(24)).alias("size"))

                return let(F.struct(_valid(kind, m).alias("ok"), left.alias("left")), out)

            zipped = F.arrays_zip(F.slice(pieces, 1, F.size(ms)).alias("p"), ms.alias("m"), F.slice(_starts(pieces, ms), 1, F.size(ms)).alias("at"))
            return F.transform(zipped, row).cast(f"array<{one}>")

        return F.when(F.size(ms) == 0, none).otherwise(let(F.split(text, PATTERNS[kind], -1), rows))

    some = F.contains(text, F.lit("@")) if kind == 0 else F.contains(text, F.lit("+")) if kind == 3 else text.rlike("[0-9]")
    return F.when(some, let(matches, built)).otherwise(none)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found)``, a row for each row of ``docs``; found: the candidates of all kinds, by kind, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.concat(*[_candidates(F.col("text"), k) for k in range(len(KINDS))]).alias("found"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Chance that a candidate is personal data, for each pattern ``(kind, vote, vote ...)`` with its count.

    Expectation-maximisation of a model in which labelers err independently,
    given the truth (Dawid and Skene): each has a chance of each vote for
    either truth, and each kind a share of true ones. Counts are all that
    is needed, so the work does not grow with the corpus.
    """
    truth = {p: min(0.95, max(0.05, 0.5 + 0.15 * sum(p[1:]))) for p, _ in patterns}
    for _ in range(rounds):
        share: dict[int, list[float]] = {}
        vote: dict[tuple[int, int], list[float]] = {}
        for p, n in patterns:
            t = truth[p]
            s = share.setdefault(p[0], [1.0, 1.0])
            s[0] += n * t
            s[1] += n * (1 - t)
            for i, v in enumerate(p[1:]):
                c = vote.setdefault((i, v), [1.0, 1.0])
                c[0] += n * t
                c[1] += n * (1 - t)
        sums = {i: [sum(c[j] for (k, _), c in vote.items() if k == i) for j in (0, 1)] for i in range(LABELERS)}
        for p, _ in patterns:
            odds = math.log(share[p[0]][0] / share[p[0]][1])
            for i, v in enumerate(p[1:]):
                yes, no = vote[i, v]
                odds += math.log(yes / sums[i][0]) - math.log(no / sums[i][1])
            truth[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return truth


def _pattern(c: Column) -> Column:
    return F.concat_ws(",", c["kind"].cast("string"), F.transform(c["votes"], lambda v: v.cast("string")))


def _features(c: Column) -> Column:
    """Names of a candidate's features; there are a few hundred in all."""
    k = c["kind"].cast("string")
    own = [F.concat(F.lit(f"v{i}:"), k, F.lit(":"), c["votes"][i].cast("string")) for i in range(LABELERS)]
    return F.array(*own, F.concat(F.lit("w:"), c["word"].cast("string")), F.concat(F.lit("s:"), k, F.lit(":"), c["size"].cast("string")))


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the features and the offset of the span classifier, from all candidates of ``found``.

    A naive Bayes classifier on the soft labels of ``reliabilities``. The
    driver gets one row for each vote pattern and each feature: at most some
    hundreds, whatever the corpus.
    """
    spans = materialize(found.select(F.explode("found").alias("c")).select(_pattern(F.col("c")).alias("p"), _features(F.col("c")).alias("f")).groupBy("p", "f").count(), "spans")
    rows = [(tuple(map(int, r["p"].split(","))), r["n"]) for r in spans.groupBy("p").agg(F.sum("count").alias("n")).collect()]
    truth = reliabilities(sorted(rows))
    if not truth:
        return {}, 0.0
    table = F.map_from_arrays(F.array(*[F.lit(",".join(map(str, p))) for p in truth]), F.array(*[F.lit(t) for t in truth.values()]))
    soft = spans.withColumn("t", F.element_at(table, F.col("p")))
    yes, no = F.sum(F.col("t") * F.col("count")).alias("yes"), F.sum((1 - F.col("t")) * F.col("count")).alias("no")
    features = soft.select(F.explode("f").alias("f"), "t", "count").groupBy("f").agg(yes, no).collect()
    all_yes = sum(n * truth[p] for p, n in rows)
    all_no = sum(n * (1 - truth[p]) for p, n in rows)
    weights = {r["f"]: math.log((r["yes"] + 1) / (all_yes + 2)) - math.log((r["no"] + 1) / (all_no + 2)) for r in features}
    return weights, math.log((all_yes + 1) / (all_no + 1))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", certain: float = CERTAIN) -> DataFrame:
    """``(doc_id, spans)``, a row for each row of ``docs``; spans ``(kind, start, end)`` by kind, then start.

    Spans of the kinds email, ip, card and phone are all valid matches of
    the patterns. To them come matches of the kind local that the span
    classifier holds for personal data with the chance ``certain`` at least,
    and that overlap none of the others. Positions are code points. Null and
    empty texts have no spans; repeated rows have theirs each; an empty table
    gives no row.
    """
    found = materialize(candidates(docs, id_col, text_col), "candidates")
    weights, offset = train(found)
    if weights:
        table = F.map_from_arrays(F.array(*[F.lit(f) for f in weights]), F.array(*[F.lit(w) for w in weights.values()]))
        score = lambda c: F.aggregate(_features(c), F.lit(offset), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    else:
        score = lambda c: F.lit(0.0)
    base = F.filter("found", lambda c: (c["kind"] < len(BASE)) & c["ok"])
    least = math.log(certain / (1 - certain))

    def joined(b: Column) -> Column:
        free = lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))
        more = F.filter("found", lambda c: (c["kind"] >= len(BASE)) & c["ok"] & (score(c) >= least) & free(c))
        return F.concat(b, more)

    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(let(base, joined), lambda c: F.struct(F.get(kinds, c["kind"]).alias("kind"), c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end")))
    return found.select("doc_id", spans.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, n_local, base_sha256, spans)`` from the spans."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
