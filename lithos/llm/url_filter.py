"""URL filters: host rules first, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: The production rules (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Public suffixes of two labels that take a third for the registered domain.
DOUBLE = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.cn", "com.tr", "com.mx", "co.in", "co.kr", "co.za"]
#: A host is blocked if its share of bad pages is above MOST with the certainty of Z standard deviations.
MOST, Z = 0.5, 1.64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_url = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _url, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _url, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where they are a known suffix; numbers are not looked at."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(DOUBLE), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label before it."""
    return F.when(F.substring_index(host, ".", -2).isin(DOUBLE), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def reputation(outcomes: DataFrame) -> DataFrame:
    """``(host, n, bad, mean, spread)`` of labelled pages ``(host, bad)``, bad 0 or 1.

    Beta-binomial priors shrink each host to its registered domain, the
    domain to its suffix, the suffix to all pages. How strong a level's
    prior is, is estimated by moments from the spread of its groups' shares
    about their parents' means (between 1 and 1,000 pages): the
    empirical part. mean and spread are of the host's posterior.
    """
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = materialize(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad")), "hosts")
    total = lambda key: hosts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("suffix").alias("up") if key == "domain" else F.lit("").alias("up"))
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select((F.coalesce("bad", F.lit(0.0)) + 1).alias("b"), (F.coalesce("n", F.lit(0.0)) + 2).alias("n")).select((F.col("b") / F.col("n")).alias("m0"), F.col("n").alias("known0"))

    def shrunk(groups: DataFrame, parents: DataFrame, on: str | None) -> DataFrame:
        """The groups with mean, a posterior of each below its parent's mean m0, and known, the pages it rests on."""
        g = groups.join(parents, on) if on else groups.join(F.broadcast(parents), F.lit(True))
        free = F.col("n") > 1
        off = F.sum(F.when(free, (F.col("bad") - F.col("n") * F.col("m0")) ** 2 / F.col("n")))
        noise = F.sum(F.when(free, F.col("m0") * (1 - F.col("m0"))))
        room = F.sum(F.when(free, (F.col("n") - 1) * F.col("m0") * (1 - F.col("m0"))))
        # E[(bad - n m)^2 / n] = m (1 - m) (1 + (n - 1) rho), and k = 1 / rho - 1
        rho = F.coalesce((off - noise) / F.nullif(room, F.lit(0.0)), F.lit(0.0))
        k = g.agg(F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0)).alias("k"))
        # a prior is worth no more pages than its parent rests on
        g = g.join(F.broadcast(k), F.lit(True)).withColumn("k", F.least("k", "known0"))
        return g.withColumn("mean", (F.col("bad") + F.col("k") * F.col("m0")) / (F.col("n") + F.col("k"))).withColumn("known", F.col("n") + F.col("k"))

    suffixes = materialize(shrunk(total("suffix").drop("up"), everything, None), "suffixes")
    up = suffixes.select(F.col("suffix").alias("up"), F.col("mean").alias("m0"), F.col("known").alias("known0"))
    domains = materialize(shrunk(total("domain"), up, "up"), "domains")
    up = domains.select("domain", F.col("mean").alias("m0"), F.col("known").alias("known0"))
    found = shrunk(hosts.drop("suffix"), up, "domain")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("known") + 1))
    return found.select("host", "n", "bad", "mean", spread.alias("spread"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, most: float = MOST, z: float = Z) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``, a row for each row of ``pages`` ``(page_id, url)``.

    labels ``(page_id, bad)`` hold outcomes of some pages. The longest rule
    that fits decides; else a host is blocked if the lower bound of its
    posterior share of bad pages, score (mean less ``z`` spreads), is above
    ``most``. Hosts without labelled pages, null urls and urls without
    ``://`` (host and path empty) have no score and are allowed. Repeated
    rows come back each, and a label counts for each row of its page; rows of
    ``labels`` with a null outcome or page_id count nowhere. html isn't read;
    other columns stay out. Without labels no host has a score; empty pages
    give no row. A port or a numeric host is part of its last labels.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcomes = rows.filter("host <> ''").join(labels.filter("bad is not null").select("page_id", "bad"), "page_id").select("host", "bad")
    scores = materialize(reputation(outcomes).select(F.col("host").alias("_h"), (F.col("mean") - z * F.col("spread")).alias("score")), "scores")
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > most, "block").otherwise("allow")
    return rows.join(scores, F.col("host") == F.col("_h"), "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
