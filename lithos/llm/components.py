"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; nodes share a root if and only if links join them.

    Each round every node takes the neighbour of least hash (or itself), both
    ends of each link are renamed so, and links within one name go. Hashes
    differ by round, so that a constant share of the names goes each time,
    for chains and for stars alike. Each round is written to the shared
    folder; what is left of the links shrinks geometrically. Null ends and
    self links join nothing; an empty table gives an empty one.
    """
    now = materialize(
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    names: list[DataFrame] = []
    while not names or not now.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(names))).alias("h"), F.col(c).alias("n"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        name = materialize(near.select(F.col("a").alias("node"), F.least("least", rank("a"))["n"].alias("root")), "names")
        names.append(name)
        now = materialize(
            now.join(name.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(name.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "links",
        )
    found = names[0]
    for name in names[1:]:
        later = name.select(F.col("node").alias("root"), F.col("root").alias("later"))
        found = found.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return materialize(found, "components")
