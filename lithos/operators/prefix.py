"""Running totals over a whole table, from totals by range partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import checkpointed


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name: column): its total over all rows before, by ``order``.

    Rows are range-partitioned; only one total a partition is carried over, so no
    task holds more than a partition. Ties of ``order`` must be equal rows.
    """
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    totals = parts.groupBy("_p").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = totals.select("_p", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"_b_{n}") for n in sums])
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()]).join(F.broadcast(before), "_p")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums])
