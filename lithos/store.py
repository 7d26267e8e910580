"""Cutting the lineage of iterative operators in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``; a folder of our own, removed at the end, only where the session names none and runs in one process."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("name a folder that the whole cluster shares in spark.checkpoint.dir")
            own = tempfile.mkdtemp(prefix="lithos-checkpoint-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            named = "file://" + own
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint()
