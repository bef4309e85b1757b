"""Cutting lineage between the steps of a loop, and joins that stay off the driver."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that spark.checkpoint.dir names; in a temporary one only where Spark runs in one process and none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="volspark-state-"))
    return df.checkpoint()


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle and sort: Spark takes exploded rows to be as small as those they come from, and would send them to all tasks by way of the driver."""
    return left.join(right.hint("merge"), on, how)
