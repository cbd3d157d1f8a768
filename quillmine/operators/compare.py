"""Comparing two sets of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.2


def regressions(before: DataFrame, after: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``name, before, after, ratio, failed`` for the names of both sets of ``(name, mean)``: failed
    where the mean rose by more than the tolerance. Of a name that repeats the least mean counts."""
    old = before.groupBy("name").agg(F.min("mean").alias("before"))
    new = after.groupBy("name").agg(F.min("mean").alias("after"))
    ratio = F.when(F.col("before") > 0, F.col("after") / F.col("before"))
    return old.join(new, "name").withColumn("ratio", ratio).withColumn("failed", F.coalesce(F.col("ratio") > 1 + tolerance, F.lit(False)))
