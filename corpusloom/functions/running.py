"""Running aggregates that no hot key can gather in one task.

A window over one key puts all rows of the key into one task. Here rows go into buckets of neighbouring positions;
a bucket's total comes from a grouped aggregate, the totals run over the few buckets, and rows run inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def before_sum(df: DataFrame, keys: list[str], position: str, value: str, out: str, *, ties: list[str] = [], width: int = 4096) -> DataFrame:  # noqa: B006
    """Adds ``out``: the sum of ``value`` over the rows of the key before this one, by ``position`` (a whole number) and
    then ``ties``."""
    df = df.withColumn("__bucket", F.floor(F.coalesce(F.col(position), F.lit(0)) / width))
    totals = df.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__total"))
    run = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__total").over(run), F.lit(0))).drop("__total")
    inside = W.partitionBy(*keys, "__bucket").orderBy(position, *ties).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(totals, [*keys, "__bucket"])
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__bucket", "__base")


def last_known(df: DataFrame, keys: list[str], order: Column, value: str, out: str, *, position: str, width: int = 4096) -> DataFrame:
    """Adds ``out``: the value of the greatest ``order`` at or before this row's among the rows whose ``value`` is not
    null (an as-of lookup); ``order`` must grow with ``position``, a whole number."""
    df = df.withColumn("__order", order).withColumn("__bucket", F.floor(F.col(position) / width))
    known = F.when(F.col(value).isNotNull(), F.struct("__order", F.col(value).alias("value")))
    totals = df.groupBy(*keys, "__bucket").agg(F.max(known).alias("__last"))
    run = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.max("__last").over(run)).drop("__last")
    inside = W.partitionBy(*keys, "__bucket").orderBy("__order").rangeBetween(W.unboundedPreceding, W.currentRow)
    joined = df.join(totals, [*keys, "__bucket"])
    return joined.withColumn(out, F.coalesce(F.max(known).over(inside), F.col("__base"))["value"]).drop("__bucket", "__base", "__order")
