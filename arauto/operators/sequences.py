"""Ordered computations per key that never put a whole key into one task.

A key's rows are cut into buckets of its order (an hour, a range of turns). Windows run per (key, bucket); what
has to cross a bucket's border travels through a summary with one row per bucket, or through a halo: a copy of
the rows that lie within a fixed reach of the next bucket's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def hour_bucket(ts: str) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(3_600_000_000))


def lag_by_bucket(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key in ``order``; ``bucket`` must not decrease along ``order``. Values must not be null."""
    df = df.withColumn(BUCKET, bucket)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    last = df.groupBy(*keys, BUCKET).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    before = last.select(
        *keys, BUCKET, F.lag("__last").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("__before")
    )
    return (
        df.withColumn(out, F.lag(value).over(local))
        .join(before, [*keys, BUCKET])
        .withColumn(out, F.coalesce(out, "__before"))
        .drop(BUCKET, "__before")
    )


def running_count(df: DataFrame, keys: list[str], order: list[str], bucket: Column, condition: Column, out: str) -> DataFrame:
    """Rows of the key that satisfy ``condition``, up to and including this one."""
    hit = F.when(condition, 1).otherwise(0)
    df = df.withColumn(BUCKET, bucket).withColumn("__hit", hit)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*keys, BUCKET).agg(F.sum("__hit").alias("__n"))
        .select(*keys, BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    return (
        df.withColumn(out, F.sum("__hit").over(local))
        .join(before, [*keys, BUCKET])
        .withColumn(out, F.col(out) + F.col("__before"))
        .drop(BUCKET, "__before", "__hit")
    )


def with_halo(df: DataFrame, ts: str, bucket_seconds: int, reach_seconds: int) -> DataFrame:
    """Every row in its time bucket and, when the next bucket starts within ``reach_seconds``, there too.

    ``__own`` tells the row from its copies; ``reach_seconds`` may not exceed ``bucket_seconds``.
    """
    if reach_seconds > bucket_seconds:
        raise ValueError("a halo cannot reach beyond the neighbouring bucket")
    micros, width = F.unix_micros(ts), bucket_seconds * 1_000_000
    own, reached = F.floor(micros / width), F.floor((micros + reach_seconds * 1_000_000) / width)
    return (
        df.withColumn("__own_bucket", own)
        .withColumn(BUCKET, F.explode(F.sequence(own, reached)))
        .withColumn("__own", F.col(BUCKET) == F.col("__own_bucket"))
        .drop("__own_bucket")
    )
