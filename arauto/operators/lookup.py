"""Left joins to a dimension on keys of which a few, or none at all, make up most rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose share is measured at most.
TRACKED = 64


def heavy_keys(rows: DataFrame, key: str) -> dict[object, int]:
    """Keys that hold more than two tasks' even share of the rows, and in how many parts each is to be split.

    One pass over the key, by ``approx_top_k``; TRACKED entries at most.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {TRACKED})").alias("top")).first()
    even = max(1.0, found["n"] / width)
    return {t["item"]: min(width, math.ceil(t["count"] / even)) for t in found["top"] or [] if t["count"] > 2 * even}


def lookup(rows: DataFrame, dim: DataFrame, key: str, heavy: dict[object, int] | None = None) -> DataFrame:
    """``rows`` left joined to ``dim`` on ``key``, which is unique in ``dim``.

    Rows without a key match nothing and are spread over all tasks; rows of a heavy key (measured unless given, or the rows are a
    stream) over as many parts as its measure asks, which the dimension's row is copied to.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if heavy is None:
        heavy = {} if rows.isStreaming else heavy_keys(rows, key)
    parts = F.lit(1)
    if heavy:
        pairs = [F.lit(x) for k, n in heavy.items() for x in (k, n)]
        parts = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), F.lit(1))
    row = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith(("map", "array", "struct", "variant"))])
    salt = F.pmod(row, F.when(F.col(key).isNull(), F.lit(width)).otherwise(parts)).cast("int")
    left = rows.withColumn("__salt", salt)
    right = dim.where(F.col(key).isNotNull()).withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "__salt"], "left").drop("__salt")
