"""Run statistics and the fetch log: counters, latency, throttling, circuit state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arauto import dims
from arauto.functions.text import ColumnLike, _col
from arauto.operators.sequences import BUCKET, hour_bucket, running_count, with_halo


# --- counters ---------------------------------------------------------------------------------------------


def is_retryable(status: ColumnLike) -> Column:
    return _col(status).isin(*dims.RETRYABLE_STATUS)


def is_failure(status: ColumnLike) -> Column:
    """What counts against a host: no answer at all, or a retryable status other than 429."""
    s = _col(status)
    return s.isNull() | (is_retryable(s) & (s != 429))


def stage_counters(rows: DataFrame, *labels: str, totals: bool = False, value: str | None = None) -> DataFrame:
    """Rows (or the sum of ``value``) per label combination; ``totals`` adds the subtotal rows of a rollup."""
    grouped = rows.rollup(*labels) if totals else rows.groupBy(*labels)
    return grouped.agg((F.count(F.lit(1)) if value is None else F.sum(value)).alias("n"))


STAGES = ("discovered", "parsed", "enriched", "persisted", "matched", "failed")


def run_stats(**stages: DataFrame) -> DataFrame:
    """Counts per source of each stage's rows; every frame has a ``source`` column."""
    tagged = [df.select("source", F.lit(name).alias("stage")) for name, df in stages.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy("source").agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])


def latency_histogram(log: DataFrame, by: str = "source", latency: str = "latency",
                      buckets: tuple[float, ...] = dims.LATENCY_BUCKETS) -> DataFrame:
    """Cumulative bucket counts, observation count and sum per source."""
    below = [F.count_if(F.col(latency) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in buckets]
    return log.groupBy(by).agg(*below, F.count(latency).alias("n"), F.sum(latency).alias("total"))


# --- throttle ---------------------------------------------------------------------------------------------


def throttle(requests: DataFrame, rps: float, capacity: int = 5, host: str = "host", ts: str = "ts", id: str = "id") -> DataFrame:
    """Each request with ``permitted_us``: when a token bucket of rate ``rps`` lets it go, first come first served.

    With T = 1/rps and the n-th request of a host, the answer is max(t, m + (n-1)T - (C-1)T), m being the largest
    t_k - (k-1)T of the requests before it. Both n and m are running aggregates, so they are taken per hour and
    carried over hours by a summary: a host that holds a large share of the log is spread over its hours.
    """
    step = round(1_000_000 / rps)
    df = requests.withColumns({"__t": F.unix_micros(ts), BUCKET: hour_bucket(ts)})
    order = Window.partitionBy(host, BUCKET).orderBy("__t", id)
    # the count is a long: times a step an int overflows
    df = df.withColumn("__n", F.row_number().over(order).cast("long")).withColumn("__s", F.col("__t") - (F.col("__n") - 1) * step)
    df = df.withColumn("__m", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = Window.partitionBy(host).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    hours = df.groupBy(host, BUCKET).agg(F.count(F.lit(1)).alias("__size"), F.max("__s").alias("__top"))
    hours = hours.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    hours = hours.withColumn("__carried", F.max(F.col("__top") - F.col("__before") * step).over(earlier))
    df = df.join(hours.select(host, BUCKET, "__before", "__carried"), [host, BUCKET])
    n = F.col("__before") + F.col("__n")
    m = F.greatest("__carried", F.col("__m") - F.col("__before") * step)  # skips nulls
    permitted = F.greatest(F.col("__t"), m + (n - 1) * step - (capacity - 1) * step)
    return df.withColumn("permitted_us", permitted).select(*requests.columns, "permitted_us")


# --- circuit ----------------------------------------------------------------------------------------------


def circuit_open(log: DataFrame, window_seconds: int = 60, threshold: int = 3, host: str = "host", ts: str = "ts",
                 id: str = "id", failed: str = "failed") -> DataFrame:
    """Failures that open a host's circuit: the ``threshold``-th within the window with no success in between.

    The answer depends on the window only, so buckets of some minutes are independent once each holds a halo of that length.
    """
    df = with_halo(log, ts, max(300, window_seconds), window_seconds)
    within = Window.partitionBy(host, BUCKET).orderBy(ts, id).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__epoch", F.count_if(~F.col(failed)).over(within)).where(failed)
    run = Window.partitionBy(host, BUCKET, "__epoch").orderBy(ts, id)
    reach = F.unix_micros(ts) - F.unix_micros(F.lag(ts, threshold - 1).over(run))
    df = df.withColumn("opens", F.coalesce(reach <= window_seconds * 1_000_000, F.lit(False)))
    return df.where("__own").select(*log.columns, "opens")


def circuit_segments(log: DataFrame, cooldown_seconds: int, host: str, ts: str, id: str, failed: str) -> DataFrame:
    """``log`` with ``segment``: runs of a host that can be replayed on their own.

    A success with no failure in the ``cooldown_seconds`` before it finds the circuit closed or lets it close,
    whatever happened earlier; every such success starts a segment.
    """
    df = with_halo(log, ts, max(3600, cooldown_seconds), cooldown_seconds)
    within = Window.partitionBy(host, BUCKET).orderBy(ts, id).rowsBetween(Window.unboundedPreceding, 0)
    last_failure = F.max(F.when(F.col(failed), F.unix_micros(ts))).over(within)
    quiet = F.coalesce(F.unix_micros(ts) - last_failure >= cooldown_seconds * 1_000_000, F.lit(True))
    df = df.withColumn("__reset", ~F.col(failed) & quiet).where("__own").select(*log.columns, "__reset")
    return running_count(df, [host], [ts, id], hour_bucket(ts), F.col("__reset"), "segment").drop("__reset")


def circuit_replay(log: DataFrame, window_seconds: int = 60, threshold: int = 3, cooldown_seconds: int = 300,
                   host: str = "host", ts: str = "ts", id: str = "id", failed: str = "failed") -> DataFrame:
    """Every request with ``allowed`` and the circuit ``state`` after it.

    Three failures within the window open the circuit; while open, requests are refused; after the cool-down one
    trial closes or reopens it. The rule depends on its own earlier decisions, so Python replays it, but segment by
    segment (see ``circuit_segments``): segments of a host spread over the cluster, and a task streams through its
    sorted rows holding one segment's state, never a group.
    """
    segmented = circuit_segments(log, cooldown_seconds, host, ts, id, failed)
    rows = segmented.select(host, "segment", F.unix_micros(ts).alias("t"), F.col(id), F.col(failed).alias("failed"))
    window, cooldown = window_seconds * 1_000_000, cooldown_seconds * 1_000_000

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent, opened_at = None, [], None
        for pdf in batches:
            allowed, states = [], []
            for h, segment, t, failure in zip(pdf[host], pdf["segment"], pdf["t"], pdf["failed"]):
                if (h, segment) != current:
                    current, recent, opened_at = (h, segment), [], None
                trial = opened_at is not None and t - opened_at >= cooldown
                admitted = opened_at is None or trial
                if admitted and failure:
                    recent = [r for r in recent if t - r <= window] + [t]
                    if trial or len(recent) >= threshold:
                        opened_at = t
                elif admitted:
                    recent, opened_at = [], None
                allowed.append(admitted)
                states.append("closed" if opened_at is None else "open")
            yield pdf[[id, host, "t"]].assign(allowed=allowed, state=states)

    types = dict(log.dtypes)
    schema = f"{id} {types[id]}, {host} {types[host]}, t bigint, allowed boolean, state string"
    ordered = rows.repartition(host, "segment").sortWithinPartitions(host, "segment", "t", id)
    return ordered.mapInPandas(replay, schema).withColumn(ts, F.timestamp_micros("t")).drop("t")
