"""Fetch-log queries: throttle, circuit, latency, counters, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arauto.operators import contracts, ops
from arauto.plans.catalog import query, table
from arauto.plans.q_text import sql_pick
from arauto.functions.fields import host
from arauto.plans.ingest import fetch_requests

OUTCOMES = (("click", 200), ("view", 200), ("purchase", 404), ("signup", 429))  # an error got no answer


def fetch_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as fetches: the user is the host, the event type the outcome, the value the latency."""
    e = table(spark, d, "events")
    status = F.lit(None).cast("int")
    for kind, code in OUTCOMES:
        status = F.when(F.col("event_type") == kind, code).otherwise(status)
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("host"), "ts", F.col("event_type").alias("source"), status.alias("status"),
        F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"))


SQL_LOG = f"SELECT event_id AS id, user_id AS host, epoch_us(ts) AS t, ts, event_type AS source, {sql_pick('event_type', OUTCOMES)} AS status, value AS latency, event_type = 'error' AS failed FROM events"


@query(f"""WITH n AS (SELECT id, host, t, row_number() OVER w AS n FROM ({SQL_LOG}) WINDOW w AS (PARTITION BY host ORDER BY t, id)),
  m AS (SELECT *, max(t - (n - 1) * 36000000000) OVER (PARTITION BY host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM n)
  SELECT id, host, greatest(t, coalesce(m + (n - 1) * 36000000000 - 2 * 36000000000, t))::bigint AS permitted_us FROM m""")
def throttle(spark: SparkSession, d: str) -> DataFrame:
    """One request per ten hours and host, bursts of three."""
    return ops.throttle(fetch_log(spark, d), 1 / 36_000, 3).select("id", "host", "permitted_us")


CIRCUIT = dict(window_seconds=36_000, threshold=2, cooldown_seconds=86_400)


@query(f"""WITH e AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY host ORDER BY t, id) AS epoch FROM ({SQL_LOG}))
  SELECT id, host, coalesce(t - lag(t, 1) OVER (PARTITION BY host, epoch ORDER BY t, id) <= 36000000000, false) AS opens FROM e WHERE failed""")
def circuit_open(spark: SparkSession, d: str) -> DataFrame:
    got = ops.circuit_open(fetch_log(spark, d), CIRCUIT["window_seconds"], CIRCUIT["threshold"])
    return got.select("id", "host", "opens")


# The state machine step by step: s = (opened_at, failures of the running window), one event per host and step.
SQL_REPLAY = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT id, host, t, failed, row_number() OVER (PARTITION BY host ORDER BY t, id) AS n FROM ({SQL_LOG})),
  r AS (
    SELECT 0::bigint AS n, host, NULL::bigint AS id, NULL::bigint AS opened, CAST([] AS BIGINT[]) AS recent, NULL::boolean AS allowed FROM (SELECT DISTINCT host FROM e)
    UNION ALL
    SELECT n, host, id, CASE WHEN NOT adm THEN opened WHEN NOT failed THEN NULL WHEN trial OR len(rec) >= 2 THEN t ELSE opened END,
           CASE WHEN NOT adm THEN recent WHEN NOT failed THEN CAST([] AS BIGINT[]) ELSE rec END, adm
    FROM (SELECT e.n, e.host, e.id, e.t, e.failed, r.opened, r.recent, r.opened IS NOT NULL AND e.t - r.opened >= 86400000000 AS trial,
                 r.opened IS NULL OR e.t - r.opened >= 86400000000 AS adm, list_append(list_filter(r.recent, lambda x: e.t - x <= 36000000000), e.t) AS rec
          FROM r JOIN e ON e.host = r.host AND e.n = r.n + 1))
  SELECT id, host, allowed, CASE WHEN opened IS NULL THEN 'closed' ELSE 'open' END AS state FROM r WHERE n > 0"""


@query(SQL_REPLAY)
def circuit_replay(spark: SparkSession, d: str) -> DataFrame:
    return ops.circuit_replay(fetch_log(spark, d), **CIRCUIT).select("id", "host", "allowed", "state")


_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


@query("SELECT source, " + ", ".join(f"count(*) FILTER (latency <= {b}) AS le_{str(b).replace('.', '_')}" for b in _BUCKETS)
       + f", count(*) AS n, round(sum(latency::decimal(18, 2)), 2)::double AS total FROM ({SQL_LOG}) GROUP BY source")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ops.latency_histogram(fetch_log(spark, d)).withColumn("total", F.round("total", 2))


@query(f"SELECT source, status::int AS status, count(*) AS n FROM ({SQL_LOG}) GROUP BY ROLLUP (source, status)")
def request_counters(spark: SparkSession, d: str) -> DataFrame:
    return ops.stage_counters(fetch_log(spark, d), "source", "status", totals=True)


@query(f"SELECT host, sum(length(props)) AS n FROM (SELECT user_id AS host, props FROM events) GROUP BY 1")
def payload_counters(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "events").select(F.col("user_id").alias("host"), F.length("props").alias("size"))
    return ops.stage_counters(sized, "host", value="size")


@query(f"SELECT coalesce(status IN (408, 425, 429, 500, 502, 503, 504), false) AS retryable, status IS NULL AS failure, count(*) AS n FROM ({SQL_LOG}) GROUP BY ALL")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    log = fetch_log(spark, d)
    return log.groupBy(F.coalesce(ops.is_retryable("status"), F.lit(False)).alias("retryable"), ops.is_failure("status").alias("failure")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, count(*) FILTER (k = 'd') AS discovered, count(*) FILTER (k = 'p') AS parsed, 0::bigint AS enriched, count(*) FILTER (k = 's') AS persisted,
  count(*) FILTER (k = 'm') AS matched, count(*) FILTER (k = 'f') AS failed FROM (
    SELECT source, 'd' AS k FROM documents UNION ALL SELECT source, 'p' FROM documents WHERE n_chars > 500 UNION ALL SELECT source, 's' FROM documents WHERE n_chars > 1000
    UNION ALL SELECT source, 'm' FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT source, 'f' FROM documents WHERE n_chars <= 500) GROUP BY source""")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    good = table(spark, d, "labels").where("quality = 1")
    return ops.run_stats(
        discovered=docs, parsed=docs.where("n_chars > 500"), persisted=docs.where("n_chars > 1000"), matched=docs.join(good, "doc_id"), failed=docs.where("n_chars <= 500"))


def error_letters(spark: SparkSession, d: str) -> DataFrame:
    failed = fetch_log(spark, d).where("failed")
    return contracts.dead_letters(failed, "fetch", F.lit("no answer"), F.col("ts"), id=F.col("id"), host=F.col("host"))


@query("""SELECT 'fetch' AS stage, '{"id":' || event_id || ',"host":' || user_id || '}' AS payload, epoch_us(ts) AS us FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100""")
def oldest_letters(spark: SparkSession, d: str) -> DataFrame:
    """The 100 letters handed out first."""
    return contracts.oldest_letters(error_letters(spark, d), 100).select("stage", "payload", F.unix_micros("ts").alias("us"))


@query("SELECT count(*) - least(100, count(*)) AS queued FROM events WHERE event_type = 'error'")
def queued_letters(spark: SparkSession, d: str) -> DataFrame:
    letters = error_letters(spark, d)
    return contracts.without_letters(letters, contracts.oldest_letters(letters, 100)).agg(F.count(F.lit(1)).alias("queued"))


@query(r"""WITH u AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, TIMESTAMP '2024-01-01' + INTERVAL (page_id) SECOND AS ts FROM pages WHERE NOT regexp_matches(url, '^[a-z]+://[^/]+/fr/')),
  n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, url) AS n FROM u),
  m AS (SELECT *, max(epoch_us(ts) - (n - 1) * 60000000) OVER (PARTITION BY host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM n)
  SELECT url, host, greatest(epoch_us(ts), coalesce(m + (n - 1) * 60000000 - 60000000, epoch_us(ts)))::bigint AS permitted_us FROM m""")
def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses through robots rules and the rate limit."""
    urls = table(spark, d, "pages").select("url", F.timestamp_seconds(F.col("page_id") + F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).alias("requested_at"))
    rules = urls.select(host("url").alias("host")).distinct().select("host", F.lit("/fr/").alias("prefix"), F.lit(False).alias("allow"))
    return fetch_requests(urls, rules, rps=1 / 60, capacity=2).select("url", "host", "permitted_us")
