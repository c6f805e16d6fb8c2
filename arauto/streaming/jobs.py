"""Structured Streaming forms of the ingest, change, pending, circuit, throttle, alert and digest operators.

Lateness: a watermark on the event time, one day unless stated. Stateful jobs keep a few numbers per key in the
RocksDB state store, and rows that wait for the watermark; nothing grows with a key's history.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from arauto.operators import digest
from arauto.operators.dedup import change_kind
from arauto.operators.ops import is_failure
from arauto.operators.tables import batch_clock, write_batch
from arauto.plans.ingest import Dimensions, run_batch
from arauto.session import cut_lineage
from arauto.sources.pages import stream_pages

WATERMARK = "1 day"


# --- ingest -----------------------------------------------------------------------------------------------


def start_ingest(spark: SparkSession, path: str, root: str, checkpoint: str, dimensions: Callable[[], Dimensions],
                 now: Callable[[], Column] = F.current_timestamp, max_files: int = 1000) -> StreamingQuery:
    """Fetched pages under ``path`` through the batch plan, micro-batch by micro-batch.

    Good rows and dead letters are written by the same function; every table share is named after the batch id, so
    a repeated micro-batch replaces its own output, with the times of its first attempt. Dimensions are re-read per batch.
    """
    def process(pages: DataFrame, batch: int) -> None:
        run_batch(pages, dimensions(), root, batch, batch_clock(pages.sparkSession, f"{root}/clock", batch, now()))

    stream = stream_pages(spark, path, max_files)
    return (
        stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", by: tuple[str, ...] = ()) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).partitionBy(*by)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# --- stateful rows ----------------------------------------------------------------------------------------


def _in_order(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """A key's rows of this micro-batch, whose size the source's trigger limits bound."""
    return pd.concat(list(rows)).sort_values(list(order))


class _InEventOrder(StatefulProcessor):
    """Hands a key's rows on in order of event time, once the watermark has passed them, however they arrive.

    Rows wait in chunks: what one Arrow batch brings of a key, in order, cut at borders of buckets of event time into CHUNK rows
    or little more. One timer a key, at the end of its first waiting bucket, releases what the watermark has passed; memory
    holds the chunks that overlap in time, and nothing of them stays in the state store. ``fields`` are the waiting columns,
    the event time in microseconds (``t``) first. Rows with a null key move the watermark but are ignored.
    """

    CHUNK = 1000

    def __init__(self, fields: str, width_seconds: int):
        self.fields, self.width = fields, width_seconds * 1_000_000
        self.names = [f.split()[0] for f in fields.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = ", ".join("{0} array<{1}>".format(*f.split()) for f in self.fields.split(", "))
        self.chunks = handle.getMapState("chunks", "bucket bigint, part bigint", lists)
        self.waiting = handle.getValueState("parts", "parts bigint, first bigint")

    def _wait(self, parts: int, first: int | None) -> None:
        """Keeps how many chunks there have been and the first waiting bucket, and has its end release it."""
        if first is None:
            self.waiting.clear()
        else:
            self.waiting.update((parts, first))
            self.handle.registerTimer((first + 1) * self.width // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return iter([])
        parts, first = before = self.waiting.get() if self.waiting.exists() else (0, None)
        for pdf in rows:
            ordered = pdf[self.names].dropna(subset=["t"]).astype({"t": "int64"}).sort_values("t")
            buckets, at = (ordered["t"] // self.width).to_numpy(), 0
            while at < len(buckets):
                end = int(buckets.searchsorted(buckets[min(at + self.CHUNK, len(buckets)) - 1], "right"))
                bucket = int(buckets[at])
                self.chunks.updateValue((bucket, parts), tuple(ordered[c].iloc[at:end].tolist() for c in self.names))
                parts, first, at = parts + 1, bucket if first is None else min(first, bucket), end
        if (parts, first) != tuple(before):
            self._wait(parts, first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000 // self.width * self.width
        parts, first = self.waiting.get() if self.waiting.exists() else (0, None)
        if first is not None and first * self.width < horizon:
            chunks = sorted(self.chunks.keys())
            due = [k for k in chunks if k[0] * self.width < horizon]
            first = chunks[len(due)][0] if len(due) < len(chunks) else None
            rows: list[tuple] = []
            for n, chunk in enumerate(due):
                rows = sorted(rows + list(zip(*self.chunks.getValue(chunk), strict=True)))
                self.chunks.removeKey(chunk)
                until = due[n + 1][0] * self.width if n + 1 < len(due) else horizon
                ready = bisect_left(rows, (until,))
                if ready:
                    yield from self.take(key, rows[:ready])
                rows = rows[ready:]
            if rows:  # of chunks that reach beyond the watermark
                bucket = rows[0][0] // self.width
                self.chunks.updateValue((bucket, parts), tuple(list(c) for c in zip(*rows, strict=True)))
                parts, first = parts + 1, bucket if first is None else min(first, bucket)
        yield from self.passed(key, horizon)
        self._wait(parts, first)  # last: a timer taken back above may have been this one

    def take(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """The next rows, in order."""
        raise NotImplementedError

    def passed(self, key, horizon: int) -> Iterator[pd.DataFrame]:
        """All rows before ``horizon`` (microseconds) have been taken."""
        return iter([])

    def close(self) -> None:
        pass


class _LastValue(_InEventOrder):
    """Emits each capture with the value seen before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "simhash bigint")

    def take(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        values = [r[2] for r in rows]
        prior = [self.last.get()[0] if self.last.exists() else None, *values[:-1]]
        self.last.update((values[-1],))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "seq": [r[1] for r in rows], "simhash": values, "prior": pd.array(prior, dtype="Int64")})


def change_stream(captures: DataFrame, key: str, ts: str, seq: str, simhash: str = "simhash", near: int = 3, delay: str = WATERMARK,
                  bucket_seconds: int = 600) -> DataFrame:
    """(key, seq, simhash, prior, change) per capture, against the capture before it in event time (ties by ``seq``).

    Captures may come in any order and any number of micro-batches within ``delay``; each is emitted once the watermark has
    passed its bucket, later ones are dropped. Of a key only its last value stays. Rows with a null key are ignored.
    """
    rows = captures.withWatermark(ts, delay).select(
        F.col(key).alias("key"), ts, F.unix_micros(ts).alias("t"), F.col(seq).cast("long").alias("seq"), F.col(simhash).alias("simhash"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, seq bigint, simhash bigint, prior bigint"
    processor = _LastValue("t bigint, seq bigint, simhash bigint", bucket_seconds)
    seen = rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return seen.withColumn("change", change_kind("prior", "simhash", near))


class _Pending(_InEventOrder):
    """A match waits from when it is found until it is sent, or its time is over."""

    def __init__(self, hours: int, bucket_seconds: int):
        super().__init__("t bigint, sent boolean", bucket_seconds)
        self.window = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.created = handle.getValueState("created", "t bigint")

    def _timer(self, created: int) -> int:
        """When all rows up to the end of the window have been taken."""
        return ((created + self.window) // self.width + 1) * self.width // 1000

    def _rows(self, key, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            created, outcome, at = zip(*found, strict=True)
            yield pd.DataFrame({"id": [key[0]] * len(found), "created": created, "outcome": outcome, "at": at})

    def take(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        before = created = self.created.get()[0] if self.created.exists() else None
        found = []
        for t, sent in rows:
            if created is not None and t - created > self.window:
                found.append((created, "lapsed", created + self.window))
                created = None
            if not sent:
                created = t
            elif created is not None:
                found.append((created, "sent", t))
                created = None
        if created != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            if created is None:
                self.created.clear()
            else:
                self.created.update((created,))
                self.handle.registerTimer(self._timer(created))
        yield from self._rows(key, found)

    def passed(self, key, horizon: int) -> Iterator[pd.DataFrame]:
        created = self.created.get()[0] if self.created.exists() else None
        if created is not None and created + self.window < horizon:
            self.handle.deleteTimer(self._timer(created))
            self.created.clear()
            yield from self._rows(key, [(created, "lapsed", created + self.window)])


def pending_stream(matches: DataFrame, sent: DataFrame, hours: int = 24, delay: str = WATERMARK, bucket_seconds: int = 60) -> DataFrame:
    """(id, created_at, outcome, at): what became of each pending match, 'sent' within ``hours`` or 'lapsed' after them.

    ``matches`` has id and created_at, ``sent`` id and notified_at. A match that is found again while it waits starts anew, as
    in the stored table; a mark without a waiting match is ignored; at the same time a find comes before a mark. What
    waits is the only state: event-time timers delete it when its window is over. Rows with a null id or time are ignored.
    """
    found = matches.select("id", F.col("created_at").alias("ts"), F.lit(False).alias("sent"))
    marks = sent.select("id", F.col("notified_at").alias("ts"), F.lit(True).alias("sent"))
    rows = found.unionByName(marks).withWatermark("ts", delay).select("id", "ts", F.unix_micros("ts").alias("t"), "sent")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, created bigint, outcome string, at bigint"
    # one null would make pandas read a batch's ids and times as doubles, which the state takes for nulls. Both columns are in one
    # test: a test of the id alone would be pushed below the watermark, which a row without an id still moves
    rows = rows.where(F.size(F.array_compact(F.array(F.col("t").cast("string"), F.col("id").cast("string")))) == 2)
    done = rows.groupBy("id").transformWithStateInPandas(_Pending(hours, bucket_seconds), schema, "Append", "EventTime")
    return done.select("id", F.timestamp_micros("created").alias("created_at"), "outcome", F.timestamp_micros("at").alias("at"))


class _Circuit(StatefulProcessor):
    """Circuit state of a host: when it opened, and its failures within the window."""

    def __init__(self, window: int, threshold: int, cooldown: int):
        self.window, self.threshold, self.cooldown = window, threshold, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "t bigint")
        self.recent = handle.getListState("recent", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "t", "id")
        opened = self.opened.get()[0] if self.opened.exists() else None
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        allowed, states = [], []
        for t, failed in zip(pdf["t"].tolist(), pdf["failed"].tolist()):
            trial = opened is not None and t - opened >= self.cooldown
            admitted = opened is None or trial
            if admitted and failed:
                recent = [r for r in recent if t - r <= self.window] + [t]
                opened = t if trial or len(recent) >= self.threshold else opened
            elif admitted:
                recent, opened = [], None
            allowed.append(admitted)
            states.append("closed" if opened is None else "open")
        self.opened.clear() if opened is None else self.opened.update((opened,))
        self.recent.put([(r,) for r in recent]) if recent else self.recent.clear()
        yield pd.DataFrame({"host": [key[0]] * len(pdf), "id": pdf["id"].tolist(), "allowed": allowed, "state": states})

    def close(self) -> None:
        pass


def circuit_stream(log: DataFrame, host: str = "host", ts: str = "ts", id: str = "id", failed: str = "failed",
                   window_seconds: int = 60, threshold: int = 3, cooldown_seconds: int = 300) -> DataFrame:
    """(host, id, allowed, state) per request. Exact when batches arrive in time order per host."""
    rows = log.select(
        F.col(host).alias("host"), F.unix_micros(ts).alias("t"), F.col(id).alias("id"), F.col(failed).alias("failed"))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("host", "id")) + ", allowed boolean, state string"
    processor = _Circuit(window_seconds * 1_000_000, threshold, cooldown_seconds * 1_000_000)
    return rows.groupBy("host").transformWithStateInPandas(processor, schema, "Append", "None")


class _Bucket(StatefulProcessor):
    """Token bucket of a host: when it would be full again if nothing more came, and the last request's time."""

    def __init__(self, step: int, capacity: int, idle: int | None):
        self.step, self.capacity, self.idle = step, capacity, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "due bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, "t", "id")
        due, last = self.seen.get() if self.seen.exists() else (None, None)
        permitted = []
        for t in pdf["t"].tolist():
            if due is None or (self.idle is not None and t - last >= self.idle):
                due = t
                permitted.append(t)
            else:
                permitted.append(max(t, due - (self.capacity - 1) * self.step))
            due, last = max(t, due) + self.step, t
        self.seen.update((due, last))
        yield pd.DataFrame({"host": [key[0]] * len(pdf), "id": pdf["id"].tolist(), "permitted_us": permitted})

    def close(self) -> None:
        pass


def throttle_stream(requests: DataFrame, rps: float, capacity: int = 5, idle_seconds: int | None = 60, host: str = "host",
                    ts: str = "ts", id: str = "id") -> DataFrame:
    """(host, id, permitted_us) per request; a host's bucket is forgotten after ``idle_seconds`` without requests.

    Idleness is measured on the requests' own time, so a rerun gives the same answer.
    """
    rows = requests.select(F.col(host).alias("host"), F.unix_micros(ts).alias("t"), F.col(id).alias("id"))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("host", "id")) + ", permitted_us bigint"
    idle = None if idle_seconds is None else idle_seconds * 1_000_000
    processor = _Bucket(round(1_000_000 / rps), capacity, idle)
    return rows.groupBy("host").transformWithStateInPandas(processor, schema, "Append", "None")


# --- windows ----------------------------------------------------------------------------------------------


def first_captures(notices: DataFrame, ts: str = "fetched_at", delay: str = WATERMARK, key: str = "canonical_hash") -> DataFrame:
    """Exact copies within the watermark pass once."""
    return notices.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def failure_alerts(log: DataFrame, host: str = "host", ts: str = "ts", failed: Column | None = None, window: str = "60 seconds",
                   slide: str = "10 seconds", at_least: int = 3, delay: str = WATERMARK) -> DataFrame:
    """(host, start, end, failures) of sliding windows with enough failures."""
    failed = is_failure("status") if failed is None else failed
    counted = log.withWatermark(ts, delay).where(failed).groupBy(F.window(ts, window, slide), host).agg(F.count(F.lit(1)).alias("failures"))
    return counted.where(F.col("failures") >= at_least).select(
        host, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "failures")


def contract_alerts(violations: DataFrame, source: str = "source", ts: str = "ts", window: str = "1 hour", at_least: int = 3,
                    delay: str = WATERMARK) -> DataFrame:
    """(source, start, violations) of hours with enough contract violations."""
    counted = violations.withWatermark(ts, delay).groupBy(F.window(ts, window), source).agg(F.count(F.lit(1)).alias("violations"))
    return counted.where(F.col("violations") >= at_least).select(source, F.col("window.start").alias("start"), "violations")


def daily_matches(matches: DataFrame, ts: str = "created_at", subscriber: str = "subscriber_id", hour: int = 7,
                  delay: str = "1 hour") -> DataFrame:
    """(subscriber, start, matches, best) per digest day, which runs from ``hour`` to ``hour``. State older than
    the watermark expires, so a match waits one day at most."""
    day = F.window(ts, "1 day", "1 day", f"{hour} hours")
    counted = matches.withWatermark(ts, delay).groupBy(day, subscriber).agg(
        F.count(F.lit(1)).alias("matches"), F.max("score").alias("best"))
    return counted.select(subscriber, F.col("window.start").alias("start"), "matches", "best")


# --- digests ----------------------------------------------------------------------------------------------


def digest_day(ts: str, hour: int = 7) -> Column:
    """The day whose digest, sent at ``hour``, shows what came at ``ts``."""
    return F.date_add(F.to_date(F.col(ts) - F.lit(timedelta(hours=hour))), 1)


def digest_item_stream(matches: DataFrame, notices: DataFrame, institutions: DataFrame, areas: DataFrame, hour: int = 7, delay: str = "1 hour",
                       earlier: str = "1 day", later: str = "1 hour") -> DataFrame:
    """Display rows of matches (id, subscriber_id, edital_id, score, created_at) with ``day`` and ``created_at``, as both sides arrive.

    ``notices`` are stored notices with ``seen_at``; a match meets the notice seen from ``earlier`` before it to ``later`` after
    it, which with the watermarks bounds what the join keeps of either side. Matches without a notice are dropped.
    """
    m = matches.select("id", "subscriber_id", "edital_id", "score", "created_at").withWatermark("created_at", delay)
    n = digest.shown_of_notices(notices, "seen_at").withColumnRenamed("edital_id", "notice_id").withWatermark("seen_at", delay)
    near = F.expr(f"edital_id = notice_id AND seen_at >= created_at - INTERVAL {earlier} AND seen_at <= created_at + INTERVAL {later}")
    return digest.display_rows(m.join(n, near), institutions, areas, digest_day("created_at", hour).alias("day"), "created_at")


def closed_digest_days(items: DataFrame, hour: int = 7, delay: str = "1 hour") -> DataFrame:
    """(day, subscriber_id) once the watermark has passed the hour at which the day's digest is due."""
    rows = items.select("subscriber_id", "created_at").withWatermark("created_at", delay)
    closed = rows.groupBy(F.window("created_at", "1 day", "1 day", f"{hour} hours"), "subscriber_id").agg(F.count(F.lit(1)).alias("items"))
    return closed.select(F.to_date("window.end").alias("day"), "subscriber_id")


def start_digests(items: str, item_schema: str, closed: DataFrame, out: str, checkpoint: str, subscribers: Callable[[], DataFrame],
                  **render: object) -> StreamingQuery:
    """Renders the digests of closed days from the item table (best partitioned by day), as batches of ``out``.

    State holds a count per subscriber and open day; the items themselves wait in the table, so a large digest is ranked
    and rendered in parts as in the batch job. A repeated micro-batch replaces its digests.
    """
    def process(rows: DataFrame, batch: int) -> None:
        due = cut_lineage(rows)
        days = due.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
        if days["first"] is None:
            return
        shown = rows.sparkSession.read.schema(item_schema).parquet(items).where(F.col("day").between(days["first"], days["last"]))
        shown = shown.join(due, ["day", "subscriber_id"], "left_semi")
        write_batch(digest.render_digests(shown, subscribers(), F.col("day"), by=("day", "subscriber_id"), **render), out, batch)

    return closed.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
