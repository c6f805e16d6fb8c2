"""Streams in event time: shuffled arrival over several micro-batches, restarts, and state that goes away."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arauto import dims, schemas
from arauto.operators import digest
from arauto.plans import ingest, q_stream
from arauto.session import ROCKSDB
from arauto.streaming import jobs

BASE = datetime(2026, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def files(spark, rows, schema, path, parts):
    """One file a part, so that each is a micro-batch of its own."""
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(spark, build, path, *closing):
    """Runs ``build()`` over its sources and past the closing time; the rows it wrote."""
    stream = build()
    q_stream.drain(lambda: jobs.write_stream(stream, f"{path}/out", f"{path}/ck"), *closing)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").collect()


def state(spark, path, variable, kind=None):
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return reader.load(f"{path}/ck").count()


@pytest.mark.parametrize("parts", [1, 5])
def test_changes_follow_event_time_however_rows_arrive(spark, tmp_path, parts):
    rnd = random.Random(parts)
    rows = [(f"k{rnd.randrange(6)}", BASE + timedelta(seconds=rnd.randrange(40_000)), i, rnd.choice([0, 1, 3, 0xFFFF, 0xFF00FF])) for i in range(300)]
    rows += [("k0", BASE + timedelta(seconds=5), 1000 + i, i % 2 * 0xFFFF) for i in range(4)] + [(None, BASE, 2000, 5)]  # ties, and a null key
    rnd.shuffle(rows)
    closing = q_stream.Closing(spark, "ts")
    captures = files(spark, rows, "key string, ts timestamp, seq long, simhash long", f"{tmp_path}/in", parts)
    got = finished(spark, lambda: jobs.change_stream(closing.behind(captures), "key", "ts", "seq"), tmp_path, closing)
    want, last = {}, {}
    for key, _, seq, value in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], r[2])):
        want[seq] = (key, value, last.get(key))
        last[key] = value
    assert {r.seq: (r.key, r.simhash, r.prior) for r in got} == want and len(got) == len(want)
    kind = lambda p, v: "insert" if p is None else "cosmetic" if bin(p ^ v).count("1") <= 3 else "update"
    assert all(r.change == kind(r.prior, r.simhash) for r in got)
    assert state(spark, tmp_path, "chunks") == 0 and state(spark, tmp_path, "parts") == 0 and state(spark, tmp_path, "last") == 6


def brute_pending(found, sent, hours=24):
    """What becomes of every match, one event after the other."""
    window, out, waiting = timedelta(hours=hours), [], {}
    for t, is_mark, key in sorted([(t, False, k) for k, t in found] + [(t, True, k) for k, t in sent]):
        created = waiting.get(key)
        if created is not None and t - created > window:
            out.append((key, created, "lapsed", created + window))
            created = None
        if not is_mark:
            created = t
        elif created is not None:
            out.append((key, created, "sent", t))
            created = None
        waiting[key] = created
    out += [(k, c, "lapsed", c + window) for k, c in waiting.items() if c is not None]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_pending_matches_are_sent_or_lapse_and_leave_no_state(spark, tmp_path, parts):
    rnd = random.Random(parts)
    at = lambda: BASE + timedelta(minutes=rnd.randrange(6 * 1440))
    found = [(f"m{rnd.randrange(25)}", at()) for _ in range(120)] + [("edge", BASE), ("late", BASE), ("tie", BASE), ("again", BASE), ("again", BASE + timedelta(hours=20))]
    sent = [(f"m{rnd.randrange(30)}", at()) for _ in range(80)]
    sent += [("edge", BASE + timedelta(hours=24)), ("late", BASE + timedelta(hours=24, seconds=1)), ("tie", BASE), ("again", BASE + timedelta(hours=40)), ("unknown", BASE)]
    rnd.shuffle(found), rnd.shuffle(sent)
    closing = q_stream.Closing(spark, "created_at")
    m = files(spark, found, "id string, created_at timestamp", f"{tmp_path}/found", parts)
    s = files(spark, sent, "id string, notified_at timestamp", f"{tmp_path}/sent", parts)
    got = finished(spark, lambda: jobs.pending_stream(closing.behind(m), s, delay="7 days"), tmp_path, closing)
    assert sorted((r.id, r.created_at, r.outcome, r.at) for r in got) == brute_pending(found, sent)
    assert {r.id: r.outcome for r in got if not r.id.startswith("m")} == {"edge": "sent", "late": "lapsed", "tie": "sent", "again": "sent"}
    assert [state(spark, tmp_path, v) for v in ("chunks", "parts", "created")] == [0, 0, 0]
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(f"{tmp_path}/ck")
    assert timers.count() == 0


def test_what_still_waits_is_the_only_state(spark, tmp_path):
    """The watermark has not passed the window yet: nothing comes out, one value waits."""
    found = [("a", BASE), ("b", BASE + timedelta(hours=30))]
    m = files(spark, found, "id string, created_at timestamp", f"{tmp_path}/found", 1)
    s = files(spark, [("x", BASE)], "id string, notified_at timestamp", f"{tmp_path}/sent", 1)
    got = finished(spark, lambda: jobs.pending_stream(m, s, delay="1 hour"), tmp_path)
    assert [(r.id, r.outcome) for r in got] == [("a", "lapsed")]
    assert state(spark, tmp_path, "created") == 0 and state(spark, tmp_path, "chunks") == 1  # b, whose minute is still open


def test_a_key_s_rows_wait_in_one_chunk_with_one_timer(spark, tmp_path):
    found = [(i % 2, BASE + timedelta(minutes=7 * i)) for i in range(200)]
    m = files(spark, found, "id bigint, created_at timestamp", f"{tmp_path}/found", 1)
    s = files(spark, [(9, BASE)], "id bigint, notified_at timestamp", f"{tmp_path}/sent", 1)
    assert not finished(spark, lambda: jobs.pending_stream(m, s, delay="30 days"), tmp_path)
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(f"{tmp_path}/ck")
    assert timers.count() == 3 and state(spark, tmp_path, "chunks") == 3


def test_rows_without_id_or_time_leave_the_others_whole(spark, tmp_path):
    found = [(i, BASE + timedelta(minutes=i)) for i in range(5)]
    sent = [(i, BASE + timedelta(hours=i + 1)) for i in range(5)]
    closing = q_stream.Closing(spark, "created_at")
    m = files(spark, [*found, (None, BASE), (7, None), (None, None)], "id bigint, created_at timestamp", f"{tmp_path}/found", 1)
    s = files(spark, [*sent, (None, BASE), (1, None)], "id bigint, notified_at timestamp", f"{tmp_path}/sent", 1)
    got = finished(spark, lambda: jobs.pending_stream(closing.behind(m), s, delay="7 days"), tmp_path, closing)
    assert sorted((r.id, r.created_at, r.outcome, r.at) for r in got) == brute_pending(found, sent)


def test_daily_digests_equal_the_batch_job(spark, tmp_path):
    rnd = random.Random(9)
    notices = [(f"n{i}", f"T{i}", "1" if i % 3 else None, rnd.choice(["mba", "doutorado"]), BASE + timedelta(hours=i)) for i in range(60)]
    matches = [(f"{n[0]}.{s}", s, n[0], rnd.choice([0.7, 1.0]), n[4] + timedelta(minutes=rnd.randrange(50))) for n in notices for s in "abc" if rnd.random() < 0.7]
    matches += [("far", "a", "n0", 1.0, BASE + timedelta(days=4)), ("none", "a", "n999", 1.0, BASE)]  # out of the join's reach, no notice
    names = [f.name for f in schemas.struct(schemas.NOTICES)]
    columns = "id string, titulo string, ies_id string, nivel string, seen_at timestamp"
    n = files(spark, notices, columns, f"{tmp_path}/n", 3)
    n = n.select(*[c if c in n.columns else F.lit(None).cast("string").alias(c) for c in names if c != "inscricao_ate"], F.lit(date(2026, 5, 1)).alias("inscricao_ate"), "seen_at")
    m = files(spark, matches, "id string, subscriber_id string, edital_id string, score double, created_at timestamp", f"{tmp_path}/m", 3)
    inst = spark.createDataFrame([("1", "USP")], "id string, nome string")
    people = spark.createDataFrame([("a", "A", "a@x", True), ("b", "B", "", True), ("c", "C", "", False)], "id string, nome string, email string, ativo boolean")
    items = jobs.digest_item_stream(m, n, inst, dims.areas(spark), delay="4 days")
    q_stream.drain(lambda: jobs.write_stream(items, f"{tmp_path}/items", f"{tmp_path}/ck", by=("day",)))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    closing = q_stream.Closing(spark, "created_at")
    closed = jobs.closed_digest_days(closing.behind(spark.readStream.schema(ddl).parquet(f"{tmp_path}/items")))
    start = lambda: jobs.start_digests(f"{tmp_path}/items", ddl, closed, f"{tmp_path}/out", f"{tmp_path}/ck2", lambda: people, part_size=4)
    q_stream.drain(start)
    early = spark.read.parquet(f"{tmp_path}/out").select("day").distinct().count()
    q_stream.drain(start, closing)
    got = sorted((str(r.day), r.subscriber_id, r.part, r.parts, r.total, r.subject, r.body_text, r.body_html) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    stored = spark.createDataFrame(notices, columns).drop("seen_at")
    stored = stored.select(*[c if c in stored.columns else F.lit(None).cast("string").alias(c) for c in names if c != "inscricao_ate"], F.lit(date(2026, 5, 1)).alias("inscricao_ate"))
    want = []
    by_day = {}
    for row in matches[:-2]:
        by_day.setdefault((row[4] - timedelta(hours=7)).date() + timedelta(days=1), []).append(row[:4])
    for day, rows in by_day.items():
        shown = digest.digest_items(spark.createDataFrame(rows, "id string, subscriber_id string, edital_id string, score double"), stored, inst, dims.areas(spark))
        for r in digest.render_digests(shown, people, F.lit(day), part_size=4).collect():
            want.append((str(day), r.subscriber_id, r.part, r.parts, r.total, r.subject, r.body_text, r.body_html))
    assert got == sorted(want) and {g[1] for g in got} == {"a", "b"} and max(g[3] for g in got) > 1
    assert 0 < early < len(by_day)
