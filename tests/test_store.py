"""Stored tables: versions by prefix, marks of jobs that run beside the ingest, fixed batch times."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from arauto.operators import tables
from arauto.plans import ingest
from arauto.streaming import jobs
from test_extract import NOW, day_pages, dimensions

SCHEMA = "k string, a int, b string, prefix_of string"


def store(path, digits=1):
    return tables.Store(str(path), SCHEMA, ("k",), ("b",), "prefix_of", digits)


def test_batches_equal_sequential_application(spark, tmp_path):
    rnd, s, want, history = random.Random(3), store(tmp_path / "t"), {}, []
    for batch in range(4):
        rows = [(f"k{rnd.randrange(40)}", i, rnd.choice([None, f"b{batch}.{i}"]), i) for i in range(rnd.choice([1, 25]))]
        frame = spark.createDataFrame(rows, "k string, a int, b string, seq int").withColumn("prefix_of", F.col("k"))
        for _ in range(2):  # a repeated batch starts from what was there before it
            s.upsert(frame, batch, ["seq"])
        for k, a, b, _ in rows:
            want[k] = (want[k][0] if k in want else a, b, batch)
        history.append(dict(want))
    state = lambda **kw: {r.k: (r.a, r.b, r.changed_in) for r in s.current(spark, **kw).collect()}
    assert state() == want and all(state(below=b + 1) == history[b] for b in range(4))


def test_untouched_prefixes_are_neither_read_nor_written(spark, tmp_path):
    s = store(tmp_path / "t")
    rows = spark.range(400).selectExpr("'k' || id AS k", "int(id) AS a", "'x' AS b", "'k' || id AS prefix_of")
    assert len(s.upsert(rows, 0, ["a"]).prefixes) == 16
    one = rows.where("k = 'k7'")
    (prefix,) = s.prefixes(one)
    files = s.current(spark, 1, [prefix]).inputFiles()
    assert files and all(f"/prefix={prefix}/" in f for f in files)
    assert s.upsert(one.withColumn("b", F.lit("y")), 1, ["a"]) == tables.Written([prefix], 1)
    assert s.versions(spark) == {p: int(p == prefix) for p in s.versions(spark)} and len(s.versions(spark)) == 16
    files = s.current(spark).inputFiles()
    assert not any(f"/batch=0/prefix={prefix}/" in f for f in files) and s.current(spark).count() == 400
    assert s.upsert(rows.where("false"), 2, ["a"]) == tables.Written([], 0) and s.current(spark).where("b = 'y'").count() == 1


def test_superseded_versions_go_and_readers_keep_two(spark, tmp_path):
    s = store(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "x", "a")], SCHEMA)
    for batch in range(5):
        s.upsert(rows.withColumn("b", F.lit(f"x{batch}")), batch, ["a"])
    assert [f.split("batch=")[1][0] for f in s.superseded(spark, keep=2)] == ["0", "1"]
    s.vacuum(spark, keep=2)
    assert s.superseded(spark, keep=2) == [] and s.current(spark).first().b == "x4" and s.current(spark, below=4).first().b == "x3"
    assert s.current(spark, below=2).count() == 0


def test_an_absent_store_is_empty(spark, tmp_path):
    s = store(tmp_path / "nothing")
    assert s.current(spark).count() == 0 and s.versions(spark) == {} and s.superseded(spark) == []
    assert s.current(spark).columns == ["k", "a", "b", "prefix_of", "changed_in"]


def test_a_batch_keeps_the_time_of_its_first_attempt(spark, tmp_path):
    at = lambda batch, t: spark.range(1).select(tables.batch_clock(spark, str(tmp_path / "c"), batch, F.lit(t)).alias("t")).first().t
    first, later = datetime(2026, 2, 1, 8, 0, 0, 123456), datetime(2026, 2, 1, 9)
    assert at(0, first) == first and at(0, later) == first and at(1, later) == later


def test_stream_digest_stream_digest_sends_once(spark, tmp_path):
    """The digest's marks outlive whatever the ingest writes in between, until a match is found again."""
    root, source, ck = str(tmp_path / "root"), str(tmp_path / "in"), str(tmp_path / "ck")
    d, sent = dimensions(spark), []

    def stream(pages, now):
        pages.coalesce(1).write.mode("append").parquet(source)
        jobs.start_ingest(spark, source, root, ck, lambda: d, lambda: F.lit(now)).awaitTermination()

    def digest(run, now):
        ingest.run_digest(spark, root, d, run, F.lit("2026-02-01"), F.lit(now), sink=lambda rows: sent.append(rows.count()))

    hour = lambda n: NOW + timedelta(hours=n)
    stream(day_pages(spark), NOW)
    digest(0, hour(1))
    stream(day_pages(spark, at=hour(2)), hour(2))  # the same notices again: cosmetic
    digest(1, hour(3))
    assert sent == [1, 0]
    assert [(m.notified, m.notified_at) for m in ingest.current_matches(spark, root).collect()] == [(True, hour(1))]
    digest(0, hour(1))  # a repeated run sends the same again
    assert sent == [1, 0, 1]
    changed = " algoritmos " + " ".join(f"novo{i} texto{i}" for i in range(40))
    stream(day_pages(spark, changed, at=hour(4)), hour(4))
    assert [m.notified for m in ingest.current_matches(spark, root).collect()] == [False]
    digest(2, hour(5))
    digest(3, hour(6))
    assert sent == [1, 0, 1, 1, 0]


def test_expiry_marks_stay_beside_the_ingest(spark, tmp_path):
    root, d = str(tmp_path / "root"), dimensions(spark)
    ingest.run_batch(day_pages(spark), d, root, 0, F.lit(NOW))
    ingest.run_expiry(spark, root, 0, F.lit(date(2026, 4, 1)), F.lit(NOW))
    over = lambda: {r.canonical_hash for r in ingest.current_notices(spark, root).where("status = 'expirado'").collect()}
    first = over()
    assert len(first) >= 1
    other = day_pages(spark, at=NOW).where("source = 'enap'").withColumn("url", F.lit("https://enap/2"))
    ingest.run_batch(other, d, root, 1, F.lit(NOW))
    assert over() == first
    ingest.run_batch(day_pages(spark, at=NOW), d, root, 2, F.lit(NOW))  # captured again: open until the next run
    assert not over() & first or over() < first
    ingest.run_expiry(spark, root, 1, F.lit(date(2026, 4, 1)), F.lit(NOW))
    assert over() == first
