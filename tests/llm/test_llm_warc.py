"""WARC archives: round trips, pushed predicates, stepped-over payloads, foreign files, and the page query."""

import base64
import gzip
import hashlib
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from arauto.llm import op12_warc
from arauto.llm.op12_warc import Member, WarcReader, Window, archive_pages, member, page_record, read_warc, records, write_warc
from arauto.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    best = {}
    for page, _, html in rows:
        best[html or ""] = max((x for x in (best.get(html or ""), page) if x is not None), default=None)
    out = []
    for page, _, html in rows:
        first = best[html or ""] if len((html or "").encode()) >= least else page
        out.append((page, len((html or "").encode()), digest(html), "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x y\r\nz", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a/é", "other   ção"), (4, "u", None), (5, "u", ""), (6, "u", "v" * 300_000),
        (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (9, "u", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "only null"), (11, "r", "twice"), (11, "r", "twice"), (12, "r", "")]


def test_pages_equal_brute_force(spark):
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({"record_type": F.lit(1), "digest": F.lit("x"), "payload": F.lit(b"y"), "first": F.lit(3)})
    got = archive_pages(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)
    assert sorted((tuple(r) for r in archive_pages(pages, least_bytes=6).collect()), key=str) == brute(ROWS, 6)
    assert archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_the_query_reads_back_all_given_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_warc"](spark, SMALL).collect()), key=str) == brute(rows)


@pytest.fixture()
def archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op12_warc, "SPLIT_BYTES", 2000)  # the driver plans by it; workers wrote with their own
    rows = [("revisit" if i % 3 == 2 else "response", f"urn:page:{i}", f"http://h{i % 2}/{i}", datetime(2024, 1, 1 + i % 5), f"<p>{i}</p>".encode() * 50, "urn:page:0" if i % 3 == 2 else None) for i in range(40)]
    frame = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, date timestamp, payload binary, refers_to string")
    path = f"file://{tmp_path}/archive"
    write_warc(frame.repartition(3), path)
    return path, {r[1]: r for r in rows}


def test_round_trip_of_all_columns(spark, archive):
    path, rows = archive
    got = {r.record_id: r for r in read_warc(spark, path).where("record_type != 'warcinfo'").collect()}
    assert set(got) == set(rows)
    for ident, (kind, _, uri, date, payload, refers_to) in rows.items():
        r = got[ident]
        assert (r.record_type, r.target_uri, r.date, r.refers_to, r.payload_length) == (kind, uri, date, refers_to, len(payload))
        assert bytes(r.payload) == payload if kind == "response" else r.payload is None
        assert r.payload_digest == digest(payload.decode()) and r.payload_sha1 == (r.payload_digest if kind == "response" else None)
        assert r.headers["WARC-Type"] == kind and r.content_type.startswith("application/http")
    assert read_warc(spark, path, "record_type").where("record_type = 'warcinfo'").count() >= 1


@pytest.mark.parametrize("where", [
    "record_type = 'revisit'", "record_type IN ('revisit', 'warcinfo')", "record_type <> 'response'", "target_uri LIKE 'http://h1%'", "target_uri LIKE '%7'",
    "refers_to IS NOT NULL", "refers_to IS NULL", "refers_to <=> 'urn:page:0'", "refers_to <> 'urn:page:1'", "date >= timestamp'2024-01-03'", "payload_length > 450",
    "payload IS NULL", "record_type = 'response' AND payload_length <= 500 AND length(target_uri) > 3", "target_uri = 'a' OR record_id = 'urn:page:3'"])
def test_predicates_mean_what_spark_means(spark, archive, where):
    path, _ = archive
    whole = read_warc(spark, path).cache()
    whole.count()
    want = {r.record_id for r in whole.where(where).collect()}
    whole.unpersist()
    assert {r.record_id for r in read_warc(spark, path).where(where).select("record_id").collect()} == want


def test_header_predicates_leave_the_plan(spark, archive):
    path, rows = archive
    plan = lambda where: read_warc(spark, path, "record_type", "record_id").where(where)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan("record_type = 'revisit'") and "Filter (" in plan("length(record_type) = 7")
    assert read_warc(spark, path, "record_id", **{"WARC-Target-URI": "http://h0/4"}).collect()[0].record_id == "urn:page:4"
    reader = WarcReader(read_warc(spark, path).schema, {"path": path})
    left = list(reader.pushFilters([ds.EqualTo(("record_type",), "revisit"), ds.EqualTo(("payload",), b"x"), ds.EqualTo(("headers", "a"), "b")]))
    assert len(reader.filters) == 1 and len(left) == 2


def test_splits_without_the_asked_type_are_not_planned(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "_manifest-x.jsonl").write_text(json.dumps({"file": "f.warc.gz", "size": 30, "splits": [[0, ["response", "warcinfo"]], [10, ["revisit"]], [20, ["response"]]]}) + "\n")
    reader = WarcReader(read_warc(spark, str(folder)).schema, {"path": str(folder)})
    assert len(reader.partitions()) == 3
    list(reader.pushFilters([ds.EqualTo(("record_type",), "response")]))
    assert [(p.start, p.stop) for p in reader.partitions()] == [(0, 10), (20, 30)]


def test_uncommitted_archives_are_not_read(spark, archive):
    path, rows = archive
    folder = path.removeprefix("file://")
    with open(f"{folder}/part-lost.warc.gz", "wb") as f:
        f.write(member(page_record("response", "urn:lost", "u", "2024-01-01T00:00:00Z", b"lost", None)))
    assert read_warc(spark, path, "record_id", "record_type").where("record_type <> 'warcinfo'").count() == len(rows)
    frame = read_warc(spark, path).where("record_id = 'urn:page:3'")
    write_warc(spark.createDataFrame(frame.collect(), frame.schema), path, "overwrite")
    assert [r.record_id for r in read_warc(spark, path, "record_id", "record_type").where("record_type <> 'warcinfo'").collect()] == ["urn:page:3"]


class Counting:
    """A file that counts the bytes it gives."""

    def __init__(self, data):
        self.data, self.at, self.given = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.given += len(out)
        return out


def test_unwanted_payloads_are_neither_inflated_nor_read(monkeypatch):
    payloads = [os.urandom(2_000_000) for _ in range(3)]
    file = Counting(b"".join(member(page_record("response", f"urn:{i}", "u", "2024-01-01T00:00:00Z", p, None)) for i, p in enumerate(payloads)))
    inflated = []
    more = Member.more
    monkeypatch.setattr(Member, "more", lambda self, n: inflated.append(out := more(self, n)) or out)
    got = list(records(Window(file, 0), len(file.data), True, {"record_id", "payload_length", "payload"}, lambda r: r["record_id"] == "urn:1"))
    assert [r["record_id"] for r in got] == ["urn:1"] and got[0]["payload"] == payloads[1]
    assert sum(map(len, inflated)) < 2_100_000 and file.given < 2_600_000


def test_foreign_archives(spark, tmp_path):
    """Plain archives, members without sizes, folded headers, records that are not HTTP, broken dates."""
    page = page_record("response", "urn:1", "http://x", "2024-01-01T00:00:00Z", b"body" * 40_000, None)
    info = b"WARC/1.0\r\nwarc-type: metadata\r\nWARC-Record-ID: <urn:2>\r\nX-Long: one\r\n two\r\nWARC-Date: never\r\nContent-Type: text/plain\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(page + info + page)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(page) + gzip.compress(info) + member(info) + gzip.compress(page))
    (tmp_path / "notes.txt").write_bytes(b"not an archive")
    got = read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in got) == ["urn:1"] * 4 + ["urn:2"] * 3
    for r in got:
        assert bytes(r.payload) == (b"body" * 40_000 if r.record_id == "urn:1" else b"hello") and r.payload_length == len(r.payload)
        if r.record_id == "urn:2":
            assert r.headers["X-Long"] == "one two" and r.date is None and r.payload_digest is None
    assert read_warc(spark, f"{tmp_path}/b.warc.gz", "record_id").count() == 4
    assert read_warc(spark, str(tmp_path), "record_id", "record_type").where("record_type = 'metadata'").count() == 3
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(page)[:-400])
    with pytest.raises(Exception, match="cut off"):
        read_warc(spark, f"{tmp_path}/cut.warc.gz", "payload").collect()
