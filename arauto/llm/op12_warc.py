"""WARC archives as a Python data source: planned partitions, predicates on headers, payloads decoded only where asked."""

from __future__ import annotations

import base64
import hashlib
import json
import operator
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arauto.llm.common import shared_folder, staged

#: What a record offers; a reader with a narrower schema fills no more than it names.
SCHEMA = (
    "record_type string, record_id string, target_uri string, date timestamp, payload_digest string, refers_to string, "
    "content_type string, content_length long, payload_length long, headers map<string, string>, payload binary, payload_sha1 string")
#: Columns that need the payload itself; all others come from headers, and their predicates are decided there.
DEEP = ("payload", "payload_sha1")
#: Bytes of an archive that one partition reads, and of payloads that one Arrow batch holds, about.
SPLIT_BYTES, BATCH_BYTES, BATCH_ROWS = 16 << 20, 8 << 20, 4096
#: Bytes read or inflated at a time.
STEP = 1 << 16
LEVEL = 1
INFO = "software: arauto\r\nformat: WARC File Format 1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_GZIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"  # one extra field: the member's compressed and plain size
_COLUMN = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "date",
           "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to", "content-type": "content_type", "content-length": "content_length"}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing --------------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value on one line: blanks and control characters are percent-encoded, a colon or percent sign stays."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(kind: str, ident: str, uri: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record that leaves the payload out but tells its digest and length."""
    revisit = kind == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{_clean(ident)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", None if uri is None else _clean(uri)), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Refers-To", f"<{_clean(refers_to)}>" if revisit and refers_to is not None else None),
        ("WARC-Profile", PROFILE if revisit else None), ("Content-Type", "application/http;msgtype=response")]
    return record(fields, http if revisit else http + payload)


def member(raw: bytes) -> bytes:
    """One gzip member of its own, with its sizes in an extra field, so that a reader can step over it unread."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = len(_GZIP) + 8 + len(body) + 8
    sizes = struct.pack("<II", size, len(raw)) if max(size, len(raw)) < 2**32 else bytes(8)
    return _GZIP + sizes + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Written(ds.WriterCommitMessage):
    line: str


class WarcWriter(ds.DataSourceArrowWriter):
    """One archive a task. Only archives that the committed manifest names are ever read, so failed and repeated tasks
    leave no record; their files are merely left over."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at, splits = 0, []
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:

            def put(kind: str, raw: bytes) -> None:
                nonlocal at
                if not splits or at - splits[-1][0] >= SPLIT_BYTES:
                    splits.append((at, set()))
                splits[-1][1].add(kind)
                data = member(raw)
                out.write(data)
                at += len(data)

            put("warcinfo", record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _date(datetime.now(UTC))),
                                    ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], INFO.encode()))
            for batch in iterator:
                for row in range(batch.num_rows):
                    kind, ident, uri, date, payload, refers_to = (batch.column(c)[row].as_py() for c in ("record_type", "record_id", "target_uri", "date", "payload", "refers_to"))
                    put(kind or "response", page_record(kind or "response", ident, uri, _date(date), payload or b"", refers_to))
        return Written(json.dumps({"file": name, "size": at, "splits": [[a, sorted(k)] for a, k in splits]}))

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        old = _manifests(store, folder) if self.overwrite else []
        with store.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.jsonl", compression=None) as out:
            out.write("".join(f"{m.line}\n" for m in messages if m).encode())
        for path in old:  # readers switch to the new manifest; the archives of the old one are left over
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        pass


def _date(when: datetime | None) -> str:
    """A null date is the epoch."""
    return (when or datetime.fromtimestamp(0, UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _manifests(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.startswith("_manifest-"))


# --- reading --------------------------------------------------------------------------------------------------------------


class Window:
    """A forward view of part of a file that may step over bytes without reading them."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data = file, at, b""

    def peek(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end of the file."""
        if len(self.data) < n:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(n - len(self.data), STEP))
        return self.data[:n]

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


class Plain:
    """A record's bytes in an archive that is not compressed."""

    def __init__(self, window: Window):
        self.window, self.used = window, 0

    def more(self, n: int) -> bytes:
        out = self.window.peek(self.used + n)[self.used :]
        self.used += len(out)
        return out

    def end(self, total: int) -> None:
        self.window.skip(total)


class Member:
    """A gzip member's bytes, inflated as far as they are asked for."""

    def __init__(self, window: Window):
        self.window, self.start, self.stop = window, window.at, None
        head = window.peek(10)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {window.at}")
        if head[3] & 4:
            extra = window.peek(12 + struct.unpack("<H", window.peek(12)[10:])[0])[12:]
            while len(extra) >= 4:
                tag, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if tag == b"sl" and n == 8 and (size := struct.unpack("<I", extra[4:8])[0]):
                    self.stop = self.start + size
                extra = extra[4 + n :]
        self.inflate = zlib.decompressobj(31)

    def more(self, n: int) -> bytes:
        out = b""
        while len(out) < n and not self.inflate.eof:
            data = self.inflate.unconsumed_tail
            if not data:
                room = min(STEP, max(512, n))
                data = self.window.peek(room if self.stop is None else min(room, self.stop - self.window.at))
                self.window.skip(len(data))
            got = self.inflate.decompress(data, n - len(out))
            if not data and not got and not self.inflate.eof:
                raise ValueError(f"the member at byte {self.start} is cut off")
            out += got
        return out

    def end(self, total: int) -> None:
        if self.stop is not None:
            self.window.skip(self.stop - self.window.at)
            return
        while not self.inflate.eof:  # inflated but not kept: only the end tells where the next member begins
            self.more(STEP)
        rest = self.inflate.unused_data
        self.window.data, self.window.at = rest + self.window.data, self.window.at - len(rest)


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def _until_blank(source: Plain | Member, data: bytes) -> tuple[bytes, bytes]:
    """(header block, bytes after it), reading on until the blank line."""
    looked = 0
    while (i := data.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
        looked = len(data)
        more = source.more(max(1024, len(data)))
        if not more:
            raise ValueError("a header block does not end")
        data += more
    return data[:i], data[i + 4 :]


def _timestamp(value: str | None) -> datetime | None:
    try:
        return None if value is None else datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(UTC)
    except ValueError:
        return None


def records(window: Window, stop: int, gzip: bool, wanted: set[str], accept) -> Iterator[dict]:
    """Records that begin before ``stop`` and whose header columns ``accept`` takes; others are stepped over."""
    while window.at < stop and window.peek(1):
        if window.peek(1) in (b"\r", b"\n"):
            window.skip(1)
            continue
        source = Member(window) if gzip else Plain(window)
        head, rest = _until_blank(source, b"")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {window.at}")
        fields = _fields(head.partition(b"\r\n")[2])
        row: dict = {"headers": fields}
        for k, v in fields:
            if name := _COLUMN.get(k.lower()):
                row[name] = v.removeprefix("<").removesuffix(">") if name in ("record_id", "refers_to") else v
        length = row["content_length"] = int(row.get("content_length", 0))
        row["date"] = _timestamp(row.get("date"))
        row["payload_digest"] = (row.get("payload_digest") or "").removeprefix("sha1:") or None
        before = len(head) + 4
        http, body = row.get("content_type", "").startswith("application/http"), None
        row["payload_length"] = length
        if http and length and wanted & {"payload_length", *DEEP}:
            answer, body = _until_blank(source, rest)
            named = [v for k, v in _fields(answer) if k.lower() == "content-length"]
            before += len(answer) + 4
            length -= len(answer) + 4
            row["payload_length"] = int(named[0]) if named and named[0].isdigit() else length
        if accept(row):
            if row.get("record_type") != "revisit" and wanted & set(DEEP):
                parts = [rest if body is None else body]
                missing = length - len(parts[0])
                while missing > 0:
                    parts.append(source.more(missing))
                    if not parts[-1]:
                        raise ValueError("a payload is cut off")
                    missing -= len(parts[-1])
                payload = b"".join(parts)[:length]
                row["payload"] = payload
                if "payload_sha1" in wanted:
                    row["payload_sha1"] = base32_sha1(payload)
            yield row
        source.end(before + length + 4)


_COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le,
            ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains}


def decides(f: ds.Filter) -> bool:
    """Whether the headers alone decide a predicate."""
    if isinstance(f, ds.Not):
        return type(f.child) in (ds.EqualTo, ds.In) and decides(f.child)
    known = type(f) in _COMPARE or isinstance(f, ds.EqualNullSafe | ds.In | ds.IsNull | ds.IsNotNull)
    return known and len(f.attribute) == 1 and f.attribute[0] not in (*DEEP, "headers")


def holds(f: ds.Filter, row: dict) -> bool:
    """SQL's meaning: a comparison with null does not hold, and neither does its negation."""
    if isinstance(f, ds.Not):
        return row.get(f.child.attribute[0]) is not None and not holds(f.child, row)
    value = row.get(f.attribute[0])
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return (value is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if isinstance(value, datetime) and isinstance(getattr(f, "value", None), datetime) and f.value.tzinfo is None:
        value = value.replace(tzinfo=None)
    if value is None:
        return False
    return value in f.value if isinstance(f, ds.In) else _COMPARE[type(f)](value, f.value)


@dataclass
class Split(ds.InputPartition):
    file: str
    start: int
    stop: int


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.headers = {k.lower().removeprefix("header."): v for k, v in options.items() if k.lower().startswith("header.")}
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if decides(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Split]:
        """Splits of the manifests' archives, but for those that hold no record of an asked type. A folder without a manifest
        (or a single file) is read file by file."""
        store, folder = fs.FileSystem.from_uri(self.path)
        top = store.get_file_info(folder)
        if top.type == fs.FileType.File:
            return [Split(folder, 0, top.size)]
        by_type = [f for f in self.filters if getattr(f.child if isinstance(f, ds.Not) else f, "attribute", None) == ("record_type",)]
        out, manifests = [], _manifests(store, folder)
        for path in manifests:
            with store.open_input_stream(path, compression=None) as lines:
                for line in lines.read().decode().splitlines():
                    entry = json.loads(line)
                    edges = [a for a, _ in entry["splits"]] + [entry["size"]]
                    for (start, kinds), stop in zip(entry["splits"], edges[1:], strict=True):
                        if any(all(holds(f, {"record_type": k}) for f in by_type) for k in kinds):
                            out.append(Split(f"{folder}/{entry['file']}", start, stop))
        if not manifests:
            files = store.get_file_info(fs.FileSelector(folder))
            out = [Split(f.path, 0, f.size) for f in files if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]
        return out

    def _accept(self, row: dict) -> bool:
        if self.headers:
            have = {k.lower(): v for k, v in row["headers"]}
            if any(have.get(k) != v for k, v in self.headers.items()):
                return False
        return all(holds(f, row) for f in self.filters)

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of a plan without partitions
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        schema = to_arrow_schema(self.schema)
        names = self.schema.fieldNames()
        wanted = {*names, *(f.attribute[0] for f in self.filters if not isinstance(f, ds.Not)), *(f.child.attribute[0] for f in self.filters if isinstance(f, ds.Not))}
        rows, size = [], 0
        with store.open_input_file(partition.file) as file:
            window = Window(file, partition.start)
            for row in records(window, partition.stop, partition.file.endswith(".gz"), wanted, self._accept):
                rows.append([dict(row["headers"]) if n == "headers" else row.get(n) for n in names])
                size += len(row.get("payload") or b"") if "payload" in names else 0
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield self._batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows, schema)

    def _batch(self, rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in col], f.type) for f, col in zip(schema, zip(*rows, strict=True), strict=True)], schema=schema)


class WarcDataSource(ds.DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").mode("append").save(folder)``.

    Rows to write have record_type (response or revisit), record_id, target_uri, date, payload and refers_to; a revisit's
    payload gives its digest and length and is left out. The option ``header.<Name>`` asks for records with that header
    value. The folder is in a store that pyarrow opens (local, shared mount, hdfs, s3, gs).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, *columns: str, **headers: str) -> DataFrame:
    """The records under ``path``, or only their named columns: a payload is decoded only if payload or payload_sha1 is one."""
    register(spark)
    types = dict(c.strip().split(" ", 1) for c in SCHEMA.replace("map<string, string>", "map<string;string>").split(","))
    reader = spark.read.format("warc").options(**{f"header.{k}": v for k, v in headers.items()})
    if columns:
        reader = reader.schema(", ".join(f"{c} {types[c].replace(';', ', ')}" for c in columns))
    return reader.load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append") -> None:
    register(rows.sparkSession)
    rows.select("record_type", "record_id", "target_uri", F.col("date").cast("timestamp").alias("date"), F.col("payload").cast("binary").alias("payload"), "refers_to").write.format("warc").mode(mode).save(path)


# --- pages ----------------------------------------------------------------------------------------------------------------


def page_records(pages: DataFrame, least_bytes: int = 0, date: Column | None = None) -> DataFrame:
    """Rows to write, one a page: payloads of ``least_bytes`` and more that several pages share are kept once.

    Of such pages the one with the largest page_id is the response (a null page_id is smaller than any, rows that repeat
    it are responses too), the others revisit it. Only digests are grouped, combined before the shuffle; those that
    repeat come back by a join whose large side AQE may split, and without repeats no page is shuffled at all.
    """
    date = F.lit("2024-01-01T00:00:00Z").cast("timestamp") if date is None else date
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    key = F.when(F.octet_length("payload") >= least_bytes, F.sha2("payload", 256)).alias("digest")
    same = rows.select("page_id", key).where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = staged(same.where("n > 1").select("digest", "first", F.lit(True).alias("shared")), "shared-payloads")
    joined = rows.withColumn("digest", key).join(shared, "digest", "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    ident = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), ident("page_id").alias("record_id"), "target_uri", date.alias("date"),
        "payload", F.when(revisit, ident("first")).alias("refers_to"))


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives it is written to.

    The archives go to ``path`` (a fresh folder of the shared one by default) and stay there. A response's bytes and digest
    are taken from the payload as read; a revisit's from its headers, its payload being elsewhere. A null html is empty; a
    null page_id reads back as null; a null url gives a record without a target; repeated rows are records each; an
    empty table gives archives without records of pages. Other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages, least_bytes), path)
    page = lambda c: F.expr(f"try_cast(substr({c}, 10) AS bigint)")
    full = read_warc(spark, path, "record_type", "record_id", "payload", "payload_sha1").where("record_type = 'response'")
    light = read_warc(spark, path, "record_type", "record_id", "refers_to", "payload_length", "payload_digest").where("record_type = 'revisit'")
    return full.select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(light.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to")))
