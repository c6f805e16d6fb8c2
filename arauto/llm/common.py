"""Shared pieces of the operators: row keys, staged tables, and numpy kernels over whole Arrow batches of text."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are taken into numpy in slices of about so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20

_LOCAL: dict[str, str] = {}  #: temporary folders of local sessions, by application

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
S29, S32 = np.uint64(29), np.uint64(32)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session (one machine, one process) gets a temporary
    folder; on a cluster that is an error, as executors could not share files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="llm-")
    return _LOCAL[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rowkey, doc_id, text, kept_...): the columns the window operators read, and those of ``keep``.

    ``rowkey`` hashes doc_id and text, so rows that repeat one doc_id with other texts stay apart and identical rows
    share a result.
    """
    return docs.select(F.xxhash64("doc_id", "text").alias("rowkey"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])


def kept_schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    """DDL of the columns ``keep`` under their kept_ names, to append to a schema."""
    return "".join(f", kept_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64."""
    x = (x ^ (x >> S32)) * K3
    x = (x ^ (x >> S29)) * K2
    return x ^ (x >> S32)


def join_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a string from the identifiers of its two (adjoining or overlapping) parts."""
    y = a * K1
    y += b * K2
    y ^= y >> S32
    y *= K3
    y ^= y >> S29
    return y


class Texts:
    """Texts of an Arrow column as one byte buffer; nulls are empty."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        base = int(offsets[0])
        size = int(offsets[-1]) - base
        self.bytes = np.frombuffer(data, np.uint8, size, base) if size else np.zeros(0, np.uint8)
        self.starts, self.ends = offsets[:-1] - base, offsets[1:] - base


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = cut[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(cut, done + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def lean(run: Callable) -> Callable:
    """``run`` over batches, after which the memory that the task freed goes back to the system: the worker lives on, and what
    it keeps is missing to the JVM and to the workers of later stages."""

    @functools.wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return done


def words_of(t: Texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, text number) of every word, and the bytes (A-Z lower-cased if asked)."""
    b = t.bytes
    if lower:
        b = np.where((b >= 65) & (b <= 90), b | 32, b)
    solid = np.ones(len(b) + 1, bool)
    solid[:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    solid[-1] = False
    edge = np.zeros(len(b) + 1, bool)  # a text begins here
    edge[t.starts] = True
    edge[-1] = True
    before = np.empty(len(b), bool)
    if len(b):
        before[0] = False
        before[1:] = solid[: len(b) - 1]
    begin = np.flatnonzero(solid[:-1] & (~before | edge[:-1]))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge[1:])) + 1
    return begin, end, np.searchsorted(t.starts, begin, "right") - 1 if len(t.starts) else begin, b


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = np.uint64(pow(int(K1), -1, 2**64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((K1, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_ids(b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each word from a rolling hash of the buffer."""
    up, down = _powers(len(b) + 1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=c[1:])
    return mix((c[end] - c[begin]) * down[begin] + (end - begin).astype(np.uint64) * K2)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary cells from one array and element offsets."""
    data = np.ascontiguousarray(data)
    o = (offsets.astype(np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(o) - 1, [None, pa.py_buffer(o.tobytes()), pa.py_buffer(data.tobytes())])
