"""Repeated windows of tokens, exactly, without shipping every window.

Both window operators work on identifiers that double in length (id of 2m tokens = ids of its two halves). Of each
window of ``n`` tokens the smallest identifier of a ``q``-token part is its *anchor*; neighbouring windows that share
an anchor form a *run*, so equal windows always meet in runs whose anchors have equal identifiers.

1. Every run ships (anchor id, id of all tokens its windows cover, document). A run whose cover also occurs in an
   earlier document is removed whole (*bulk*). Runs that share an anchor but not a cover are *fine*.
2. Only fine runs go on, as the ids of their single windows or, where a token is a byte, as the bytes of their cover,
   which are fewer; windows that occur earlier are removed.

Slices of text settle their own repeats first, so a hot passage costs one entry a slice, however many documents hold
it. Texts are shuffled once, by row key, and all passes read that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import K2, S32, Texts, binaries, join_ids, lean, mix, slices, width

LOW = np.uint64(0xFFFFFFFF)
SHIP = "bucket int, settled boolean, rowkeys binary, ks binary, counts binary, gram binary, cover binary, place binary, span binary"
FLAGS = "rowkey long, fine boolean, data binary"


@dataclass(frozen=True)
class Windows:
    """What a window is. ``tokens`` gives a slice's token ids and each text's first token and token count."""

    tokens: Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray]]
    ladder: tuple[int, ...]  #: lengths 1 < ... < q < ... < n, each at most twice the one before
    q: int  #: length of the part that anchors a window
    own: bool  #: an earlier start in the same document counts too
    letters: np.ndarray | None = None  #: token ids by byte, where a token is a byte; fine runs then ship bytes

    @property
    def n(self) -> int:
        return self.ladder[-1]

    def ids(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all q-token and n-token strings by start; each level is built from the one below."""
        have, at_q = 1, x
        for length in self.ladder:
            x = join_ids(x[: max(0, len(x) - (length - have))], x[length - have :])
            have = length
            if length == self.q:
                at_q = x
        return at_q, x

    def runs(self, t: Texts) -> dict[str, np.ndarray]:
        """Runs of the slice in order: first and last window start, anchor and cover ids, text number, rank in its text."""
        x, first, count = self.tokens(t)
        at_q, at_n = self.ids(x)
        good = np.zeros(len(x) + 1, np.int32)
        long = count >= self.n
        np.add.at(good, first[long], 1)
        np.add.at(good, (first + count - self.n + 1)[long], -1)
        starts = np.flatnonzero(np.cumsum(good[: len(at_n)]))
        least = (at_q & ~LOW) | np.arange(len(at_q), dtype=np.uint64)
        w, m = self.n - self.q + 1, 1
        while m < w:
            step = min(m, w - m)
            least = np.minimum(least[: len(least) - step], least[step:])
            m += step
        anchor = (least[starts] & LOW).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        lo, hi, a = starts[begin], starts[np.append(begin[1:], len(starts)) - 1] if len(begin) else starts[begin], anchor[begin]
        doc = np.searchsorted(first, lo, "right") - 1
        doc_first = np.searchsorted(doc, np.arange(len(first)))
        cover = join_ids(join_ids(at_n[lo], at_n[hi]), mix(((hi - lo) << 20 | (a - lo)).astype(np.uint64) ^ K2))
        return {"lo": lo, "hi": hi, "gram": at_q[a], "cover": cover, "doc": doc, "rank": np.arange(len(lo)) - doc_first[doc], "first": first, "count": count, "at_n": at_n}


def _settle(ids: np.ndarray, k: np.ndarray, doc: np.ndarray, own: bool) -> np.ndarray:
    """Entries that repeat, within the slice, what a smaller k (or, if own, the same text) has before; entries stand in text order."""
    order = np.lexsort((np.arange(len(ids)), k, ids))
    i, kk, d = ids[order], k[order], doc[order]
    head = np.ones(len(i), bool)
    head[1:] = i[1:] != i[:-1]
    least = kk[np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))] if len(i) else kk
    late = kk > least
    if own:
        late[1:] |= (~head[1:]) & (d[1:] == d[:-1])
    out = np.zeros(len(i), bool)
    out[order] = late
    return out


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n]


def _wide(cells: list, n: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, n)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :n] = raw
    return out.view(np.uint64).ravel()


def _pack(bucket: np.ndarray, settled: bool, doc: np.ndarray, rowkey: np.ndarray, k: np.ndarray, place: np.ndarray, gram=None, cover=None, raw: tuple | None = None) -> pa.RecordBatch | None:
    """One row a bucket: the documents in it, how many entries each has, and the entries: places (as steps of 16 bits where
    they are small), ids cut to 4 and 7 bytes (the bucket adds more; together over 90 bits), or bytes with their spans."""
    if not len(bucket):
        return None
    order = np.lexsort((place, doc, bucket))
    bucket, doc, place = bucket[order], doc[order], place[order]
    part = np.ones(len(doc), bool)
    part[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(part)
    counts = np.diff(np.append(at, len(doc))).astype(np.uint32)
    rows = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    by_entry, by_doc = np.append(rows, len(doc)), np.searchsorted(at, np.append(rows, len(doc)))
    step = np.diff(place, prepend=0)
    step[at] = place[at]
    places = step.astype(np.uint16) if step.max() < 1 << 16 else place.astype(np.uint32)
    none = binaries(np.zeros(0, np.uint8), by_entry * 0)
    ids = lambda x, n: binaries(_low_bytes(x[order], n).ravel(), by_entry * n) if x is not None else none
    covers, spans = ids(cover, 7), none
    if raw is not None:
        buffer, start, size = raw
        start, size = start[order], size[order]
        total = np.append(0, np.cumsum(size))
        covers = binaries(buffer[np.repeat(start - total[:-1], size) + np.arange(total[-1])], total[by_entry])
        spans = binaries(size.astype(np.uint16), by_entry)
    owner = doc[at]
    columns = [
        pa.array(bucket[rows].astype(np.int32)), pa.array(np.full(len(rows), settled)), binaries(rowkey[owner], by_doc), binaries(k[owner], by_doc), binaries(counts, by_doc),
        ids(gram, 4), covers, binaries(places, by_entry), spans,
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SHIP.split(", ")])


def _unpack(table: pa.Table) -> dict[str, np.ndarray]:
    cat = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    places = []
    for counts, cell in zip(table["counts"].to_pylist(), table["place"].to_pylist(), strict=True):
        n = np.frombuffer(counts, np.uint32).astype(np.int64)
        if len(cell) == 2 * int(n.sum()):
            total = np.cumsum(np.frombuffer(cell, np.uint16), dtype=np.int64)
            before = np.append(0, total)[np.append(0, np.cumsum(n)[:-1])]
            places.append(total - np.repeat(before, n))
        else:
            places.append(np.frombuffer(cell, np.uint32).astype(np.int64))
    return {"rowkey": cat("rowkeys", np.int64), "k": cat("ks", np.int64), "counts": cat("counts", np.uint32), "place": np.concatenate(places) if places else np.zeros(0, np.int64)}


def _by_document(e: dict[str, np.ndarray], keep: np.ndarray, fine: np.ndarray | None) -> pa.Table:
    """(rowkey, fine, data): the kept places of each document; data holds 2 * place + 1 where fine."""
    doc = np.repeat(np.arange(len(e["counts"])), e["counts"])[keep]
    flag = fine[keep] if fine is not None else np.zeros(len(doc), bool)
    data = e["place"][keep].astype(np.uint32) * np.uint32(2) + flag.astype(np.uint32)
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    any_fine = np.logical_or.reduceat(flag, at) if len(at) else np.zeros(0, bool)
    return pa.table([pa.array(e["rowkey"][doc[at]]), pa.array(any_fine), binaries(data, np.append(at, len(doc)))], names=["rowkey", "fine", "data"])


def _columns(batch: pa.RecordBatch) -> tuple[Texts, np.ndarray, np.ndarray]:
    k = batch.column("doc_id").fill_null(2**63 - 1)  # a null doc_id comes last
    return Texts(batch.column("text")), batch.column("rowkey").to_numpy(), k.to_numpy()


def ship_runs(win: Windows, buckets: int):
    """Map side of step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, rowkey, k = _columns(batch)
            r = win.runs(t)
            late = _settle(r["cover"], k[r["doc"]], r["doc"], win.own)
            bucket = ((r["gram"] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            for settled, of in ((False, ~late), (True, late)):
                at = bucket[of] if not settled else (np.zeros(int(of.sum()), np.int64) + int(rowkey[0]) % buckets)
                out = _pack(at, settled, r["doc"][of], rowkey, k, r["rank"][of], *((r["gram"][of], r["cover"][of]) if not settled else ()))
                if out is not None:
                    yield out

    return run


def judge_runs(table: pa.Table) -> pa.Table:
    """Reduce side of step 1: bulk and fine runs of one bucket of anchors, and the settled ones that pass through."""
    settled = table.filter(table["settled"])
    done = _unpack(settled)
    out = _by_document(done, np.ones(len(done["place"]), bool), None)
    table = table.filter(pa.compute.invert(table["settled"]))
    e = _unpack(table)
    gram, cover = _wide(table["gram"].to_pylist(), 4), _wide(table["cover"].to_pylist(), 7)
    k = np.repeat(e["k"], e["counts"])
    order = np.lexsort((k, cover, gram))
    g, c, kk = gram[order], cover[order], k[order]
    n = len(g)
    if not n:
        return out
    new_g = np.append(True, g[1:] != g[:-1])
    new_c = new_g | np.append(True, c[1:] != c[:-1])
    least = kk[np.maximum.accumulate(np.where(new_c, np.arange(n), 0))]
    bulk = kk > least
    covers = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_g))
    fine = (covers[np.cumsum(new_g) - 1] > 1) & ~bulk
    keep, is_fine = np.zeros(n, bool), np.zeros(n, bool)
    keep[order], is_fine[order] = bulk | fine, fine
    return pa.concat_tables([out, _by_document(e, keep, is_fine)])


def _places(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells or ()), np.uint32)


def ship_windows(win: Windows, buckets: int):
    """Map side of step 2, over documents with fine runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, rowkey, k = _columns(batch)
            r = win.runs(t)
            run_first = np.searchsorted(r["doc"], np.arange(len(rowkey)))
            fine = [run_first[d] + (p[p & 1 == 1] >> 1) for d, cells in enumerate(batch.column("data").to_pylist()) for p in [_places(cells)]]
            at = np.unique(np.concatenate(fine).astype(np.int64)) if fine else np.zeros(0, np.int64)
            sizes = r["hi"][at] - r["lo"][at] + 1
            if win.letters is not None:
                doc, bucket = r["doc"][at], ((r["gram"][at] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                out = _pack(bucket, False, doc, rowkey, k, r["lo"][at] - r["first"][doc], raw=(t.bytes, r["lo"][at], sizes + win.n - 1))
                if out is not None:
                    yield out
                continue
            start = np.repeat(r["lo"][at] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()) if len(at) else at
            doc = np.repeat(r["doc"][at], sizes)
            ids = r["at_n"][start]
            late = _settle(ids, k[doc], doc, win.own)
            place = start - r["first"][doc]
            bucket = ((ids >> S32) % np.uint64(buckets)).astype(np.int64)
            for settled, of in ((False, ~late), (True, late)):
                b = bucket[of] if not settled else (np.zeros(int(of.sum()), np.int64) + int(rowkey[0]) % buckets)
                out = _pack(b, settled, doc[of], rowkey, k, place[of], cover=None if settled else ids[of])
                if out is not None:
                    yield out

    return run


def judge_windows(table: pa.Table) -> pa.Table:
    """Reduce side of step 2: windows that occur in an earlier document."""
    done = _unpack(table.filter(table["settled"]))
    out = _by_document(done, np.ones(len(done["place"]), bool), None)
    table = table.filter(pa.compute.invert(table["settled"]))
    e = _unpack(table)
    ids, k = _wide(table["cover"].to_pylist(), 7), np.repeat(e["k"], e["counts"])
    order = np.lexsort((k, ids))
    i, kk = ids[order], k[order]
    if not len(i):
        return out
    new = np.append(True, i[1:] != i[:-1])
    late = np.zeros(len(i), bool)
    late[order] = kk > kk[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
    return pa.concat_tables([out, _by_document(e, late, None)])


def judge_covers(win: Windows):
    """Reduce side of step 2 over bytes: the windows of one bucket's covers that occur in an earlier document."""

    def run(table: pa.Table) -> pa.Table:
        e = _unpack(table)
        size = np.frombuffer(b"".join(table["span"].to_pylist()), np.uint16).astype(np.int64)
        x = win.letters[np.frombuffer(b"".join(table["cover"].to_pylist()), np.uint8)]
        _, at_n = win.ids(x)
        many = size - win.n + 1
        total = np.append(0, np.cumsum(many))
        shift = np.arange(total[-1]) - np.repeat(total[:-1], many)
        ids = at_n[np.repeat(np.cumsum(size) - size, many) + shift]
        k = np.repeat(np.repeat(e["k"], e["counts"]), many)
        order = np.lexsort((k, ids))
        i, kk = ids[order], k[order]
        late = np.zeros(len(i), bool)
        if len(i):
            new = np.append(True, i[1:] != i[:-1])
            late[order] = kk > kk[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
        doc = np.repeat(np.arange(len(e["counts"])), e["counts"])
        single = {"rowkey": e["rowkey"], "counts": np.bincount(doc, weights=many, minlength=len(e["counts"])).astype(np.int64), "place": np.repeat(e["place"], many) + shift}
        return _by_document(single, late, None)

    return run


def covered(win: Windows, t: Texts, runs_of: list, starts_of: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token is removed, first token, token count) of a slice, from each text's marked runs and window starts."""
    r = win.runs(t)
    n_docs = len(r["first"])
    run_first = np.searchsorted(r["doc"], np.arange(n_docs))
    edge = np.zeros(int((r["first"] + r["count"]).max(initial=0)) + 1, np.int64)
    bulk = [run_first[d] + (p[p & 1 == 0] >> 1) for d, cells in enumerate(runs_of) for p in [_places(cells)]]
    single = [r["first"][d] + (_places(cells) >> 1) for d, cells in enumerate(starts_of)]
    at = np.concatenate(bulk).astype(np.int64) if bulk else np.zeros(0, np.int64)
    one = np.concatenate(single).astype(np.int64) if single else np.zeros(0, np.int64)
    np.add.at(edge, np.concatenate([r["lo"][at], one]), 1)
    np.add.at(edge, np.concatenate([r["hi"][at] + win.n, one + win.n]), -1)
    return np.cumsum(edge[:-1]) > 0, r["first"], r["count"]


def removed_windows(keyed_docs: DataFrame, win: Windows, finish, schema: str) -> DataFrame:
    """Runs ``finish`` over (rowkey, doc_id, text, data, starts): every document with its marks, for :func:`covered`."""
    spark = keyed_docs.sparkSession
    parts = width(spark)
    buckets = max(24, parts // 2)  # of anchors; a document meets each at most once, however wide the session
    docs = keyed_docs.repartition(parts, "rowkey")
    flags = docs.mapInArrow(lean(ship_runs(win, buckets)), SHIP).groupBy("bucket").applyInArrow(judge_runs, FLAGS)
    marks = flags.groupBy("rowkey").agg(F.collect_list("data").alias("data"), F.max("fine").alias("fine"))
    fine = docs.join(marks.filter("fine"), "rowkey")
    single = fine.mapInArrow(lean(ship_windows(win, 4 * buckets)), SHIP).groupBy("bucket").applyInArrow(judge_windows if win.letters is None else judge_covers(win), FLAGS)
    starts = single.groupBy("rowkey").agg(F.collect_list("data").alias("starts"))
    return docs.join(marks, "rowkey", "left").join(starts, "rowkey", "left").mapInArrow(lean(finish), schema)
