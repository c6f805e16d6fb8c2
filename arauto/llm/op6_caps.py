"""Embedding near-dedup by spherical-cap filters with structured random product codes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import binaries, staged, width
from arauto.llm.graph import components

COSINE = 0.95
#: Independent codes; how many filters of each a vector exceeds on average, and at least.
TABLES, LIST, LEAST = 4, 8, 5
#: Vectors that exceed a filter, on average over random vectors.
OCCUPANCY = 16
#: Members of one page of a crowded filter (pages meet in pairs).
PAGE = 2048
SEED = 20_240_601


@dataclass(frozen=True)
class Caps:
    """Filters of one table: a random rotation, then ``blocks`` codebooks; a filter is one word of each book.

    The number of filters grows with the vectors so that OCCUPANCY holds: the cost a vector stays level.
    """

    dim: int
    blocks: int
    words: int
    threshold: float

    @classmethod
    def fitting(cls, dim: int, n: int) -> Caps:
        filters = max(16, math.ceil(n * LIST / OCCUPANCY))
        blocks = max(1, min(dim // 2, math.ceil(math.log(filters, 4096))))
        blocks = max(2, blocks) if dim >= 4 else 1
        words = max(2, math.ceil(filters ** (1 / blocks)))
        p = min(0.5, LIST / words**blocks)
        return cls(dim, blocks, words, NormalDist().inv_cdf(1 - p) / math.sqrt(dim))

    def tables(self):
        for t in range(TABLES):
            rng = np.random.default_rng(SEED + t)
            rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
            edges = np.linspace(0, self.dim, self.blocks + 1).astype(int)
            books = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                book = rng.standard_normal((self.words, b - a))
                books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt((b - a) / self.dim))
            yield rotation, edges, books

    def decode(self, unit: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each unit vector exceeds, by table.

        A vector that lies far from all words and exceeds fewer than LEAST lowers its threshold until it exceeds so many.
        """
        rows, filters = [], []
        for t, (rotation, edges, books) in enumerate(tables):
            x = unit @ rotation
            scores = [x[:, a:b] @ book.T for a, b, book in zip(edges[:-1], edges[1:], books, strict=True)]
            todo, threshold = np.arange(len(x)), self.threshold
            while len(todo):
                row, code = self._list([s[todo] for s in scores], threshold)
                enough = np.bincount(row, minlength=len(todo)) >= min(LEAST, self.words**self.blocks)
                ok = enough[row]
                rows.append(todo[row[ok]])
                filters.append(code[ok] + t * self.words**self.blocks)
                todo, threshold = todo[~enough], threshold - 0.15 / math.sqrt(self.dim)
        return np.concatenate(rows), np.concatenate(filters)

    def _list(self, scores: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Partial words go on while the best rest can still reach the threshold."""
        best = np.stack([s.max(1) for s in scores], 1)
        every = rest = best.sum(1)
        row, code, total = np.arange(len(every)), np.zeros(len(every), np.int64), np.zeros(len(every))
        for i, s in enumerate(scores):
            rest = rest - best[:, i]
            r, w = np.nonzero(s >= (threshold - (every - best[:, i]))[:, None])  # words worth trying, whatever came before
            first, count = np.searchsorted(r, np.arange(len(every))), np.bincount(r, minlength=len(every))
            size = count[row]
            at = np.repeat(first[row] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            row, code, total = np.repeat(row, size), np.repeat(code, size) * self.words + w[at], np.repeat(total, size) + s[r[at], w[at]]
            ok = total + rest[row] >= threshold
            row, code, total = row[ok], code[ok], total[ok]
        return row, code


def vectors(cells: list) -> tuple[np.ndarray, np.ndarray]:
    """(index, matrix) of usable vectors, all of one length: not null or zero, all components finite."""
    at = [i for i, v in enumerate(cells) if v is not None and len(v) and None not in v]
    if not at:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    x = np.array([cells[i] for i in at], np.float64).reshape(len(at), -1)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.array(at, np.int64)[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, digest, vector): the vector as doubles, null where it can't link."""
    for batch in batches:
        ids, cells = batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()
        found: dict[int, bytes] = {}
        for size in sorted({len(v) for v in cells if v is not None}):
            index, x = vectors([v if v is not None and len(v) == size else None for v in cells])
            found.update((int(i), row.tobytes()) for i, row in zip(index, x, strict=True))
        raw = [found.get(i) if ids[i] is not None else None for i in range(len(ids))]
        digest = [hashlib.blake2b(v, digest_size=16).digest() if v is not None else None for v in raw]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(v) // 8 if v is not None else None for v in raw], pa.int32()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "dim", "digest", "vector"])


def _filters(sizes: dict[int, int]):
    caps = {dim: Caps.fitting(dim, n) for dim, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {dim: list(c.tables()) for dim, c in caps.items()}
        base, at = {}, 0
        for dim, c in sorted(caps.items()):
            base[dim], at = at, at + TABLES * c.words**c.blocks
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for start in range(0, part.num_rows, 1024):
                    piece = part.slice(start, 1024)
                    x = np.frombuffer(b"".join(piece.column("vector").to_pylist()), np.float64).reshape(-1, dim)
                    row, f = caps[dim].decode(_unit(x), tables[dim])
                    order = np.lexsort((f, row))
                    offsets = np.searchsorted(row[order], np.arange(piece.num_rows + 1))
                    f = f[order] + base[dim]
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(f))
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("rep", "copies", "dim", "vector")), lists, binaries(f, offsets)], names=["rep", "copies", "dim", "vector", "filters", "list"])

    return run


def _earlier(lists: list[np.ndarray], f: int) -> np.ndarray:
    """Which members share a filter smaller than ``f``, as an incidence matrix to multiply with its transpose."""
    small = [x[x < f] for x in lists]
    row = np.repeat(np.arange(len(small)), [len(x) for x in small])
    _, column = np.unique(np.concatenate(small), return_inverse=True)
    out = np.zeros((len(small), int(column.max(initial=-1)) + 1), np.float32)
    out[row, column] = 1
    return out


def _judge(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("filter", "ascending"), ("i", "ascending"), ("j", "ascending"), ("rep", "ascending")])
        f, i, j, page, rep, copies = (table[c].to_numpy() for c in ("filter", "i", "j", "page", "rep", "copies"))
        vec, lists = table["vector"].to_pylist(), table["list"].to_pylist()
        edge = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        a, b, n = [], [], []
        for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(f)).tolist(), strict=True):
            if hi - lo < 2:
                continue
            x = _unit(np.frombuffer(b"".join(vec[lo:hi]), np.float64).reshape(hi - lo, -1))
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if i[lo] != j[lo]:
                near &= page[lo:hi][:, None] != page[lo:hi][None]
            if not near.any():
                continue
            seen = _earlier([np.frombuffer(v, np.int64) for v in lists[lo:hi]], int(f[lo]))
            near &= ~(seen @ seen.T > 0)  # a pair counts in its first common filter only
            links = near @ copies[lo:hi].astype(np.float64)
            at = np.flatnonzero(links)
            a.append(rep[lo:hi][at])
            b.append(np.full(len(at), -1))
            n.append(links[at].astype(np.int64))
            label = np.arange(hi - lo)
            while True:
                least = np.minimum(label, np.where(near, label[None], hi - lo).min(1))
                if (least == label).all():
                    break
                label = least
            tied = np.flatnonzero(label != np.arange(hi - lo))
            a.append(rep[lo:hi][label[tied]])
            b.append(rep[lo:hi][tied])
            n.append(np.zeros(len(tied), np.int64))
        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        kind = cat([np.full(len(x), k % 2) for k, x in enumerate(a)])
        return pa.table([pa.array(cat(a)), pa.array(cat(b)), pa.array(cat(n)), pa.array(kind == 1)], names=["a", "b", "n", "edge"])

    return run


def cap_groups(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors linked by cosine, found where they share a filter.

    Equal vectors are one (their smallest vec_id, with its number of copies). Every vector is decoded to all filters it
    exceeds; vectors meet in filters and pairs are verified in double precision in their first common one, so each
    link counts once and none is made below the threshold. Recall is that of the filters, a matter of chance that grows with
    TABLES * LIST. A crowded filter is cut into pages whose pairs are separate work, so no group is gathered whole.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of other lengths
    never link. A null vec_id links with nothing and has a null component. Rows that repeat a vec_id with other
    vectors are one node. Labels and other columns are ignored.
    """
    rows = staged(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_read, "vec_id long, dim int, digest binary, vector binary"), "vectors")
    known = rows.filter("digest IS NOT NULL")
    classes = staged(known.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    sizes = {r["dim"]: r["n"] for r in known.groupBy("dim").agg(F.countDistinct("digest").alias("n")).collect()}  # one row a length
    distinct = known.join(classes, "digest").filter("vec_id = rep").select("rep", "copies", "dim", "vector", "digest").dropDuplicates(["rep", "digest"])
    listed = staged(distinct.mapInArrow(_filters(sizes), "rep long, copies long, dim int, vector binary, filters array<long>, list binary"), "filters")
    member = listed.select("rep", F.explode("filters").alias("filter"))
    crowd = member.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pages = F.ceil(F.col("n") / PAGE).cast("int")
    member = member.join(crowd, "filter").select("rep", "filter", F.pmod(F.xxhash64("rep"), pages).cast("int").alias("page"), F.explode(F.sequence(F.lit(0), pages - 1)).alias("other"))
    member = member.select("rep", "filter", "page", F.least("page", "other").alias("i"), F.greatest("page", "other").alias("j"))
    buckets = max(64, width(rows.sparkSession))
    work = member.join(listed.select("rep", "copies", "vector", "list"), "rep").withColumn("bucket", F.pmod(F.xxhash64("filter", "i", "j"), F.lit(buckets)).cast("int"))
    found = staged(work.groupBy("bucket").applyInArrow(_judge(cosine), "a long, b long, n long, edge boolean"), "found")
    degree = found.filter("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    joined = components(found.filter("edge").select("a", "b")).withColumnRenamed("node", "rep")
    out = rows.select("vec_id", "digest").join(classes, "digest", "left").join(degree, "rep", "left").join(joined, "rep", "left")
    links = F.coalesce(F.col("linked"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
