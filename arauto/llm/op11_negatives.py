"""Hard negatives by an inverted multi-index: cells of two half-space codebooks, visited by summed bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arauto.llm.common import binaries, staged

#: The codebooks are fitted on so many rows at most, chosen by hash (and on SAMPLE_BYTES at most); every row is indexed.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
#: Rows of a cell on average, and codewords of a half at most: a vector length has MAX_WORDS ** 2 cells at most.
CELL_ROWS, MAX_WORDS, LLOYD_ROUNDS = 32, 256, 8
#: Rows that an anchor sees before its first bound is taken.
SEED_ROWS = 1024
#: Scores computed at a time.
SCORES = 1 << 21
NONE = np.iinfo(np.int64).min
SEED = 7


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Quantised vectors as doubles that hold integers; a cell is int16 or, where that is too small, float64."""
    cells = column.to_pylist()
    if not dim:
        return np.zeros((len(cells), 0))
    if all(len(c) == 2 * dim for c in cells):
        return np.frombuffer(b"".join(cells), np.int16).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(c, np.int16 if len(c) == 2 * dim else np.float64).astype(np.float64) for c in cells])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; beyond a long the nearest long (its least value stands for none)."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, NONE + 1, -(NONE + 1)).astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest scores that are not NONE; of equal ones the first columns."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, 1)[:, n - k] if n > k else np.full(len(scores), NONE)
    row, col = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("embedding").to_pylist()
            at, out = [], []
            for i, cell in enumerate(cells):
                if cell is None or None in cell:
                    continue
                x = np.array(cell, np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        q = np.clip(np.floor(scale * x), -1e300, 1e300)
                    at.append(i)
                    out.append((q.astype(np.int16) if not len(q) or np.abs(q).max() < 2**15 else q).tobytes())
            rows = batch.take(pa.array(at, pa.int32()))
            dims = pa.array([len(cells[i]) for i in at], pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), dims, pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "q"])

    return run


# --- index ----------------------------------------------------------------------------------------------------------------


def codebook(x: np.ndarray, words: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centres of a sample; fewer than asked if the sample has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:words]]
    for _ in range(LLOYD_ROUNDS):
        near = nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * (x @ centres.T)).argmin(1)


@dataclass
class MultiIndex:
    """Cells of the vectors of one length: a vector lies in cell (i, j) if word i is nearest to its first half and j to its
    second. Radii are over all rows. Cells are packed in order into groups of about ``group_rows`` rows; a cell beyond that
    is cut into groups of its own. Groups are numbered from ``first_group``, slices of anchors from ``first_slice``."""

    dim: int
    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    rows: np.ndarray | None = None  # by cell
    group: np.ndarray | None = None  # by cell: its first group
    parts: np.ndarray | None = None  # and in how many it is cut
    groups: int = 0
    first_group: int = 0
    slices: int = 1
    first_slice: int = 0

    @classmethod
    def fit(cls, dim: int, n: int, sample: np.ndarray) -> MultiIndex:
        words = max(1, min(MAX_WORDS, round(math.sqrt(n / CELL_ROWS))))
        rng, half = np.random.default_rng(SEED), dim // 2
        if not len(sample):
            sample = np.zeros((1, dim))
        return cls(dim, (codebook(sample[:, :half], words, rng), codebook(sample[:, half:], words, rng)))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.dim // 2], x[:, self.dim // 2 :]

    def fill(self, cells: list[tuple[int, int, float, float, int]], first_group: int, first_slice: int) -> None:
        """Takes (cell, rows, radius, radius, anchors) of all cells that have rows."""
        across = len(self.words[1])
        self.radii = tuple(np.zeros(len(w)) for w in self.words)
        self.rows = np.zeros(len(self.words[0]) * across, np.int64)
        self.group, self.parts = np.zeros_like(self.rows), np.ones_like(self.rows)
        total = sum(c[1] for c in cells)
        per_group, per_slice = min(8192, max(512, total // 64)), min(4096, max(64, sum(c[4] for c in cells) // 8))
        group, filled = 0, 0
        for cell, rows, r, s, _ in sorted(cells):
            i, j = divmod(cell, across)
            self.radii[0][i], self.radii[1][j] = max(self.radii[0][i], r), max(self.radii[1][j], s)
            self.rows[cell] = rows
            parts = -(-rows // per_group)
            if filled and filled + rows > per_group:
                group, filled = group + 1, 0
            self.group[cell], self.parts[cell] = first_group + group, parts
            group, filled = (group + parts, 0) if parts > 1 else (group, filled + rows)
        self.groups, self.first_group, self.first_slice = group + (filled > 0), first_group, first_slice
        self.slices = max(1, -(-sum(c[4] for c in cells) // per_slice))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Most and least that either half of each anchor scores with a row of each word; widened by more than rounding."""
        out = []
        for x, words, radius in zip(self.halves(q), self.words, self.radii, strict=True):
            dot, length = x @ words.T, np.sqrt((x**2).sum(1))[:, None]
            reach = length * radius[None] * (1 + 1e-9) + 1e-9 * length * np.sqrt((words**2).sum(1))[None] + 1e-6
            out += [dot + reach, dot - reach]
        return out[0], out[2], out[1], out[3]

    def cells_of_groups(self, cells: np.ndarray) -> np.ndarray:
        """Groups of the given cells."""
        parts = self.parts[cells]
        start = np.repeat(np.cumsum(parts) - parts, parts)
        return np.unique(np.repeat(self.group[cells], parts) + np.arange(parts.sum()) - start)


def sequence(most: np.ndarray, more: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) by falling ``most[i] + more[j]``: the multi-sequence heap. A cell enters when both cells before it, in
    either half's order, have left, so the heap holds one cell a row of the front."""
    a, b = np.argsort(-most, kind="stable"), np.argsort(-more, kind="stable")
    x, y = most[a], more[b]
    heap, gone = [(-(x[0] + y[0]), 0, 0)], np.zeros(len(a) + 1, np.int64)  # gone: cells that have left, by row
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        gone[i] = j + 1
        if i + 1 < len(a) and gone[i + 1] == j:
            heapq.heappush(heap, (-(x[i + 1] + y[j]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or gone[i - 1] > j + 1):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))


def _assigned(books: dict[int, MultiIndex]):
    """Adds the cell and the distances from its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part, book = batch.filter(pa.array(dims == dim)), books[dim]
                x, cell, far = integers(part.column("q"), dim), np.zeros(part.num_rows, np.int64), []
                for half, words in zip(book.halves(x), book.words, strict=True):
                    near = nearest(half, words)
                    cell = cell * len(words) + near
                    far.append(np.sqrt(((half - words[near]) ** 2).sum(1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "vec_id", "label", "dim", "q")), pa.array(cell), *map(pa.array, far)], names=["key", "vec_id", "label", "dim", "q", "cell", "r", "s"])

    return run


def _placed(books: dict[int, MultiIndex]):
    """Adds the group of a row (a cut cell deals its rows by key) and the slice it would have as an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell, key = (batch.column(c).to_numpy() for c in ("dim", "cell", "key"))
            group, piece = np.zeros(len(dims), np.int64), np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at, book = dims == dim, books[dim]
                group[at] = book.group[cell[at]] + key[at] % book.parts[cell[at]]
                piece[at] = book.first_slice + (group[at] - book.first_group) * book.slices // book.groups
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "vec_id", "label", "dim", "q")), pa.array(group), pa.array(piece)], names=["key", "vec_id", "label", "dim", "q", "group", "slice"])

    return run


ROW = "key long, vec_id long, label long, dim int, q binary"


def build_index(rows: DataFrame, every: int) -> tuple[DataFrame, dict[int, MultiIndex]]:
    """(rows with group and slice, one index a vector length). The driver takes the bounded sample and one row a cell."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = min(SAMPLE_ROWS, SAMPLE_BYTES // (2 * max(sizes, default=1) or 1))
    drawn = rows.select("dim", "q").orderBy(F.xxhash64("vec_id", "q")).limit(most).toArrow() if sizes else None
    books = {}
    for dim, n in sorted(sizes.items()):
        mine = drawn.filter(pa.compute.equal(drawn["dim"], dim))["q"].combine_chunks()
        books[dim] = MultiIndex.fit(dim, n, integers(mine, dim) if len(mine) else np.zeros((0, dim)))
    cells = staged(rows.mapInArrow(_assigned(books), f"{ROW}, cell long, r double, s double"), "cells")
    anchors = F.count_if(F.col("vec_id") % every == 0).alias("anchors")
    stats: dict[int, list] = {dim: [] for dim in books}
    for r in cells.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max("s").alias("s"), anchors).collect():
        stats[r["dim"]].append((r["cell"], r["n"], r["r"], r["s"], r["anchors"]))
    group = piece = 0
    for dim, book in books.items():
        book.fill(stats[dim], group, piece)
        group, piece = group + book.groups, piece + book.slices
    return staged(cells.mapInArrow(_placed(books), f"{ROW}, group long, slice long"), "multi-index"), books


# --- search ---------------------------------------------------------------------------------------------------------------


def _with_groups(batch: pa.RecordBatch, groups: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.append(0, np.cumsum([len(g) for g in groups])).astype(np.int32)
    values = np.concatenate(groups) if groups else np.zeros(0, np.int64)
    return batch.append_column("groups", pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())))


def _first_cells(books: dict[int, MultiIndex]):
    """Adds the groups of the cells that the heap gives first, until they hold SEED_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                book = books[dim]
                most, more, _, _ = book.bounds(integers(batch.column("q").slice(i, 1), dim))
                cells, rows = [], 0
                for _, a, b in sequence(most[0], more[0]):
                    cell = a * len(book.words[1]) + b
                    if book.rows[cell]:
                        cells.append(cell)
                        rows += book.rows[cell]
                        if rows >= SEED_ROWS:
                            break
                out.append(book.cells_of_groups(np.array(cells)))
            yield _with_groups(batch, out)

    return run


def _certified(books: dict[int, MultiIndex]):
    """Adds the other groups with a cell whose scores may reach into one of the anchor's windows (low to high): the rest of
    the sequence, cut where every window is certified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                book = books[dim]
                most, more, least, less = book.bounds(integers(batch.column("q").slice(i, 1), dim))
                above, below = (most[0][:, None] + more[0][None]).ravel(), (least[0][:, None] + less[0][None]).ravel()
                need = np.zeros(len(above), bool)
                for low, high in zip(batch.column("low")[i].as_py(), batch.column("high")[i].as_py(), strict=True):
                    need |= (above >= low) & (below <= high)
                groups = book.cells_of_groups(np.flatnonzero(need & (book.rows > 0)))
                out.append(np.setdiff1d(groups, np.array(batch.column("seen")[i].as_py(), np.int64)))
            yield _with_groups(batch, out)

    return run


def _judged(k: int, same: bool):
    """Of one group's rows the ``k`` best of each anchor's windows, among rows of its label or of others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table["dim"][0].as_py()
        anchors, rows = table.filter(table["is_anchor"]), table.filter(pa.compute.invert(table["is_anchor"])).sort_by("vec_id")
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        x = integers(rows["q"].combine_chunks(), dim) if len(rows) else np.zeros((0, dim))
        found: list[list[np.ndarray]] = [[], [], [], []]
        step = max(1, SCORES // max(1, len(ids)))
        for lo in range(0, len(anchors) if len(ids) else 0, step):
            part = anchors.slice(lo, step)
            score = products(integers(part["q"].combine_chunks(), dim), x)
            label, own = part["label"].to_numpy()[:, None], part["vec_id"].to_numpy()[:, None]
            score[((label == labels) != same) | (own == ids)] = NONE
            lows, highs = part["low"].to_pylist(), part["high"].to_pylist()
            for w in range(max(map(len, lows), default=0)):
                low, high = (np.array([v[w] if w < len(v) else d for v in vs]) for vs, d in ((lows, 1), (highs, 0)))
                row, col = best(np.where((score >= low[:, None]) & (score <= high[:, None]), score, NONE), k)
                for out, values in zip(found, (part["key"].to_numpy()[row], np.full(len(row), w), ids[col], score[row, col]), strict=True):
                    out.append(values)
        return pa.table([pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for v in found], names=["key", "w", "vec_id", "score"])

    return run


def _visit(anchors: DataFrame, index: DataFrame, judged: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """(key, w, vec_id, score) of what anchors (with groups, low, high) find in their groups. Blocks meet: a slice of anchors
    that lie near each other and a group of rows; a group's rows go once to each slice that needs them."""
    reached = anchors.select("slice", F.explode("groups").alias("group"), "key", "vec_id", "label", "dim", "q", "low", "high")
    blocks = reached.select("slice", "group").distinct()
    none = F.lit(None).cast("array<long>")
    rows = index.drop("slice").join(blocks, "group").select("slice", "group", "key", "vec_id", "label", "dim", "q", none.alias("low"), none.alias("high"))
    both = reached.withColumn("is_anchor", F.lit(True)).unionByName(rows.withColumn("is_anchor", F.lit(False)))
    return both.groupBy("slice", "group").applyInArrow(judged, "key long, w long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("key", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, embedding, label).

    A component x becomes floor(scale * x), a score is an integer inner product; higher scores come first, ties by smaller
    vec_id. Anchors are the rows whose vec_id ``every`` divides; their positives are the first rows of the same label
    and another vec_id; each positive's negatives are the first rows of other labels that score from half to 95% of it.
    Exact: an anchor first sees the SEED_ROWS rows of the cells that the heap gives first; the score it then has to beat
    bounds the rest of the sequence, and every cell within the bound is visited. So once for positives, once for the windows
    of negatives.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; neither do negative positives'
    windows, which are empty. Vectors meet those of their own length only (also empty ones, with score 0). Repeated rows
    are rows each, as anchors too. Scores beyond a long count as the nearest long. Other columns are ignored; an empty
    table gives none.
    """
    cast = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")
    usable = cast.mapInArrow(_quantised(scale), "vec_id long, label long, dim int, q binary").withColumn("key", F.monotonically_increasing_id())
    usable = staged(usable.select("key", "vec_id", "label", "dim", "q"), "vectors")
    index, books = build_index(usable, every)
    bare = "key long, vec_id long, label long, dim int, q binary, slice long"
    list_ = lambda value: F.array(F.lit(value).cast("long"))
    anchors = index.where(F.col("vec_id") % every == 0).select("key", "vec_id", "label", "dim", "q", "slice")
    seeded = staged(anchors.mapInArrow(_first_cells(books), f"{bare}, groups array<long>"), "seeded")

    start = seeded.withColumns({"low": list_(int(NONE) + 1), "high": list_(-(int(NONE) + 1))})
    first = staged(_top(_visit(start, index, _judged(positives, True)), positives).drop("rank"), "positives")
    to_beat = first.groupBy("key").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    low = F.when(F.col("n") >= positives, F.col("to")).otherwise(F.lit(int(NONE) + 1))
    again = start.drop("low").join(to_beat.withColumnRenamed("low", "to"), "key", "left").withColumn("low", F.array(low)).withColumnRenamed("groups", "seen").drop("n", "to")
    again = again.mapInArrow(_certified(books), f"{bare}, seen array<long>, high array<long>, low array<long>, groups array<long>")
    more = _visit(staged(again, "certified"), index, _judged(positives, True))
    chosen = staged(_top(first.unionByName(more), positives), "positives")

    s = F.col("score")
    window = F.struct(F.col("rank").alias("w"), (s - F.expr("score div 2")).alias("low"), (s - F.expr("score div 20") - (s % 20 > 0).cast("long")).alias("high"))
    windows = chosen.where("score >= 0").groupBy("key").agg(F.sort_array(F.collect_list(window)).alias("ws"))  # ``positives`` at most
    sought = staged(seeded.join(windows, "key").withColumns({"low": F.col("ws.low"), "high": F.col("ws.high")}).drop("ws"), "windows")
    first = staged(_top(_visit(sought, index, _judged(negatives, False)), negatives).drop("rank"), "negatives")
    full = first.groupBy("key", "w").agg(F.min("score").alias("third"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= negatives)
    bounds = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "third"))).alias("third"))
    again = sought.join(bounds, "key", "left").withColumn("low", F.transform("low", lambda v, i: F.coalesce(F.col("third")[i.cast("long")], v)))
    again = again.drop("third").withColumnRenamed("groups", "seen").select("key", "vec_id", "label", "dim", "q", "slice", "seen", "high", "low")
    again = again.mapInArrow(_certified(books), f"{bare}, seen array<long>, high array<long>, low array<long>, groups array<long>")
    more = _visit(staged(again, "certified"), index, _judged(negatives, False))
    mined = _top(first.unionByName(more), negatives)

    pairs = chosen.select("key", (F.col("rank") - 1).cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = seeded.select("key", F.col("vec_id").alias("anchor_id"))
    return mined.join(pairs, ["key", "w"]).join(named, "key").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
