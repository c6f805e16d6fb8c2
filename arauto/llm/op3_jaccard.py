"""N-gram Jaccard join with count vectors in an R-tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import Texts, binaries, join_ids, lean, mix, slices, staged, width, word_ids, words_of
from arauto.llm.graph import components

SHINGLE = 5
#: Two sets link when at least NUM / DEN of their union is shared.
NUM, DEN = 3, 4
#: Groups into which shingles are hashed, the coordinates of a point: a power of two by the size of the set, about two
#: shingles a group, so that long documents are told apart as well as short ones. A point of twice the groups folds.
LEAST_GROUPS, MOST_GROUPS = 32, 1 << 16
#: Coordinates that the tree bounds at most; what it leaves is held against the whole points.
TREE_GROUPS = 256
#: Cells of the corpus-wide count of shingles that orders them from rare to frequent.
CELLS = 1 << 20
#: Bits of the filter that tells which texts a verification may need.
BITS = 1 << 23
#: Points of a leaf, of a page of a large block (pages meet in pairs), and shingles of a page.
LEAF, PAGE, PAGE_SHINGLES = 32, 4096, 4 << 20
#: Pairs that large blocks give at most for each of their sets; blocks with more give a forest of them, and their sets meet
#: again as clusters. Shingles of a page of a cluster.
SHARE, SET_SHINGLES = 8, 1 << 20
#: Cells that one row of the count holds.
ROW_CELLS = 16


def shingle_sets(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct ``n``-word shingles of each text; a shorter text's words are one shingle."""
    begin, end, doc, b = words_of(t, lower=True)
    ids = word_ids(b, begin, end)
    docs = len(t.starts)
    first, stop = np.searchsorted(doc, np.arange(docs)), np.searchsorted(doc, np.arange(docs), "right")
    h = ids
    for back in range(1, n):
        h = join_ids(h[: max(0, len(h) - 1)], ids[back:])
    at = np.flatnonzero(doc[: len(h)] == doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    owner, value = doc[at], h[at]
    short = np.flatnonzero((stop > first) & (stop - first < n))
    lone = []
    for d in short.tolist():  # fewer than n words each
        v = ids[first[d] : first[d] + 1]
        for i in range(first[d] + 1, stop[d]):
            v = join_ids(v, ids[i : i + 1])
        lone.append(mix(v + np.uint64(stop[d] - first[d]))[0])
    owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(lone, np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(docs + 1))


def digests(value: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """The identity of each set; an empty one has none."""
    raw = value.tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_COUNTS = [f"c{i}" for i in range(ROW_CELLS)]


def _count_cells(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            value, _ = shingle_sets(Texts(batch.column("text")), n)
            total += np.bincount((value % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        total = total.reshape(-1, ROW_CELLS)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, i]) for i in range(ROW_CELLS))], names=["block", *_COUNTS])

    return run


def rarity(docs: DataFrame, n: int) -> np.ndarray:
    """How many shingles of all documents fall into each of CELLS cells; CELLS numbers reach the driver, whatever the input."""
    rows = docs.select("text").mapInArrow(lean(_count_cells(n)), "block int, " + ", ".join(f"{c} long" for c in _COUNTS))
    table = rows.groupBy("block").agg(*[F.sum(c).alias(c) for c in _COUNTS]).toArrow()
    out = np.zeros((CELLS // ROW_CELLS, ROW_CELLS), np.int64)
    out[table["block"].to_numpy()] = np.stack([table[c].to_numpy() for c in _COUNTS], 1)
    return out.ravel()


def group_counts(size: np.ndarray) -> np.ndarray:
    """Groups of a point, by the size of its set."""
    wanted = 2.0 ** np.ceil(np.log2(np.maximum(size, 2) / 2))
    return np.clip(wanted, LEAST_GROUPS, MOST_GROUPS).astype(np.int64)


def pack_points(value: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The point of each set: a byte that tells the width of a count, then the counts."""
    size = np.diff(offsets)
    groups = group_counts(size)
    base = np.append(0, np.cumsum(groups))
    at = np.repeat(base[:-1], size) + ((value >> np.uint64(40)).astype(np.int64) & np.repeat(groups - 1, size))
    counts = np.bincount(at, minlength=base[-1])
    small = counts.astype(np.uint8)
    fits = np.maximum.reduceat(counts, base[:-1]) < 1 << 8 if len(groups) else []
    return [b"\1" + small[a:b].tobytes() if ok else b"\4" + counts[a:b].astype(np.uint32).tobytes() for a, b, ok in zip(base[:-1].tolist(), base[1:].tolist(), fits, strict=True)]


def points_of(cells: list[bytes], groups: int) -> np.ndarray:
    """Points as rows, folded to ``groups`` groups (of a power of two, not more than any has)."""
    out = np.empty((len(cells), groups), np.int64)
    for i, cell in enumerate(cells):
        out[i] = np.frombuffer(cell, np.uint8 if cell[0] == 1 else np.uint32, offset=1).reshape(-1, groups).sum(0)
    return out


def groups_in(cells: list[bytes]) -> np.ndarray:
    return np.array([(len(c) - 1) // c[0] for c in cells], np.int64)


def possible(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the summed minima of two points, each pair at the finest grouping that both have, leave the similarity possible."""
    ok = (n * den >= m * num) & (m * den >= n * num)
    groups = np.minimum(groups_in(x), groups_in(y)) if len(x) else np.zeros(0, np.int64)
    for g in np.unique(groups[ok]).tolist():
        at = np.flatnonzero(ok & (groups == g))
        step = max(1, (1 << 20) // g)
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            bound = overlap_bound(points_of([x[i] for i in part], g), points_of([y[i] for i in part], g))
            ok[part] = (num + den) * bound >= num * (n[part] + m[part])
    return ok


FEATURES = "doc_id long, n_shingles long, digest binary, keys binary, point binary"


def _features(n: int, cells, num: int, den: int):
    """Size, identity, count vector and prefix of each set.

    Two sets that link share more than the rest a prefix leaves out, so with every set in one order (rare cells first)
    their prefixes of size - ceil(size * num / den) + 1 shingles have one in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = cells.value
        for batch in slices(batches):
            value, offsets = shingle_sets(Texts(batch.column("text")), n)
            docs, size = batch.num_rows, np.diff(offsets)
            owner = np.repeat(np.arange(docs), size)
            order = np.lexsort((value, count[(value % np.uint64(CELLS)).astype(np.int64)], owner))
            length = size - -(-size * num // den) + 1
            length[size == 0] = 0
            keep = (np.arange(len(value)) - np.repeat(offsets[:-1], size)) < np.repeat(length, size)
            keys = value[order][keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(digests(value, offsets), pa.binary()), binaries(keys, np.append(0, np.cumsum(length))), pa.array(pack_points(value, offsets), pa.binary())],
                names=[c.split()[0] for c in FEATURES.split(", ")],
            )

    return run


BLOCKS = "bucket int, nodes binary, owner binary, keys binary"


def _ship_keys(buckets: int):
    """(key, document) by bucket of keys. Of the documents of a batch that have equal sets only the first goes on: its class
    stands for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(np.array(batch.column("digest").to_pylist(), "S16"), return_index=True)
            batch = batch.take(pa.array(first))
            doc = batch.column("node").to_numpy(zero_copy_only=False)
            cells = batch.column("keys").to_pylist()
            keys = np.frombuffer(b"".join(cells), np.uint64)
            owner = np.repeat(np.arange(len(cells)), [len(c) // 8 for c in cells])
            bucket = (keys >> np.uint64(8)).astype(np.uint32).astype(np.int64) % buckets
            for b, at in zip(*_groups(bucket, np.arange(len(keys))), strict=True):
                local, owners = np.unique(owner[at], return_inverse=True)
                yield _key_row(b, doc[local], owners, keys[at])

    return run


def _groups(by: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(by, kind="stable")
    by, values = by[order], values[order]
    at = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
    return by[at].tolist(), np.split(values, at[1:]) if len(at) else []


def _key_row(bucket: int, docs: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    row = [pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (docs.astype(np.int64), owner.astype(np.uint32), np.ascontiguousarray(keys)))]
    return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in BLOCKS.split(", ")])


def _shared_keys(table: pa.Table) -> pa.Table:
    """(key, node) of the keys that several documents have."""
    docs, keys = [], []
    for d, o, k in zip(*(table[c].to_pylist() for c in ("nodes", "owner", "keys")), strict=True):
        docs.append(np.frombuffer(d, np.int64)[np.frombuffer(o, np.uint32)])
        keys.append(np.frombuffer(k, np.uint64))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    doc, key = doc[new], key[new]
    head = np.append(True, key[1:] != key[:-1])
    many = (np.diff(np.append(np.flatnonzero(head), len(key))) > 1)[np.cumsum(head) - 1]
    return pa.table([pa.array(key[many].view(np.int64)), pa.array(doc[many])], names=["key", "node"])


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many shingles two sets share: the sum of the smaller counts."""
    return np.minimum(a, b).sum(-1)


class RTree:
    """Points packed by size and first coordinates into leaves, leaves into nodes; a node bounds its points' counts from above."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], size))
        self.levels = [(points[self.order].astype(np.int64), size[self.order], size[self.order])]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            top, small, large = self.levels[-1]
            at = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))
            fan = 8
        self.fans = [LEAF, *[8] * (len(self.levels) - 2)]

    def pairs(self, num: int, den: int, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points (i < j of the input) that may reach the similarity and whose ``differ`` labels differ."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            top, small, large = self.levels[level]
            ok = (a <= b) & (large[a] * den >= small[b] * num) & (large[b] * den >= small[a] * num)
            a, b = a[ok], b[ok]
            keep = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 12):  # 8 MB of points at a time
                x, y = a[at : at + (1 << 12)], b[at : at + (1 << 12)]
                keep[at : at + len(x)] = (num + den) * overlap_bound(top[x], top[y]) >= num * (small[x] + small[y])
            a, b = a[keep], b[keep]
            if level:
                fan, below = self.fans[level - 1], len(self.levels[level - 1][0])
                i, j = (np.arange(fan * fan) // fan)[None], (np.arange(fan * fan) % fan)[None]
                parts = []
                for at in range(0, len(a), 1 << 12):
                    x, y = (a[at : at + (1 << 12), None] * fan + i).ravel(), (b[at : at + (1 << 12), None] * fan + j).ravel()
                    inside = (x < below) & (y < below) & (x <= y)
                    parts.append((x[inside], y[inside]))
                a, b = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (a[:0], b[:0])
        a, b = self.order[a[a != b]], self.order[b[a != b]]
        apart = differ[a] != differ[b]
        return a[apart], b[apart]


def _leaf_pairs(num: int, den: int):
    """Pairs within blocks of at most LEAF documents, which are one leaf each: those of like size and different components."""

    def run(table: pa.Table) -> pa.Table:
        key, doc, comp, n = (table[c].to_numpy() for c in ("key", "node", "component", "n_shingles"))
        order = np.lexsort((doc, key))
        key, doc, comp, n = key[order], doc[order], comp[order], n[order]
        a, b = [], []
        for step in range(1, LEAF):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            i, j = same, same + step
            ok = (comp[i] != comp[j]) & (doc[i] != doc[j]) & (n[i] * den >= n[j] * num) & (n[j] * den >= n[i] * num)
            a.append(doc[i[ok]])
            b.append(doc[j[ok]])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _meet_earlier(lists: pa.ListArray, key: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows ``i`` and ``j`` share a key smaller than ``key``."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    values = values[offsets[0] : offsets[-1]]
    small = values < key
    _, column = np.unique(values[small], return_inverse=True)
    seen = np.zeros((len(lists), int(column.max(initial=-1)) + 1), bool)
    seen[owner[small], column] = True
    bits, out = np.packbits(seen, axis=1), np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        out[at : at + (1 << 16)] = (bits[i[at : at + (1 << 16)]] & bits[j[at : at + (1 << 16)]]).any(1)
    return out


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Positions of edges (between 0 .. ``nodes`` - 1) that connect whatever all edges connect, fewer than nodes."""
    label, left, kept = np.arange(nodes), np.arange(len(a)), []
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, low, high = left[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        if not len(left):
            return np.concatenate(kept) if kept else left
        order = np.lexsort((low, high))
        first = order[np.append(True, np.diff(high[order]) > 0)]  # each goes to its smallest neighbour, if that is smaller
        kept.append(left[first])
        to = np.arange(nodes)
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _block_pairs(num: int, den: int):
    """Pairs of a large block that meet in no block of a smaller key (``keys`` has the large blocks of each set): sets of one grouping, and those of the next finer one, are a tree at their common grouping (or a
    coarser one); what its bounds leave is held against the whole points. A block shares SHARE pairs of each set with the set's
    other blocks; where there are more, as among near copies, a forest of them is given and marked ``more``."""

    def run(table: pa.Table) -> pa.Table:
        doc, comp, n = (table[c].to_numpy() for c in ("node", "component", "n_shingles"))
        cells, key = table["point"].to_pylist(), table["key"][0].as_py()
        lists = table["keys"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        groups = groups_in(cells)
        a, b = [], []
        for g in np.unique(groups).tolist():
            at = np.flatnonzero((groups == g) | (groups == 2 * g))  # sets that link differ by a third at most
            tree = RTree(points_of([cells[i] for i in at], min(g, TREE_GROUPS)), n[at])
            i, j = (at[x] for x in tree.pairs(num, den, comp[at]))
            own = (groups[i] == g) | (groups[j] == g)
            i, j = i[own], j[own]
            own = ~_meet_earlier(lists, key, i, j)
            i, j = i[own], j[own]
            ok = possible([cells[k] for k in i], [cells[k] for k in j], n[i], n[j], num, den)
            a.append(doc[i[ok]])
            b.append(doc[j[ok]])
        a, b = np.concatenate(a), np.concatenate(b)
        more = len(a) > SHARE * (1 / np.diff(lists.offsets.to_numpy())).sum()
        if more:
            names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            at = forest(ends[: len(a)], ends[len(a) :], len(names))
            a, b = a[at], b[at]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), more))], names=["a", "b", "more"])

    return run


def _cluster_links(num: int, den: int):
    """Links that join the components of a cluster as far as its sets link, fewer than there are components.

    A set outside the largest component is held against all sets of other components at once, until it has come to the
    largest; so near copies, which soon do, are not tried pair by pair.
    """

    def run(table: pa.Table) -> pa.Table:
        node, comp = (table[c].to_numpy() for c in ("node", "component"))
        order = np.argsort(node)
        node, comp = node[order], comp[order]
        cells = table["shingles"].take(pa.array(order)).to_pylist()
        size = np.array([len(c) // 8 for c in cells])
        start = np.append(0, np.cumsum(size))
        _, ids = np.unique(np.frombuffer(b"".join(cells), np.uint64), return_inverse=True)
        _, label = np.unique(comp, return_inverse=True)
        main = np.flatnonzero(label == np.bincount(label).argmax())[0]
        has, tried, a, b = np.zeros(ids.max() + 1, bool), np.zeros(len(node), bool), [], []
        for i in range(len(node)):
            if label[i] == label[main]:
                continue
            own = ids[start[i] : start[i + 1]]
            has[own] = True
            j = np.flatnonzero(~tried & (label != label[i]) & (size * den >= size[i] * num) & (size[i] * den >= size * num))
            shared = _sums(has, ids, start[j], size[j])
            has[own] = False
            j = j[den * shared >= num * (size[i] + size[j] - shared)]
            labels, first = np.unique(label[j], return_index=True)
            a += [node[i]] * len(first)
            b += node[j[first]].tolist()
            label[np.isin(label, labels)] = label[i]
            tried[i] = True
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _sums(has: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many ids of each run (``start``, ``size`` of at least 1) ``has`` marks."""
    out, cut = np.zeros(len(start), np.int64), np.cumsum(size)
    at = 0
    while at < len(start):  # 4 MB of ids at a time, or a run
        end = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + (1 << 19), "right")))
        base = np.append(0, np.cumsum(size[at:end]))
        places = np.arange(base[-1]) + np.repeat(start[at:end] - base[:-1], size[at:end])
        out[at:end] = np.add.reduceat(has[ids[places]], base[:-1], dtype=np.int64)
        at = end
    return out


def _bound_filter(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = possible(batch.column("px").to_pylist(), batch.column("py").to_pylist(), batch.column("nx").to_numpy(), batch.column("ny").to_numpy(), num, den)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([u, v])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(den * shared >= num * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def texts_in(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, shingles): the sets of documents in ``ids`` (and of a few more), by a filter of BITS bits on the ids."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("int")
    bits = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s") % 32)).alias("bits")).toArrow()
    words = np.zeros(BITS // 32, np.uint32)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = shipped.value
        for batch in slices(batches):
            s = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((has[s // 32] >> (s % 32).astype(np.uint32)) & 1 == 1))
            if batch.num_rows:
                value, offsets = shingle_sets(Texts(batch.column("text")), n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests(value, offsets), pa.binary()), binaries(value, offsets)], names=["doc_id", "digest", "shingles"])

    return docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(lean(run), "doc_id long, digest binary, shingles binary")


def paged(groups: DataFrame, shingles: int) -> DataFrame:
    """(key, i, j, node): the nodes of each key, of ``n`` nodes and ``w`` shingles, for every two pages i <= j that meet."""
    pages = F.ceil(F.greatest(F.col("n") / PAGE, F.col("w") / shingles)).cast("int")
    page = F.pmod(F.xxhash64("node"), pages).cast("int")
    rows = groups.select("key", "node", page.alias("page"), F.explode(F.sequence(F.lit(0), pages - 1)).alias("other"))
    return rows.select("key", F.least("page", "other").alias("i"), F.greatest("page", "other").alias("j"), "node")


def jaccard_groups(docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by ``n``-word shingle sets with similarity of num / den or more.

    A-Z are lower-cased; a set is the distinct shingles of the whole text. component_id is the smallest doc_id that
    links reach. All pairs that link are found, or their documents are already joined by other links:

    1. Rows with equal sets are one class, named by one of its rows. Classes meet in blocks by the rare shingles of their prefixes.
    2. In a block every class is tried against the block's first: a near-copy group costs a star, not all pairs.
    3. Blocks whose classes are still in different components are joined by an R-tree over count vectors (a small block is
       one leaf); only pairs between components that the summed minima leave possible are verified on the full sets.
    4. Where these are more than a few a class, they only tell which classes form a cluster; in it each class that is not yet in
       the largest component is held against the others on the full sets, and a link a component goes on.

    Null and blank texts have no shingles and link with nothing, their own component. A row with a null doc_id links with
    nothing and has a null component. Rows that repeat a doc_id are one document with several texts, all in one component;
    each row has the size of its own set. Identical rows each give a row. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cells = spark.sparkContext.broadcast(rarity(docs, n))
    features = staged(docs.mapInArrow(lean(_features(n, cells, num, den)), FEATURES).withColumn("row", F.monotonically_increasing_id()), "features")
    known = features.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = staged(known.groupBy("digest").agg(F.min("row").alias("rep")), "classes")
    of_rep = known.join(classes.select("digest", F.col("rep").alias("row")), ["digest", "row"])  # one row a class
    named = staged(of_rep.select(F.col("row").alias("node"), "doc_id", "digest"), "representatives")
    buckets = max(64, width(spark))
    shared = known.select(F.col("row").alias("node"), "digest", "keys").mapInArrow(lean(_ship_keys(buckets)), BLOCKS).groupBy("bucket").applyInArrow(_shared_keys, "key long, node long")
    shared = staged(shared, "blocks")
    class_of = known.select(F.col("row").alias("node"), "digest").join(classes, "digest")
    member = staged(shared.select("node").distinct().join(class_of, "node").select("node", "rep").distinct(), "members")
    points = staged(of_rep.select(F.col("row").alias("node"), "n_shingles", "point").join(member.select(F.col("rep").alias("node")).distinct(), "node"), "points")
    blocks = staged(shared.join(member, "node").select("key", F.col("rep").alias("node")).distinct(), "blocks")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link; only texts of classes in pairs are read into sets again."""
        pairs = staged(pairs, "pairs")
        ends = named.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node")
        sets = staged(texts_in(docs, ends.select("doc_id").distinct(), n), "sets")
        for end, column in (("a", "sx"), ("b", "sy")):  # a class's set is that of the text which its digest names
            of = named.select(F.col("node").alias(end), F.col("doc_id").alias(f"{end}_doc"), F.col("digest").alias(f"{end}_digest"))
            pairs = pairs.join(of, end).join(sets.select(F.col("doc_id").alias(f"{end}_doc"), F.col("digest").alias(f"{end}_digest"), F.col("shingles").alias(column)), [f"{end}_doc", f"{end}_digest"])
            pairs = pairs.drop(f"{end}_doc", f"{end}_digest")
        return staged(pairs.select("a", "b", "sx", "sy").mapInArrow(_verify(num, den), "a long, b long").distinct(), "links")

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs that the summed minima of their points leave possible."""
        x = points.select(F.col("node").alias("a"), F.col("n_shingles").alias("nx"), F.col("point").alias("px"))
        y = points.select(F.col("node").alias("b"), F.col("n_shingles").alias("ny"), F.col("point").alias("py"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_bound_filter(num, den), "a long, b long")

    def in_clusters(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
        """The links between components of sets that ``pairs`` connect; a set goes to its cluster once, whatever its blocks."""
        of = components(pairs).withColumnRenamed("component", "key").join(labelled.select("node", "component", "n_shingles"), "node")
        of = staged(of, "clusters")
        ends = named.join(of.select("node"), "node")
        sets = texts_in(docs, ends.select("doc_id").distinct(), n).dropDuplicates(["doc_id", "digest"])
        sets = staged(ends.join(sets, ["doc_id", "digest"]).select("node", "shingles"), "sets")
        rows = paged(of.join(of.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")), "key"), SET_SHINGLES)
        rows = rows.join(of.select("node", "component"), "node").join(sets, "node")
        return staged(rows.groupBy("key", "i", "j").applyInArrow(_cluster_links(num, den), "a long, b long").distinct(), "links")

    stars = blocks.join(blocks.groupBy("key").agg(F.min("node").alias("a")), "key").filter("a != node").select("a", F.col("node").alias("b")).distinct()
    links = verified(bounded(stars))
    first = components(links)

    labelled = points.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    in_block = blocks.join(labelled.select("node", "component", "n_shingles"), "node")
    mixed = in_block.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")).filter("x != y")
    mixed = staged(mixed.select("key", "n", "w"), "mixed")
    small = in_block.join(mixed.filter(F.col("n") <= LEAF).select("key"), "key").select("key", "node", "component", "n_shingles")
    small = small.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(4 * buckets)).cast("int"))
    near = small.groupBy("bucket").applyInArrow(_leaf_pairs(num, den), "a long, b long")
    spread = paged(in_block.join(mixed.filter(F.col("n") > LEAF), "key"), PAGE_SHINGLES)
    large = in_block.join(mixed.filter(F.col("n") > LEAF).select("key"), "key").groupBy("node").agg(F.collect_list("key").alias("keys"))  # of a prefix
    again = spread.join(labelled, "node").join(large, "node").groupBy("key", "i", "j").applyInArrow(_block_pairs(num, den), "a long, b long, more boolean")
    again = staged(again, "candidates")
    more = verified(bounded(near.union(again.filter("NOT more").select("a", "b")).distinct()))
    if not again.filter("more").isEmpty():
        more = more.union(in_clusters(again.filter("more"), labelled))

    texts = known.select("doc_id", "digest").distinct().join(classes, "digest").select("doc_id", "rep")
    several = texts.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a != z")
    same = texts.join(several, "doc_id").filter("rep != a").select("a", F.col("rep").alias("b"))
    joined = components(links.union(more).union(same)).withColumnRenamed("node", "rep")
    texts = texts.join(joined, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    names = texts.groupBy("component").agg(F.min("doc_id").alias("name"))
    of_doc = texts.join(names, "component").groupBy("doc_id").agg(F.min("name").alias("name"))
    return features.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))
