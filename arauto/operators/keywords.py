"""A table of keywords against texts: every keyword that a text contains, found in one pass over the text's bytes.

UTF-8 is searched byte by byte: a keyword's bytes begin and end where its characters do. Each keyword stands under one piece of
its own, eight bytes at most, that few other keywords have. A text's windows of the pieces' sizes meet the pieces as numbers, and
the keywords of a piece are then compared with the text around it, eight bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast

#: Bytes of a piece at most; they make one number.
PIECE = 8
#: Keywords and windows of texts that are worked on at a time.
SLICE, BLOCK = 1 << 16, 1 << 18
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(PIECE + 1)], np.uint64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes and PIECE zeros) of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    held = np.zeros(offsets[-1] - offsets[0] + PIECE, np.uint8)
    if len(held) > PIECE:
        held[:-PIECE] = np.frombuffer(column.buffers()[2], np.uint8, len(held) - PIECE, offsets[0])
    return offsets - offsets[0], held


def _windows(held: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number; nothing is copied."""
    return np.ndarray((len(held) - PIECE + 1,), "<u8", held, 0, (1,))


def _cell(units: np.ndarray, bits: int) -> np.ndarray:
    return ((units * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def _spelled(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of each of ``n[i]`` rows of every i."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


@dataclass(frozen=True)
class Pieces:
    """The pieces of one size: ``units`` in order; from ``first`` on, the keywords of each and where in the keyword it stands."""

    size: int
    bits: int
    taken: np.ndarray
    units: np.ndarray
    first: np.ndarray
    which: np.ndarray
    place: np.ndarray


@dataclass(frozen=True)
class Keywords:
    """Distinct keywords in order of their bytes, with the kinds (area and rank, the preferred one first) that each stands for."""

    words: pa.Array
    sizes: np.ndarray
    begins: np.ndarray
    units: np.ndarray
    pieces: list[Pieces]
    kinds_from: np.ndarray
    kinds: np.ndarray
    areas: pa.Array
    ranks: pa.Array


def _pieces(offsets: np.ndarray, held: np.ndarray, rows: np.ndarray, size: int) -> Pieces:
    view, length, bits = _windows(held), np.diff(offsets), 22
    parts = [rows[i : i + SLICE] for i in range(0, len(rows), SLICE)]

    def windows(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, place = _spelled(length[part] - size + 1)
        return owner, place, view[offsets[part][owner] + place] & _MASKS[size]

    often = np.zeros(1 << bits, np.int64)
    for part in parts:
        often += np.bincount(_cell(windows(part)[2], bits), minlength=1 << bits)
    chosen = []
    for part in parts:
        owner, place, unit = windows(part)
        rare = np.lexsort((place, often[_cell(unit, bits)], owner))
        rare = rare[np.unique(owner, return_index=True)[1]]
        chosen.append((part.astype(np.int32), place[rare].astype(np.int32), unit[rare]))
    which, place, unit = (np.concatenate(x) for x in zip(*chosen, strict=True))
    order = np.argsort(unit, kind="stable")
    units, first = np.unique(unit[order], return_index=True)
    bits = min(26, max(10, len(units).bit_length() + 4))
    taken = np.zeros(1 << bits, bool)
    taken[_cell(units, bits)] = True
    return Pieces(size, bits, taken, units, np.append(first, len(order)).astype(np.int32), which[order], place[order])


def compiled(table: pa.Table, gram: int = PIECE) -> Keywords:
    """Keywords of a table (keyword as bytes, and area and rank if they stand for any). Pieces have ``gram`` bytes at most."""
    column = table["keyword"].combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    words = pc.unique(column)
    words = words.take(pc.sort_indices(words))
    offsets, held = _bytes(words)
    sizes = np.diff(offsets)
    n = -(-sizes // PIECE)
    begins = np.cumsum(n) - n
    padded = np.zeros(int(n.sum()) * PIECE, np.uint8)
    for i in range(0, len(words), SLICE):
        owner, place = _spelled(sizes[i : i + SLICE])
        padded[begins[i : i + SLICE][owner] * PIECE + place] = held[offsets[i] : offsets[min(i + SLICE, len(words))]]
    cut = np.minimum(sizes, min(gram, PIECE))
    pieces = [_pieces(offsets, held, np.flatnonzero(cut == s), int(s)) for s in np.unique(cut)]
    kinds_from, kinds, areas, ranks = np.zeros(1, np.int32), np.zeros(0, np.int32), pa.nulls(0), pa.nulls(0)
    if "area" in table.column_names:
        area, rank = ([c.dictionary, c.indices.to_numpy()] for c in (
            table[name].combine_chunks().dictionary_encode(null_encoding="encode") for name in ("area", "rank")))
        at = [np.empty(len(d), np.int64) for d, _ in (area, rank)]
        for to, (d, _) in zip(at, (area, rank), strict=True):
            to[pc.sort_indices(d, null_placement="at_end").to_numpy()] = np.arange(len(d))
        codes, kind = np.unique(at[1][rank[1]] * len(area[0]) + at[0][area[1]], return_inverse=True)
        word = pc.index_in(column, words).to_numpy()
        order = np.argsort(word, kind="stable")
        kinds, kinds_from = kind[order].astype(np.int32), np.searchsorted(word[order], np.arange(len(words) + 1)).astype(np.int32)
        areas, ranks = (d.take(pa.array(np.argsort(to)[code])) for to, (d, _), code in zip(at, (area, rank), (codes % len(area[0]), codes // len(area[0])), strict=True))
    return Keywords(pc.cast(words, pa.string(), safe=False), sizes.astype(np.int32), begins.astype(np.int32), padded.view("<u8"), pieces, kinds_from, kinds, areas, ranks)


def found(texts: pa.Array, keywords: Keywords) -> tuple[np.ndarray, np.ndarray]:
    """(row, keyword), each once and in order, of all keywords that the texts contain."""
    offsets, held = _bytes(texts)
    view, many = _windows(held), max(1, len(keywords.sizes))
    hits = [np.zeros(0, np.int64)]
    for begin in range(0, int(offsets[-1]), BLOCK):
        block = view[begin : min(begin + BLOCK, int(offsets[-1]))].copy()
        for p in keywords.pieces:
            windows = block & _MASKS[p.size]
            at = np.flatnonzero(p.taken[_cell(windows, p.bits)])
            unit = np.searchsorted(p.units, windows[at])
            same = p.units[np.minimum(unit, len(p.units) - 1)] == windows[at]
            at, unit = at[same], unit[same]
            owner, nth = _spelled(p.first[unit + 1] - p.first[unit])
            nth += p.first[unit][owner]
            word, start = p.which[nth].astype(np.int64), begin + at[owner] - p.place[nth]
            row = np.searchsorted(offsets, begin + at[owner], "right") - 1
            inside = (start >= offsets[row]) & (start + keywords.sizes[word] <= offsets[row + 1])
            word, start, row = word[inside], start[inside], row[inside]
            done = 0  # bytes compared so far
            while len(word):
                left = keywords.sizes[word] - done
                same = view[start + done] & _MASKS[np.minimum(left, PIECE)] == keywords.units[keywords.begins[word] + done // PIECE]
                whole = same & (left <= PIECE)
                hits.append(np.unique(row[whole] * many + word[whole]))
                word, start, row = (x[same & ~whole] for x in (word, start, row))
                done += PIECE
    pairs = np.unique(np.concatenate(hits))
    return pairs // many, pairs % many


def held(shipped: Broadcast):
    """(id, text as bytes) to (id, list of the keywords held, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = shipped.value
        for batch in batches:
            row, word = found(batch.column(1), keywords)
            ends = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, keywords.words.take(pa.array(word)))], names=["id", "__own"])

    return run


def scored(shipped: Broadcast, best: bool):
    """(id, text as bytes) to (id, area, rank, n, evidence), the keywords in order: a row for every kind that a text has keywords
    of, or, if ``best``, one for every text, for the kind with most keywords, the preferred one on a tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = shipped.value
        many = max(1, len(keywords.areas))
        for batch in batches:
            ids = batch.column(0)
            row, word = found(batch.column(1), keywords)
            owner, nth = _spelled(keywords.kinds_from[word + 1] - keywords.kinds_from[word])
            key = row[owner] * many + keywords.kinds[keywords.kinds_from[word][owner] + nth]
            order = np.argsort(key, kind="stable")  # keywords stay in order
            each, first, n = np.unique(key[order], return_index=True, return_counts=True)
            of = np.arange(len(each))
            if best:
                most = np.lexsort((each % many, -n, each // many))
                rows, at = np.unique(each[most] // many, return_index=True)
                of = np.full(len(batch), -1)
                of[rows] = most[at]
            else:
                ids = ids.take(pa.array(each // many))
            none = of < 0
            each, first, n = (np.append(x, 0)[of] for x in (each, first, n))  # -1 is the one appended
            run_of, place = _spelled(n)
            evidence = keywords.words.take(pa.array(word[owner][order][first[run_of] + place]))
            kind = pa.array(each % many, mask=none)
            yield pa.RecordBatch.from_arrays([
                ids, keywords.areas.take(kind), keywords.ranks.take(kind), pa.array(n.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), evidence)], names=["id", "area", "rank", "n", "evidence"])

    return run
