"""SentencePiece encoding and decoding by batched numpy Viterbi."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import K1, K2, kept_schema, slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"  #: stands for a blank in pieces
LITERAL = "\U0010ffff"  #: stands for a text's own U+2581 while it is encoded; itself encoded by bytes like it
#: Distinct segments a Python worker remembers before it forgets all and starts anew.
MEMO = 300_000
#: Characters times piece lengths that one batch of words holds.
CELLS = 2_000_000
#: Texts are encoded in slices of about so many bytes.
SLICE = 2 << 20


@dataclass
class Pieces:
    """A model's tables. Index ``len(text)`` stands for a character that is no piece (its bytes are encoded)."""

    text: list[str]
    score: np.ndarray
    merges: bool  #: scores are merge ranks (a BPE model): neighbours must be such that no merge joins across them
    byte_id: np.ndarray
    usable: np.ndarray = field(default=None)
    key: np.ndarray = field(default=None)  #: sorted hashes of usable pieces
    index: np.ndarray = field(default=None)
    likely: np.ndarray = field(default=None)  #: by the top 20 bits of a hash: some key has them
    hash: np.ndarray = field(default=None)
    length: np.ndarray = field(default=None)
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    longest: int = 1


def _hash(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of all prefixes of rows of code points, one column more than ``codes``."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * K1 + (codes[:, i].astype(np.uint64) + np.uint64(1)) * K2
    return out


_TOP = np.uint64(44)
_POWER = np.multiply.accumulate(np.append(np.uint64(1), np.full(64, K1)))


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)


def load(path: str = DEFAULT_MODEL) -> Pieces:
    """Reads a model file on the driver; executors get the tables, whose size the vocabulary bounds."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(n)]
    score = np.array([sp.get_score(i) for i in range(n)])
    plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)])
    byte_id = np.full(256, sp.unk_id(), np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_id[int(text[i][1:-1], 16)] = i
    whole = score[plain]
    return prepare(text, score, plain, byte_id, merges=bool((whole == np.round(whole)).all()))


def prepare(text: list[str], score: np.ndarray, plain: np.ndarray, byte_id: np.ndarray, merges: bool) -> Pieces:
    m = Pieces(text, score, merges, byte_id)
    n = len(text)
    m.length = np.array([*map(len, text), 1])
    m.longest = max([m.length[i] for i in np.flatnonzero(plain)], default=1)
    if m.longest >= len(_POWER):
        raise ValueError("a piece is longer than 64 characters")
    m.hash = np.zeros(n + 1, np.uint64)
    for size in np.unique(m.length[:n]):
        at = np.flatnonzero(m.length[:n] == size)
        m.hash[at] = _hash(_codes([text[i] for i in at], size))[:, -1]
    m.left, m.right = np.full(n + 1, -1), np.full(n + 1, -1)
    if merges:
        by_text = {text[i]: int(i) for i in np.flatnonzero(plain)}
        for i in np.flatnonzero(plain & (m.length[:n] > 1)):
            parts = _last_merge(text[i], by_text, score)
            if parts is None:
                plain = plain.copy()
                plain[i] = False  # no sequence of merges makes it
            else:
                m.left[i], m.right[i] = parts
    m.usable = plain
    at = np.flatnonzero(plain)
    order = np.argsort(m.hash[at], kind="stable")
    m.index, m.key = at[order], m.hash[at][order]
    m.likely = np.zeros(1 << 20, bool)
    m.likely[m.key >> _TOP] = True
    return m


def _last_merge(piece: str, by_text: dict[str, int], score: np.ndarray) -> tuple[int, int] | None:
    """The two pieces whose merge makes ``piece`` when its characters are merged by rank, leftmost first; None if none."""
    s = list(piece)
    while len(s) > 1:
        at = [(-score[j], i) for i in range(len(s) - 1) if (j := by_text.get(s[i] + s[i + 1])) is not None]
        if not at:
            return None
        i = min(at)[1]
        if len(s) == 2:
            a, b = by_text.get(s[0]), by_text.get(s[1])
            return None if a is None or b is None else (a, b)
        s[i : i + 2] = [s[i] + s[i + 1]]
    return None


def _find(m: Pieces, h: np.ndarray) -> np.ndarray:
    """Piece indexes of hashes by probing the sorted keys; -1 where there is none."""
    out = np.full(h.shape, -1)
    hit = np.nonzero(m.likely[h >> _TOP])  # most substrings are no pieces and need no search
    h = h[hit]
    at = np.minimum(np.searchsorted(m.key, h), len(m.key) - 1)
    out[hit] = np.where(m.key[at] == h, m.index[at], -1)
    return out


def _apart(m: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pair, back = np.unique(a * (len(m.text) + 1) + b, return_inverse=True)
    return _apart_pairs(m, pair // (len(m.text) + 1), pair % (len(m.text) + 1))[back]


def _apart_pairs(m: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging by rank leaves neighbours ``a``, ``b`` as they are: undoing their merges from the last to the first, no
    merge across the border comes before the one undone."""
    n = len(m.text)
    ok = np.ones(len(a), bool)
    rank = np.append(np.where(m.left[:n] >= 0, -m.score, -np.inf), -np.inf)
    live = np.flatnonzero((a < n) & (b < n))
    a, b, limit = a[live], b[live], np.full(len(live), np.inf)
    inclusive = np.zeros(len(live), bool)
    while len(live):
        both = _find(m, m.hash[a] * _POWER[m.length[b]] + m.hash[b])
        r = np.where(both >= 0, -m.score[both], np.inf)
        bad = np.where(inclusive, r <= limit, r < limit) & (both >= 0)
        ok[live[bad]] = False
        go_on = ~bad & ((m.left[a] >= 0) | (m.left[b] >= 0))
        live, a, b = live[go_on], a[go_on], b[go_on]
        ra, rb = rank[a], rank[b]
        undo_a = ra > rb
        limit, inclusive = np.where(undo_a, ra, rb), ~undo_a
        a, b = np.where(undo_a, m.right[a], a), np.where(undo_a, b, m.left[b])
    return ok


def viterbi(m: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids one word after the other, how many each word has) of words of one length, which advance together a character at a time.

    For each end position the pieces that end there are probed by substring hash, the best sum of scores wins (of a BPE
    model, only steps between pieces that no merge joins count, and these form exactly one path) and is stored with its start.
    """
    size = len(words[0])
    codes = _codes(words, size)
    h = _hash(codes)
    rows, n, worst = np.arange(len(words)), len(m.text), m.score.min() - 10.0
    best = np.full((len(words), size + 1), -np.inf)
    best[:, 0] = 0
    back, last = np.zeros((len(words), size + 1), np.int64), np.zeros((len(words), size + 1), np.int64)
    for end in range(1, size + 1):
        starts = np.arange(max(0, end - m.longest), end)
        piece = _find(m, h[:, end, None] - h[:, starts] * _POWER[end - starts])
        gain = np.where(piece >= 0, m.score[piece], -np.inf)
        lone = piece[:, -1] < 0
        piece[lone, -1], gain[lone, -1] = n, worst
        total = best[:, starts] + gain
        if m.merges:
            r, c = np.nonzero(np.isfinite(total) & (starts > 0)[None])
            clash = ~_apart(m, last[r, starts[c]], piece[r, c])
            total[r[clash], c[clash]] = -np.inf
        pick = total.argmax(1)
        best[:, end], back[:, end], last[:, end] = total[rows, pick], starts[pick], piece[rows, pick]
    ends = np.full(len(words), size)
    pieces, starts = [], []
    while ends.any():
        pieces.append(np.where(ends > 0, last[rows, ends], -1))
        ends = np.where(ends > 0, back[rows, ends], 0)
        starts.append(ends)
    grid, start = np.stack(pieces[::-1], 1), np.stack(starts[::-1], 1)
    unknown = grid == n
    if not unknown.any():
        return grid[grid >= 0].astype(np.int32), (grid >= 0).sum(1)
    ids, counts = [], np.zeros(len(words), np.int64)
    for i, word in enumerate(words):
        if not unknown[i].any():
            own = grid[i][grid[i] >= 0].tolist()
        else:
            own = []
            for piece, at in zip(grid[i].tolist(), start[i].tolist(), strict=True):
                if piece == n:
                    own.extend(m.byte_id[list((BLANK if word[at] == LITERAL else word[at]).encode())].tolist())
                elif piece >= 0:
                    own.append(piece)
        ids.extend(own)
        counts[i] = len(own)
    return np.array(ids, np.int32), counts


def _segments(m: Pieces) -> str:
    """A pattern that cuts texts only where no piece reaches across: before blanks; white space that is in no longer piece
    stands alone."""
    pieces = [m.text[i] for i in np.flatnonzero(m.usable & (m.length[:-1] > 1))]
    within = set("".join(pieces))
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        return ".+"
    alone = re.escape("".join(c for c in "\n\t\r\v\f" if c not in within))
    return rf"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (rf"|[{alone}]" if alone else "")


class Coder:
    """Encodes and decodes batches; remembers the segments it has met."""

    def __init__(self, m: Pieces):
        self.m = m
        self.cut = re.compile(_segments(m), re.S)
        self.forget()
        raw = [t.replace(BLANK, " ").encode() for t in m.text]
        for b, i in enumerate(m.byte_id.tolist()):
            raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw])
        self.at = np.append(0, np.cumsum(self.size)[:-1])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    most = MEMO  #: segments remembered

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, segments: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s), []).append(s)
        for words in by_length.values():
            step = max(1, CELLS // (len(words[0]) * self.m.longest))
            for at in range(0, len(words), step):
                part = words[at : at + step]
                ids, counts = viterbi(self.m, part)
                known = len(self.memo)
                while len(self.ids) < self.used + len(ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                while len(self.count) < known + len(part):
                    self.first, self.count = np.concatenate([self.first, self.first]), np.concatenate([self.count, self.count])
                self.ids[self.used : self.used + len(ids)] = ids
                self.count[known : known + len(part)] = counts
                self.first[known : known + len(part)] = self.used + np.cumsum(counts) - counts
                self.used += len(ids)
                self.memo.update(zip(part, range(known, known + len(part)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets). Null and empty texts have none; a blank is put before every other text."""
        if len(self.memo) > self.most:
            self.forget()
        cut = [self.cut.findall(BLANK + (t.replace(BLANK, LITERAL) if BLANK in t else t).replace(" ", BLANK)) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self._learn(set(flat).difference(self.memo))
        which = np.fromiter(map(self.memo.__getitem__, flat), np.int32, len(flat))
        sizes = self.count[which]
        total = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(self.first[which] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.append(0, np.cumsum([len(s) for s in cut]))].astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each list of ids, without the blank put before."""
        size = self.size[ids]
        total = np.append(0, np.cumsum(size))
        raw = self.raw[np.repeat(self.at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        edges = total[offsets].tolist()
        return [raw[a + 1 : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_CODERS: dict[str, Coder] = {}


def _coder(m: Pieces) -> Coder:
    """The worker's coder of a model: what it has learned serves its later tasks."""
    mark = hashlib.blake2b(repr((m.text, m.score.tolist())).encode()).hexdigest()
    if mark not in _CODERS:
        _CODERS.clear()
        _CODERS[mark] = Coder(m)
    return _CODERS[mark]


def encode_documents(docs: DataFrame, model: Pieces, keep: tuple[str, ...] = (), with_text: bool = True, memo: int = MEMO,
                     slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, ids, n_ids, decoded (what the ids decode to, if ``with_text``) and round_trip (decoded equals the text), with columns ``keep``.

    ``ids`` equal the library's for this model, but for texts that hold U+2581 itself: its bytes are encoded, so that every
    text round-trips. A null text gives null ids, an empty one an empty list; both round-trip (null to null). Very
    long texts take memory in proportion to their own length. Other columns of ``docs`` are ignored. ``memo`` (segments a
    worker remembers) and ``slice_bytes`` (text it takes at a time) trade memory for time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text_"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped.value)
        coder.most = memo
        for batch in slices(batches, "text_", slice_bytes):
            texts = batch.column("text_").to_pylist()
            ids, offsets = coder.encode(texts)
            raw = coder.decode(ids, offsets)
            same = pa.array([x == t.encode() if t is not None else not x for t, x in zip(texts, raw, strict=True)])
            null = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=null)
            sizes = pa.array(np.diff(offsets), mask=null.to_numpy(zero_copy_only=False))
            back = [pa.array([x.decode("utf-8", "replace") if t is not None else None for t, x in zip(texts, raw, strict=True)], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, sizes, *back, same, *[batch.column(f"kept_{c}") for c in keep]], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on beside those of later stages

    names = ["doc_id", "ids", "n_ids", *["decoded"] * with_text, "round_trip", *[f"kept_{c}" for c in keep]]
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, " + "decoded string, " * with_text + "round_trip boolean" + kept_schema(docs, keep))
