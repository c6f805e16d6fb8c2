"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters by length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import K1, K2, mix, staged

#: Letters of a run; all lie in Latin-1, so a word is a row of single bytes in the kernels below.
LETTERS = r"A-Za-zÀ-ÿ"
#: Words of so many letters and more share one filter.
LAST_LENGTH = 64
#: Filter bits a word, and the bound of all filters together (beyond some eleven million words bits a word shrink: more false
#: positives reach the join, results stay the same).
WORD_BITS, FILTER_BYTES = 24, 32 << 20
#: Blocks a filter has at least, and bits a word sets in its block of 64.
LEAST_BLOCKS, PROBES = 256, 6
#: Edits hashed at a time.
EDITS = 1 << 20
#: Words that one task probes the edits of.
TASK_WORDS = 1 << 15

_INVERSE = np.uint64(pow(int(K1), -1, 2**64))


def runs(docs: DataFrame, least: int = 7, damage: int | None = 31) -> DataFrame:
    """(word): every maximal run of letters with A-Z lower-cased, one row an occurrence, of ``least`` letters and more.

    With ``damage``, a run whose crc32 (of ``<doc_id>:<run>``, an empty doc_id for null) it divides loses the letter at
    crc32 modulo its length, which plants misspellings. Null texts have no runs.
    """
    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"))).alias("run"))
    found = found.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word"))
    if damage is None:
        return found.select("word")
    found = found.withColumn("h", F.crc32(F.encode(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "word"), "UTF-8")))
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return found.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least_n: int = 2) -> DataFrame:
    """(word, n) of the words that occur ``least_n`` times or more. Counts combine before the shuffle."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


@dataclass(frozen=True)
class Filters:
    """One blocked Bloom filter a word length: a word sets PROBES bits of one 64-bit block."""

    first: np.ndarray  # by length up to LAST_LENGTH: first block
    blocks: np.ndarray  # and number of blocks
    words: int = 0
    bits: np.ndarray | None = None

    @classmethod
    def sized(cls, counts: dict[int, int], least_blocks: int = LEAST_BLOCKS) -> Filters:
        want = {k: max(least_blocks, -(-n * WORD_BITS // 64)) for k, n in counts.items() if n}
        shrink = min(1.0, FILTER_BYTES // 8 / max(1, sum(want.values())))
        blocks = np.zeros(LAST_LENGTH + 1, np.uint64)
        for k, n in want.items():
            blocks[k] = max(1, int(n * shrink))
        return cls(np.append(np.uint64(0), np.cumsum(blocks)[:-1]), blocks, sum(counts.values()))

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, mask) of hashed words of one length."""
        k = min(length, LAST_LENGTH)
        block = self.first[k] + (((h >> np.uint64(36)) * self.blocks[k]) >> np.uint64(28))
        mask = np.zeros(h.shape, np.uint64)
        for i in range(PROBES):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return block, mask

    def might_hold(self, h: np.ndarray, length: int) -> np.ndarray:
        if length < 0 or not self.blocks[min(length, LAST_LENGTH)]:
            return np.zeros(h.shape, bool)
        block, mask = self.place(h, length)
        return self.bits[block.astype(np.int64)] & mask == mask


def _powers(n: int) -> np.ndarray:
    p = np.full(n, K1, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _finish(poly: np.ndarray, length: int) -> np.ndarray:
    return mix(poly + np.uint64(length * int(K2) % 2**64))


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, letters + 1 as a matrix) of words, by length."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        step = max(1, EDITS // max(1, length))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            letters = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length)
            yield length, part, letters


def _hashed(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in _matrices(batch.column("word")):
                h = _finish(((letters.astype(np.uint64) + np.uint64(1)) * _powers(length)).sum(1, dtype=np.uint64), length)
                block, mask = filters.place(h, length)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(mask.view(np.int64))], names=["block", "mask"])

    return run


def build_filters(vocab: DataFrame, least_blocks: int = LEAST_BLOCKS) -> Filters:
    """Filters over all words: sized by the words of each length (at most LAST_LENGTH rows), filled by a distributed
    bitwise or whose result the driver takes whole; it has FILTER_BYTES / 8 rows at most."""
    size = F.least(F.length("word"), F.lit(LAST_LENGTH))
    counts = {r["k"]: r["n"] for r in vocab.groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    filters = Filters.sized(counts, least_blocks)
    placed = vocab.select("word").mapInArrow(_hashed(filters), "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask"))
    table = placed.toArrow()
    bits = np.zeros(int(filters.blocks.sum()), np.uint64)
    bits[table["block"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return Filters(filters.first, filters.blocks, filters.words, bits)


def edits(letters: np.ndarray, filters: Filters, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, letter or -1 for a deletion) of the edits of equally long words that a filter might hold.

    Only deletions and replacements by a larger letter are tried, and in a row of equal letters the first deletion only,
    so that two near words meet exactly once. Memory is bounded by EDITS, however long a word is.
    """
    n, length = letters.shape
    power = _powers(length)
    value = (letters.astype(np.uint64) + np.uint64(1)) * power
    whole = value.sum(1, dtype=np.uint64)
    before = np.cumsum(value, 1, dtype=np.uint64) - value
    shorter = before + (whole[:, None] - before - value) * _INVERSE
    first = np.ones((n, length), bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    row, at = np.nonzero(filters.might_hold(_finish(shorter, length - 1), length - 1) & first)
    yield row, at, np.full(len(row), -1)
    if not len(alphabet):
        return
    step = max(1, EDITS // (n * len(alphabet)))
    for lo in range(0, length, step):
        here = letters[:, lo : lo + step, None].astype(np.uint64)
        moved = whole[:, None, None] + (alphabet - here) * power[lo : lo + step, None]
        row, at, letter = np.nonzero((alphabet > here) & filters.might_hold(_finish(moved, length), length))
        yield row, at + lo, alphabet[letter].astype(np.int64)


def _positives(filters, alphabet: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word"), batch.column("n")
            for length, part, letters in _matrices(words):
                step = max(1, EDITS // (length * max(1, len(alphabet))))
                for lo in range(0, len(part), step):
                    piece = letters[lo : lo + step]
                    for row, at, letter in edits(piece, filters.value, alphabet):
                        raw = [piece[i].tobytes() for i in range(len(piece))] if len(row) else []
                        other = [
                            (raw[r][:i] + (b"" if x < 0 else bytes([x])) + raw[r][i + 1 :]).decode("latin-1")
                            for r, i, x in zip(row.tolist(), at.tolist(), letter.tolist(), strict=True)]
                        rows = pa.array(part[lo : lo + step][row])
                        yield pa.RecordBatch.from_arrays([words.take(rows), counts.take(rows), pa.array(other, pa.string())], names=["word", "n", "other"])

    return run


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two words of ``vocab`` (word, n) one edit apart, once.

    The filters are broadcast (FILTER_BYTES at most); only edits that they might hold are shuffled, to the join with the
    vocabulary that removes false positives.
    """
    spark = vocab.sparkSession
    used = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct()  # 90 rows at most
    alphabet = np.array(sorted(ord(r["c"]) for r in used.collect()), np.uint64)
    filters = build_filters(vocab)
    dealt = vocab.repartition(-(-filters.words // TASK_WORDS) or 1, "word")  # hashing edits takes long for few bytes
    tried = dealt.mapInArrow(_positives(spark.sparkContext.broadcast(filters), alphabet), "word string, n long, other string")
    return tried.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form), following forms to the last. Pointers double each round, so
    rounds are the logarithm of the longest chain (a form occurs ten times as often, so chains are short)."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = staged(now, "roots")
        step = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if now.join(step, "root", "left_semi").isEmpty():
            return now
        now = now.join(step, "root", "left").select("word", F.coalesce("far", "root").alias("root"))


def spelling_variants(vocab: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocab`` (word, n), a table with one row a word.

    Near words differ by exactly one inserted, deleted or replaced letter. A word's form is its near word of largest n
    (ties: the smallest in code-point order) if that n is at least ``ratio`` times its own; its root is the last form on
    the way. Without near words n_near is 0; without a form, form and form_n are null and the root is the word. An
    empty vocabulary gives an empty table. Words must consist of letters up to U+00FF.
    """
    vocab = staged(vocab.select("word", "n"), "vocabulary")
    pairs = staged(near_pairs(vocab), "near")
    ways = pairs.select("word", "other", "other_n").union(pairs.select("other", "word", "n"))
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    judged = vocab.join(best, "word", "left")
    form_n = -F.col("best.less")
    found = form_n >= ratio * F.col("n")
    judged = staged(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(found, F.col("best.form")).alias("form"), F.when(found, form_n).alias("form_n")), "forms")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, least: int = 7, least_n: int = 2, ratio: int = 10, damage: int | None = 31) -> DataFrame:
    """The spelling variants among the words of whole texts (see ``runs``, ``vocabulary`` and ``spelling_variants``).

    Null and empty texts have no words, repeated rows count each, other columns are ignored, an empty table gives none.
    """
    return spelling_variants(vocabulary(runs(docs, least, damage), least_n), ratio)
