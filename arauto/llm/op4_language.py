"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arauto.llm.common import Texts, kept_schema, slices, staged

#: The models are fitted on about so many documents of each language, chosen by hash.
SAMPLE_DOCS = 600
#: Bytes with a symbol of their own; all rarer ones share symbol 0 and pay for telling them apart alike.
SYMBOLS = 64
#: Bytes of context at most; the context tree below is a table of SYMBOLS ** ORDER.
ORDER = 3


@dataclass
class Models:
    """Frozen statistics. ``node`` maps each context of ORDER symbols to its longest suffix seen in training; ``cost`` holds,
    for every language, by node and next symbol, the code length in nats."""

    langs: list[str]
    symbol: np.ndarray
    node: np.ndarray
    cost: np.ndarray


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text): labelled documents outside the held-out fold, about ``per_lang`` of each language by hash of the id."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", F.lit("sample")).alias("h"), held_out().alias("held"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.col("held"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return rows.select("lang", "text")
    modulus = 1 << 20
    bar = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(max(1, -(-per_lang * modulus // n))))])
    return rows.filter(F.pmod("h", F.lit(modulus)) < bar[F.col("lang")]).select("lang", "text")


def _grams(symbol: np.ndarray | None):
    """Counts of (language, ORDER + 1 bytes) of a sample; with ``symbol`` given over symbols, else over single bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, langs = Texts(batch.column("text")), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                mine = [t.bytes[s:e] for s, e, x in zip(t.starts, t.ends, langs, strict=True) if x == lang]
                if symbol is None:
                    grams = np.concatenate(mine).astype(np.int64)
                else:
                    pad = np.zeros(ORDER, np.int64)  # a text begins after the rare symbol
                    grams = np.concatenate([_contexts(np.concatenate([pad, symbol[x].astype(np.int64)])) for x in mine])
                key, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


def _contexts(s: np.ndarray) -> np.ndarray:
    """ORDER + 1 symbols as one number, for every symbol after the first ORDER."""
    out = np.zeros(max(0, len(s) - ORDER), np.int64)
    for i in range(ORDER + 1):
        out = out * SYMBOLS + s[i : i + len(out)]
    return out


def fit(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> Models | None:
    """Counts the sample's byte strings on the executors and freezes the trees; None without labelled text.

    Method C: in a context of n symbols seen, d of them different, a symbol seen c times costs -ln(c / (n + d)) and an
    escape to the next shorter context -ln(d / (n + d)); below the empty context every symbol costs ln(SYMBOLS).
    """
    sample = staged(training_sample(docs, per_lang), "language-sample")
    schema = "lang string, gram long, n long"
    count = lambda symbol: sample.mapInArrow(_grams(symbol), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # noqa: E731  bounded by the sample
    single = count(None)
    if not single.num_rows:
        return None
    totals = np.bincount(single["gram"].to_numpy(), weights=single["n"].to_numpy(), minlength=256)
    frequent = np.argsort(-totals, kind="stable")[: SYMBOLS - 1]
    symbol = np.zeros(256, np.uint8)
    symbol[frequent] = np.arange(1, SYMBOLS, dtype=np.uint8)
    table = count(symbol)
    name = np.array(table["lang"].to_pylist())
    langs = sorted(set(single["lang"].to_pylist()))
    gram, n = table["gram"].to_numpy(), table["n"].to_numpy().astype(float)
    # nodes of each order: contexts seen in any language; node 0 is the empty context
    seen = [np.unique(gram // SYMBOLS % SYMBOLS**k) for k in range(1, ORDER + 1)]
    base = np.cumsum([1, *map(len, seen)])
    cost = np.empty((base[-1], SYMBOLS, len(langs)), np.float32)
    parent_of = [np.zeros(len(seen[0]), np.int64)] + [base[k - 1] + np.searchsorted(seen[k - 1], seen[k] % SYMBOLS**k) for k in range(1, ORDER)]
    for j, lang in enumerate(langs):
        mine = name == lang
        g, c = gram[mine], n[mine]
        counts = np.bincount(g % SYMBOLS, weights=c, minlength=SYMBOLS)
        cost[0, :, j] = _costs(counts[None], np.full((1, SYMBOLS), np.log(SYMBOLS)))[0]
        for k in range(ORDER):
            at = np.searchsorted(seen[k], g // SYMBOLS % SYMBOLS ** (k + 1))
            counts = np.bincount(at * SYMBOLS + g % SYMBOLS, weights=c, minlength=len(seen[k]) * SYMBOLS).reshape(-1, SYMBOLS)
            cost[base[k] : base[k + 1], :, j] = _costs(counts, cost[parent_of[k], :, j])
    node = np.zeros(SYMBOLS**ORDER, np.int32)
    contexts = np.arange(SYMBOLS**ORDER)
    for k in range(ORDER):
        suffix = contexts % SYMBOLS ** (k + 1)
        at = np.minimum(np.searchsorted(seen[k], suffix), len(seen[k]) - 1)
        hit = seen[k][at] == suffix
        node[hit] = base[k] + at[hit]
    return Models(langs, symbol, node, np.ascontiguousarray(cost.reshape(-1, len(langs)).T))


def _costs(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        direct = -np.log(counts / (total + kinds))
        escape = np.where(total > 0, -np.log(kinds / (total + kinds)), 0.0)
    return np.where(counts > 0, direct, escape + shorter)


def code_lengths(m: Models, t: Texts) -> np.ndarray:
    """Nats of each text (row) under each language (column), over all its bytes."""
    s = m.symbol[t.bytes].astype(np.int32)
    c = np.zeros(len(s), np.int32)
    for back in range(ORDER, 0, -1):
        c *= SYMBOLS
        c[back:] += s[: max(0, len(s) - back)]
    for i in range(ORDER):  # contexts at a text's start hold nothing of the text before
        at = (t.starts + i)[t.starts + i < t.ends]
        c[at] = 0
        for back in range(i, 0, -1):
            c[at] = c[at] * SYMBOLS + s[at - back]
    index = m.node[c] * SYMBOLS + s
    out = np.zeros((len(t.starts), len(m.langs)))
    full = np.flatnonzero(t.ends > t.starts)
    if len(full):
        for j in range(len(m.langs)):
            out[full, j] = np.add.reduceat(m.cost[j][index], t.starts[full], dtype=np.float64)
    return out


def identify(docs: DataFrame, models: Models | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns ``keep``, by the shortest code over the whole text.

    ``und`` (score 0) where the text is null or has no letter, or nothing was learned. score is the winner's share of
    the likelihoods; ties go to the language first in code-point order. lang, source and doc_id are never inputs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").alias("text_"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    none = rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *[f"kept_{c}" for c in keep])
    if models is None:
        return none
    shipped = docs.sparkSession.sparkContext.broadcast(models)  # bounded by SYMBOLS, ORDER, the sample and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names = np.array([*m.langs, "und"])
        for batch in slices(batches, "text_"):
            cost = code_lengths(m, Texts(batch.column("text_")))
            best = cost.argmin(1)
            score = 1.0 / np.exp(cost.min(1, keepdims=True) - cost).sum(1)
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[np.where(lettered, best, len(m.langs))].tolist()), pa.array(np.where(lettered, score, 0.0)), *[batch.column(f"kept_{c}") for c in keep]],
                names=["doc_id", "held_out", "lang_pred", "score", *[f"kept_{c}" for c in keep]],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + kept_schema(docs, keep))
