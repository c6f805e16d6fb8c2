"""Hashes, near-duplicate search, families and change kinds."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from arauto.functions.fields import window_label
from arauto.functions.text import ColumnLike, _col, to_ascii, tokens
from arauto.operators.sequences import hour_bucket, lag_by_bucket
from arauto.session import cut_lineage

_LOW = (1 << 32) - 1


# --- hashes -----------------------------------------------------------------------------------------------


def canonical_hash(
    titulo: ColumnLike = "titulo", ies_nome: ColumnLike = "ies_nome", nivel: ColumnLike = "nivel",
    modalidade: ColumnLike = "modalidade", periodo: ColumnLike = "periodo_inscricao", fonte: ColumnLike = "fonte_codigo",
) -> Column:
    """sha256 over the identifying fields; accents, case and spacing of title and institution do not count."""
    parts = [to_ascii(titulo), to_ascii(ies_nome), _col(nivel), _col(modalidade), window_label(periodo), _col(fonte)]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def content_hash(body: ColumnLike) -> Column:
    return F.sha2(_col(body).cast("binary"), 256)


def hamming(a: ColumnLike, b: ColumnLike) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def _token_hash(token: Column) -> Column:
    """The low 64 bits of md5(token); the negative base makes ``conv`` return them signed."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 17, 16), 16, -10).cast("long")


def _packed_bit(h: Column, bit: Column) -> Column:
    """Bits ``bit + 32`` and ``bit`` as one number, so a single sum counts both (exact below 2^32 tokens)."""
    pick = lambda b: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long"))
    return F.shiftleft(pick(bit + 32), 32) + pick(bit)


def _majority(votes: Column, bit: Column, n: Column) -> Column:
    """The simhash bits a packed count of votes decides; a bit is set when more than half of ``n`` tokens set it."""
    one = F.lit(1).cast("long")
    high = F.when(F.shiftright(votes, 32) * 2 > n, F.call_function("shiftleft", one, bit + 32)).otherwise(F.lit(0).cast("long"))
    low = F.when(votes.bitwiseAND(F.lit(_LOW)) * 2 > n, F.call_function("shiftleft", one, bit)).otherwise(F.lit(0).cast("long"))
    return high.bitwiseOR(low)


def simhash64(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, simhash) of long texts: tokens are exploded and the 64 votes summed as 32 packed counters.

    Each row's tokens come from one task, so partial aggregation leaves one record per row for the shuffle.
    Texts without tokens get 0. ``id`` must be unique.
    """
    # hashed inside the generator: below it the optimiser would copy the hash into each of the 32 sums
    words = df.select(id, F.explode_outer(F.transform(tokens(to_ascii(text)), _token_hash)).alias("__h"))
    bits = [F.lit(i) for i in range(32)]
    votes = words.groupBy(id).agg(
        F.count("__h").alias("__n"), *[F.sum(_packed_bit(F.col("__h"), b)).alias(f"__v{i}") for i, b in enumerate(bits)]
    )
    folded = reduce(Column.bitwiseOR, [_majority(F.col(f"__v{i}"), b, F.col("__n")) for i, b in enumerate(bits)])
    return votes.select(id, F.when(F.col("__n") > 0, folded).otherwise(F.lit(0)).cast("long").alias("simhash"))


#: Tokens whose bits are laid out at a time.
VOTERS = 65_536


@F.pandas_udf(LongType())
def _majority_of(hashes: pd.Series) -> pd.Series:
    """The bits that more than half of a row's 8-byte hashes have set."""
    def vote(packed: bytes) -> int:
        h = np.frombuffer(packed, np.uint8).reshape(-1, 8)
        votes = sum(np.unpackbits(h[i:i + VOTERS], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(h), VOTERS))
        return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big", signed=True) if len(h) else 0

    return hashes.map(vote)


def simhash_of(text: ColumnLike) -> Column:
    """The same value within the row, without a shuffle: the row's hashes go to numpy as one binary."""
    words = F.transform(tokens(to_ascii(text)), lambda w: F.substring(F.md5(w.cast("binary")), 17, 16))
    return _majority_of(F.coalesce(F.unhex(F.array_join(words, "")), F.lit(b"")))


# --- near duplicates --------------------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _split(positions: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs over the given bit positions."""
    size, extra = divmod(len(positions), parts)
    masks, at = [], 0
    for i in range(parts):
        step = size + (i < extra)
        masks.append(sum(1 << p for p in positions[at:at + step]))
        at += step
    return masks


#: Values that meet pair by pair under one key. A key with more is divided by finer keys, and those again, LEVELS times at most:
#: then so few bits are free that a key has little over a thousand values.
LEAF, LEVELS = 256, 4


def _bands(k: int, blocks: int) -> list[int]:
    """Masks of the bands. Two values within ``k`` bits agree on at least ``blocks - k`` of ``blocks`` blocks, so they share the key
    of some band."""
    return [sum(c) for c in combinations(_split(list(range(64)), blocks), blocks - k)]


def _finer(masks: list[int], k: int) -> list[int]:
    """``k + 1`` finer masks for each: of the bits that a mask leaves out at most ``k`` differ, so of ``k + 1`` runs of them one agrees."""
    return [m | part for m in masks for part in _split([p for p in range(64) if not m >> p & 1], k + 1)]


def _literals(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)) for m in masks])


def _banded(values: DataFrame, bands: list[int]) -> DataFrame:
    """(simhash, at, key): the value under each band; ``at`` numbers the masks of a level."""
    keys = F.array(*[F.struct(F.lit(i).alias("at"), F.col("simhash").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(bands)])
    return values.select("simhash", F.inline(keys))


def _divided(rows: DataFrame, masks: list[int], k: int) -> DataFrame:
    """Rows of crowded keys under the next level's ``masks``."""
    table = _literals(masks)
    below = [F.col("at") * (k + 1) + s for s in range(k + 1)]
    keys = F.array(*[F.struct(at.alias("at"), F.col("simhash").bitwiseAND(F.get(table, at)).alias("key")) for at in below])
    return rows.select("simhash", F.inline(keys))


def _first_zero(x: Column, masks: list[Column]) -> Column:
    return F.coalesce(*[F.when(x.bitwiseAND(m) == 0, F.lit(i)) for i, m in enumerate(masks)])


def _meeting(x: Column, levels: list[list[int]], k: int) -> Column:
    """Whether a pair's first common band, and first finer mask of each level, is where it meets: each pair meets so once."""
    depth = len(levels) - 1
    above = lambda n: F.floor(F.col("a.at") / (k + 1) ** n).cast("int")
    ok = _first_zero(x, [F.lit(_signed(m)) for m in levels[0]]) == above(depth)
    for j in range(1, depth + 1):
        table, parent = _literals(levels[j]), above(depth - j + 1)
        ok &= _first_zero(x, [F.get(table, parent * (k + 1) + s) for s in range(k + 1)]) == above(depth - j) % (k + 1)
    return ok


def _near(left: DataFrame, right: DataFrame, k: int, blocks: int, leaf: int, same: bool) -> DataFrame:
    levels, key = [_bands(k, blocks)], ["at", "key"]
    # every level starts from files and leaves its pairs in files: the driver never holds a plan of more than one level
    left, right = (cut_lineage(left),) * 2 if same else (cut_lineage(left), cut_lineage(right))
    a = _banded(left, levels[0])
    b = a if same else _banded(right, levels[0])
    found = []
    while True:
        last = len(levels) > LEVELS
        crowded = None if last else cut_lineage(b.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).select(*key))
        done = last or crowded.isEmpty()
        rest = lambda rows: rows if done else rows.join(crowded, key, "left_anti")  # noqa: B023, E731
        x = F.col("simhash_a").bitwiseXOR(F.col("simhash_b"))
        condition = (F.col("a.at") == F.col("b.at")) & (F.col("a.key") == F.col("b.key")) & (F.bit_count(x) <= k) & _meeting(x, levels, k)
        if same:
            condition &= F.col("simhash_a") < F.col("simhash_b")
        sides = rest(a).withColumnRenamed("simhash", "simhash_a").alias("a"), rest(b).withColumnRenamed("simhash", "simhash_b").alias("b")
        found.append(cut_lineage(sides[0].join(sides[1], condition).select("simhash_a", "simhash_b", F.bit_count(x).alias("distance"))))
        if done:
            return reduce(DataFrame.union, found)
        levels.append(_finer(levels[-1], k))
        a = cut_lineage(_divided(a.join(crowded, key, "left_semi"), levels[-1], k))
        b = a if same else cut_lineage(_divided(b.join(crowded, key, "left_semi"), levels[-1], k))


def _values(df: DataFrame, simhash: str) -> DataFrame:
    return df.select(F.col(simhash).alias("simhash")).where(F.col("simhash") != 0).distinct()


def near_duplicates(df: DataFrame, simhash: str = "simhash", k: int = 3, blocks: int = 6, leaf: int = LEAF) -> DataFrame:
    """Pairs (simhash_a < simhash_b, distance) of *distinct* values at most ``k`` bits apart; exact.

    Copies collapse to one value first, so a group of copies costs one row however large it is; ``families``
    carries the result back to the rows. With 6 blocks a band key has 31 to 33 bits; a key with more than ``leaf``
    values is divided by finer keys as often as it takes. The 0 of empty texts takes no part.
    """
    values = _values(df, simhash)
    return _near(values, values, k, blocks, leaf, same=True)


def find_near(probes: DataFrame, stored: DataFrame, simhash: str = "simhash", k: int = 3, blocks: int = 6, leaf: int = LEAF) -> DataFrame:
    """For every probe value the stored values at most ``k`` bits away, equal ones included."""
    found = _near(_values(probes, simhash), _values(stored, simhash), k, blocks, leaf, same=False)
    return found.withColumnsRenamed({"simhash_a": "probe", "simhash_b": "stored"})


def joining_edges(values: DataFrame, k: int = 3, blocks: int = 6, leaf: int = LEAF) -> DataFrame:
    """(u, v) of near values that join the same families as all near pairs do, without most of them.

    Under each key every value is tried against the key's smallest one, which joins a crowd by a star. Only keys whose
    values are still in different families go on: small ones pair by pair between families, crowded ones under finer keys.
    """
    masks, key = _bands(k, blocks), ["at", "key"]
    rows, edges = _banded(values, masks), None
    for level in range(LEVELS + 1):
        low = rows.groupBy(*key).agg(F.min("simhash").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        near = F.bit_count(F.col("simhash").bitwiseXOR(F.col("v"))) <= k
        star = cut_lineage(rows.join(low, key).where(near & (F.col("simhash") != F.col("v"))).select(F.col("simhash").alias("u"), "v").distinct())
        edges = star if edges is None else edges.union(star)
        label = components(edges).withColumnRenamed("node", "simhash")
        named = rows.join(label, "simhash", "left").withColumn("label", F.coalesce("label", "simhash"))
        mixed = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        mixed = cut_lineage(mixed.select(*key, "n"))
        small = mixed if level == LEVELS else mixed.where(F.col("n") <= leaf)
        inside = named.join(small.select(*key), key)
        a, b = (inside.select(*key, F.col("simhash").alias(c), F.col("label").alias(f"of_{c}")) for c in "uv")
        apart = (F.col("u") < F.col("v")) & (F.col("of_u") != F.col("of_v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= k)
        edges = edges.union(cut_lineage(a.join(b, key).where(apart).select("u", "v").distinct()))
        crowded = mixed.where(F.col("n") > leaf).select(*key)
        if level == LEVELS or crowded.isEmpty():
            return edges
        masks = _finer(masks, k)
        rows = _divided(rows.join(crowded, key, "left_semi"), masks, k)
    return edges


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label) of every node in ``edges(u, v)``; the label is the smallest node of its component.

    Alternates large-star and small-star steps, which need O(log n) rounds in practice. Every round is cut to
    the checkpoint folder, so a lost executor never replays earlier rounds.
    """
    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def oriented(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    edges = cut_lineage(oriented(edges))
    before = state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # nodes without a larger neighbour keep their link through the neighbour that has one
        large = oriented(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        edges = cut_lineage(oriented(small))
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def families(df: DataFrame, id: str, simhash: str = "simhash", k: int = 3) -> DataFrame:
    """(id, family): rows linked by chains of near duplicates, named by their smallest id.

    Works on distinct values, so copies never meet pairwise, and on a few edges of each crowd. Empty texts stay alone.
    """
    firsts = df.where(F.col(simhash) != 0).groupBy(F.col(simhash).alias("node")).agg(F.min(id).alias("__first"))
    labels = components(joining_edges(_values(df, simhash), k))
    named = firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    family = named.groupBy("label").agg(F.min("__first").alias("family"))
    names = named.join(family, "label").select(F.col("node").alias(simhash), "family")
    return df.select(id, simhash).join(names, simhash, "left").select(id, F.coalesce("family", id).alias("family"))


# --- change kinds -----------------------------------------------------------------------------------------


def change_kind(prior: ColumnLike, new: ColumnLike, near: int = 3) -> Column:
    """insert without a prior value, cosmetic within ``near`` bits (0 included), else update."""
    return (
        F.when(_col(prior).isNull(), "insert").when(hamming(prior, new) <= near, "cosmetic").otherwise("update")
    )


def capture_changes(df: DataFrame, key: str, order: list[str], bucket: Column, simhash: str = "simhash", near: int = 3) -> DataFrame:
    """Change kind of each capture against the previous capture of the same key."""
    return lag_by_bucket(df, [key], order, bucket, simhash, "prior").withColumn("change", change_kind("prior", simhash, near))


def classify_change(incoming: DataFrame, stored: DataFrame, near: int = 3, key: str = "canonical_hash") -> DataFrame:
    """Change kind of each incoming notice: against the previous capture in the batch, else the stored notice.

    ``incoming`` needs ``fetched_at`` and a unique ``notice_key``; only key and hash of ``stored`` are read.
    """
    known = stored.select(key, F.col("simhash").alias("__stored"))
    chained = lag_by_bucket(incoming, [key], ["fetched_at", "notice_key"], hour_bucket("fetched_at"), "simhash", "prior")
    return (
        chained.join(known, key, "left")
        .withColumn("prior", F.coalesce("prior", "__stored"))
        .withColumn("change", change_kind("prior", "simhash", near))
        .drop("__stored")
    )
