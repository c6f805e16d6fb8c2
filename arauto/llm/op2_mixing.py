"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arauto.llm.common import WORD, staged

#: Fractional documents that one task of the tree rounds against each other.
FAN = 4096
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) of rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A source whose
    part is above ``most`` times its size stops there and the excess goes to the others by weight, until none is above.
    In order of capacity per weight, a source is full if the ones before it are and the level that would use up the
    rest is above its own; one row a source is sorted, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / left).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first open source sets the level of all that follow
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "n", target.alias("target"))


def _pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions to 0 or 1 so that the words taken stay the same; returns them and the index left fractional, or -1.

    Two fractional documents trade words until one is whole: the transfer goes either way with the odds that keep
    each document's expectation.
    """
    p = p.copy()
    held = -1
    for i in range(len(p)):
        if held < 0:
            held = i
            continue
        a, b, sa, sb = p[held], p[i], size[held], size[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        move = up if u[i] * (up + down) < down else -down
        a, b = a + move / sa, b - move / sb
        whole_a, whole_b = min(a, 1 - a) < 1e-9, min(b, 1 - b) < 1e-9
        p[held], p[i] = (round(a) if whole_a else a), (round(b) if whole_b else b)
        held = -1 if whole_a and whole_b else (i if whole_a else held)
    return p, held


def _level(last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["size", "u", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, held = _pivot(g["p"].to_numpy(float), g["size"].to_numpy(float), g["u"].to_numpy(float))
        g["p"] = p
        g["fractional"] = np.arange(len(g)) == held
        if last:
            g["fractional"] = False
        return g

    return run


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (whole takes) of every document, with the columns ``keep``.

    Every document of a source has the same expected number of takes, target / source_size. Its whole part is taken; the
    fractions are rounded pivotally in groups of at most about FAN documents, each group leaves one fractional document,
    and these go up a reduction tree until a source has one left, which gives its fraction in words. So a source's
    taken words differ from its target by less than one word, and reruns agree (draws are hashes). A hot source is
    many groups. Null or blank texts have size 0 and take 0; a null source is a source (the last); null ids and repeated
    rows are rounded like others; an empty table gives an empty result. Columns other than these are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("mark"), *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    targets = staged(source_targets(rows.select("source", "size"), weights, share, most), "targets")
    rows = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target", "n")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(expected), F.lit(int(most)))
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", "mark", F.lit(seed)), 11).cast("double") + 0.5) * 2.0**-53
    rows = rows.withColumn("base", base.cast("long")).withColumn("p", expected - F.col("base")).withColumn("u", draw)
    rows = rows.withColumn("groups", F.ceil(F.col("n") / FAN)).withColumn("part", F.pmod(F.xxhash64("mark", "doc_id", F.lit("part")), F.col("groups")))
    whole = (F.col("size") == 0) | (F.col("p") < 1e-9)
    names = ["doc_id", "source", "size", "mark", *[f"kept_{c}" for c in keep], "source_size", "target", "base", "p", "u", "groups", "part"]
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("fractional", T.BooleanType())])
    out = [rows.filter(whole).select(*names).withColumn("p", F.lit(0.0)).withColumn("fractional", F.lit(False))]
    todo = rows.filter(~whole).select(*names)
    largest = targets.agg(F.max("n")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(2, largest), FAN)))
    for level in range(levels):
        last = level == levels - 1
        part = F.lit(0).cast("long") if last else F.col("part")
        todo = todo.withColumn("part", part)
        done = todo.groupBy("source", "part").applyInPandas(_level(last), schema=schema)
        if not last:
            done = staged(done, "mixed")
        out.append(done.filter(~F.col("fractional")))
        if not last:
            # FAN groups of one level meet in one group of the next
            todo = done.filter("fractional").drop("fractional").withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    taken = F.col("base") * F.col("size") + F.round(F.col("p") * F.col("size")).cast("long")
    copies = F.col("base") + F.floor(F.col("p") + 1e-9)
    return every.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.cast("long").alias("copies"), "source", *[f"kept_{c}" for c in keep])
