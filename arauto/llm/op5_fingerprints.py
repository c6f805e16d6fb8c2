"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arauto.llm.common import WORD, staged

#: Samples of a fingerprint; the standard error of a likeness s is sqrt(s * (1 - s) / SAMPLES).
SAMPLES = 48
#: Documents of one bucket of the order by doc_id, on average.
BUCKET_DOCS = 2_000


def with_units(df: DataFrame, text: str) -> DataFrame:
    """One row for each word of column ``text``: unit, a hash of (word, how many equal words come before it).

    A word that occurs n times is n units, so texts share the minimum of their counts and have the maximum between them.
    A text without words gives one row with null. Equal words are runs of the sorted hashes, so no row leaves its task.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    df = df.withColumn("hashes", F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))).drop(text)
    last = F.size("hashes") - 1
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("hashes", i) != F.get("hashes", i - 1)))
    df = df.withColumn("starts", F.when(last >= 0, starts))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("hashes"))
    run = lambda s, i: F.transform(F.sequence(F.lit(0), end(i) - s - 1), lambda n: F.xxhash64(F.get("hashes", s), n))
    return df.withColumn("unit", F.explode_outer(F.flatten(F.transform("starts", run)))).drop("hashes", "starts")


def fingerprint(df: DataFrame, key: str, carry: list[str], samples: int = SAMPLES) -> DataFrame:
    """(key, carry, signature array<int>) of rows (key, carry, unit); ``carry`` are longs, equal within a key.

    Consistent weighted sampling for weights that are counts: sample j of a text is the unit (word, level up to its count)
    with the least hash under j, drawn over all units of the text. Two texts agree in a sample with probability sum of
    minima / sum of maxima of their counts. Samples are minima, taken partially before the shuffle: one row a text and
    task moves. All samples of a text without words are null.
    """
    least = [F.min(F.xxhash64("unit", F.lit(j))).alias(f"s{j}") for j in range(samples)]
    out = df.groupBy(key).agg(*[F.max(c).alias(c) for c in carry], F.count("unit").alias("units"), *least)
    low = [F.when(F.col("units") > 0, (F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 31)).cast("int")) for j in range(samples)]
    return out.select(key, *carry, F.array(*low).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree, of those that at least one has; 1.0 if neither has any."""
    each = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).when(x.isNotNull() | y.isNotNull(), 0))
    had = F.filter(each, lambda x: x.isNotNull())
    agree = F.aggregate(had, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(had) == 0, 1.0).otherwise(agree.cast("double") / F.size(had))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most doc_id, found in two steps; -1 for null."""
    step = max(1, math.isqrt(len(bounds)))
    count = lambda xs, v: F.size(F.filter(xs, lambda b: b <= v))
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    every = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    coarse = F.from_json(F.lit(json.dumps(bounds[::step])), "array<bigint>")
    block = F.greatest(count(coarse, doc_id) - 1, F.lit(0)) * step
    return F.when(doc_id.isNull(), -1).otherwise(block + count(F.slice(every, block + 1, step), doc_id))


def with_next(docs: DataFrame) -> DataFrame:
    """pos, next_pos, doc_id, text, next_text: every document with the one after it by descending doc_id (last to first).

    Null ids come last, rows of one doc_id in the order of a hash of their text. Buckets of neighbouring ids are
    ordered apart, so texts move once; a bucket's last row gets the first text of the next bucket from a small table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    n = docs.count()
    parts = max(1, n // BUCKET_DOCS)
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), sorted(set(cuts or []))))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").desc()]
    firsts = staged(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "mark")).alias("top")).select("bucket", F.lead("bucket").over(W.orderBy(F.desc("bucket"))).alias("after"), "top.*"), "buckets")
    highest = F.max("bucket").over(W.partitionBy(F.lit(0)))
    ring = firsts.select("bucket", F.coalesce("after", highest).alias("next_bucket"))
    heads = rows.join(firsts.select("bucket", "doc_id", "mark").alias("f"), (rows["bucket"] == F.col("f.bucket")) & rows["doc_id"].eqNullSafe(F.col("f.doc_id")) & (rows["mark"] == F.col("f.mark")))
    heads = heads.select(F.col("f.bucket").alias("next_bucket"), "text").dropDuplicates(["next_bucket"])
    edge = staged(ring.join(heads, "next_bucket").select("bucket", "next_bucket", F.col("text").alias("head")), "heads")
    w = W.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumn("rn", F.row_number().over(w)).withColumn("following", F.lead("text").over(w))
    rows = rows.join(edge, "bucket", "left")
    at = lambda bucket, rn: F.shiftleft(bucket.cast("long"), 40) + rn
    last = F.col("following").isNull()
    return rows.select(
        at(F.col("bucket"), F.col("rn")).alias("pos"), F.when(last, at(F.col("next_bucket"), F.lit(1))).otherwise(at(F.col("bucket"), F.col("rn") + 1)).alias("next_pos"),
        "doc_id", "text", F.when(last, F.col("head")).otherwise(F.col("following")).alias("next_text"),
    )


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document
    by descending doc_id. Terms are words weighted by their counts; equal texts have equal fingerprints. Null texts are empty; a
    text without words has a fingerprint of dashes and is like (1.0) any other such text only. A table of one
    row is its own next document. Other columns are ignored; repeated rows each give a row.
    """
    k = F.floor(F.col("n_chars") / 3).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - k), F.substring("next_text", F.lit(1), k))
    rows = rows.withColumn("edited", edited).withColumn("sha", F.sha2("edited", 256))
    # the digest goes along as eight numbers, as rows of longs are aggregated without sorting
    digest = [F.conv(F.substring("sha", F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long").alias(f"d{i}") for i in range(8)]
    meta = ["pos", "next_pos", "doc_id", "n_chars", *[f"d{i}" for i in range(8)]]
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body"))))
    rows = rows.select("pos", "next_pos", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), *digest, "text", "edited")
    rows = rows.select(*meta, both.alias("b")).select((F.col("pos") * 2 + F.col("b.which")).alias("key"), *meta, F.col("b.body").alias("body"))
    signed = fingerprint(with_units(rows, "body"), "key", meta, samples)
    side = lambda which: F.max(F.when(F.col("key") % 2 == which, F.col("signature")))
    pairs = signed.groupBy("pos").agg(*[F.max(c).alias(c) for c in meta[1:]], side(0).alias("own"), F.max(F.when(F.abs(F.col("key") % 2) == 1, F.col("signature"))).alias("edited"))
    after = signed.filter(F.col("key") % 2 == 0).select(F.col("pos").alias("next_pos"), F.col("signature").alias("next"))
    text = lambda sig: F.lower(F.array_join(F.transform(sig, lambda x: F.coalesce(F.lpad(F.hex(x.cast("long") + (1 << 31)), 8, "0"), F.lit("--------"))), ""))
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"d{i}"), 8, "0") for i in range(8)]))
    return pairs.join(after, "next_pos").select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), text(F.col("own")).alias("fingerprint"), text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
