"""A training corpus from documents in five stages, each a DataFrame written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arauto.llm.common import WORD, staged
from arauto.llm.op2_mixing import mix_documents
from arauto.llm.op3_jaccard import jaccard_groups
from arauto.llm.op4_language import fit, identify
from arauto.llm.op8_pieces import encode_documents, load
from arauto.llm.op9_substrings import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no text or no letter) go; ``lang`` becomes the predicted one.

    Where no labelled document is left to learn from, nothing is rejected.
    """
    models = fit(docs)
    if models is None:
        return docs.select(*COLUMNS)
    known = identify(docs, models, keep=COLUMNS[1:]).filter("lang_pred != 'und'")
    return known.select("doc_id", F.col("kept_text").alias("text"), F.col("lang_pred").alias("lang"), F.col("kept_source").alias("source"), F.col("kept_n_chars").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, with all its texts if rows repeat its doc_id (equal ones once)."""
    groups = jaccard_groups(docs)
    first = groups.filter("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur earlier go; a document that loses all its words goes with them, others keep their text as it was
    where nothing was removed."""
    done = substring_dedup(docs, keep=("text", "lang", "source")).filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("kept_text")).otherwise(F.col("kept"))
    return done.select("doc_id", text.alias("text"), F.col("kept_lang").alias("lang"), F.col("kept_source").alias("source"), F.length(text).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the one document a source that is taken in part comes with its first words."""
    mixed = mix_documents(docs, keep=("text", "lang"))
    rest = F.col("taken") - F.col("copies") * F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all("kept_text", F.lit(WORD), F.lit(0)), 1, rest.cast("int")), " ")
    whole = F.array_repeat(F.col("kept_text"), F.col("copies").cast("int"))
    texts = F.when(rest > 0, F.concat(whole, F.array(part))).otherwise(whole)
    rows = mixed.select("doc_id", F.explode(texts).alias("text"), F.col("kept_lang").alias("lang"), "source")
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with little memory: the workers of the stages before still live."""
    done = encode_documents(docs, load(), keep=("lang", "source"), with_text=False, memo=60_000, slice_bytes=1 << 19)
    return done.select("doc_id", F.col("kept_lang").alias("lang"), F.col("kept_source").alias("source"), "ids", "n_ids", "round_trip")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("pieces", tokens),
]

#: The language models and the rounding are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
