"""Fetched pages: scan, derived columns, snapshots, replay, sitemaps and registry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arauto import schemas
from arauto.functions.text import ColumnLike, _col
from arauto.operators.dedup import content_hash


# --- derived columns --------------------------------------------------------------------------------------


def content_type(headers: ColumnLike = "headers") -> Column:
    value = F.coalesce(_col(headers)["content-type"], F.lit(""))
    return F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))


def is_html(ct: ColumnLike) -> Column:
    return F.contains(_col(ct), F.lit("html"))


def is_pdf(ct: ColumnLike) -> Column:
    return _col(ct) == "application/pdf"


def is_feed(ct: ColumnLike) -> Column:
    """Content type of XML, RSS or Atom; also the test for probed feed addresses."""
    return _col(ct).rlike("xml|rss|atom")


def body_text(body: ColumnLike = "body") -> Column:
    """UTF-8 text with invalid bytes replaced."""
    return F.make_valid_utf8(_col(body).cast("string"))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return with_content_type(spark.read.schema(schemas.RAW_RESPONSES).parquet(path))


def stream_pages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schemas.RAW_RESPONSES).option("maxFilesPerTrigger", max_files)
    return with_content_type(reader.parquet(path))


def with_content_type(raw: DataFrame) -> DataFrame:
    ct = content_type()
    return raw.withColumns({"content_type": ct, "is_html": is_html(ct), "is_pdf": is_pdf(ct), "is_feed": is_feed(ct)})


# --- snapshots --------------------------------------------------------------------------------------------


def _captures(raw: DataFrame, date: Column) -> DataFrame:
    ct = content_type()
    suffix = F.when(is_pdf(ct), ".pdf").when(is_html(ct), ".html").when(is_feed(ct), ".xml").otherwise(".bin")
    sha = content_hash("body")
    return raw.select(
        sha.alias("id"), "url", F.col("status").alias("http_status"), ct.alias("content_type"), sha.alias("sha256"),
        F.octet_length("body").cast("long").alias("bytes_size"),
        F.concat("source", F.lit("/"), date.cast("string"), F.lit("/"), sha, suffix).alias("storage_path"),
        "headers", "body", "source", date.cast("string").alias("date"), "final_url", "fetched_at",
    )


def _first_of_each(captures: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first capture of each content (that is not stored), found on hashes and addresses alone.

    Bodies take part in no sort or aggregate: they meet their winning key in one join. Only captures that repeat in
    every column of the key are dealt by content, to keep one of them.
    """
    key = ["fetched_at", "url", "source"]
    keys = captures.select("sha256", *key)
    if stored is not None:
        keys = keys.join(stored.select("sha256"), "sha256", "left_anti")
    counted = keys.groupBy("sha256", *key).agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("sha256").agg(F.min(F.struct(*key, "n")).alias("k")).select("sha256", "k.*")

    def matching(winners: DataFrame) -> DataFrame:
        same = [captures[c].eqNullSafe(winners[c]) for c in key]
        return captures.join(winners, [captures["sha256"] == winners["sha256"], *same], "left_semi")

    return matching(first.where("n = 1")).unionByName(matching(first.where("n > 1")).dropDuplicates(["sha256"]))


def snapshot_rows(raw: DataFrame, date: Column) -> DataFrame:
    """One content-addressed row per distinct body: sha256, size and '<source>/<date>/<sha><suffix>'.

    Copies of a body keep the first capture.
    """
    return _first_of_each(_captures(raw, date))


def new_snapshots(raw: DataFrame, stored: DataFrame, date: Column) -> DataFrame:
    """Snapshots whose content is not stored yet; only the hash column of ``stored`` is read."""
    return _first_of_each(_captures(raw, date), stored)


def find_snapshot(snapshots: DataFrame, sha256: str) -> DataFrame:
    return snapshots.where(F.col("sha256") == sha256)


def replay(snapshots: DataFrame) -> DataFrame:
    """Stored snapshots as fetched pages again: the extraction jobs run on them without any network."""
    return with_content_type(snapshots.select(
        "url", F.coalesce("final_url", "url").alias("final_url"), F.col("http_status").alias("status"), "headers", "body",
        F.coalesce("fetched_at", F.to_timestamp("date")).alias("fetched_at"), F.lit("cache").alias("via"), "source",
    ))


# --- sitemaps and registry --------------------------------------------------------------------------------


def sitemap_urls(raw: DataFrame) -> DataFrame:
    """(source, url) of every <loc> in fetched sitemaps."""
    parsed = raw.select("source", F.from_xml(body_text(), schemas.SITEMAP_XML).alias("x"))
    return parsed.select("source", F.explode("x.url.loc").alias("url")).select("source", F.trim("url").alias("url"))


def new_urls(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    return today.distinct().join(yesterday, today.columns, "left_anti")


def read_registry(spark: SparkSession, path: str, only_public: bool = True) -> DataFrame:
    """Institutions of a registry file {'ies': [...]}: active ones, and public ones unless told otherwise."""
    return registry_rows(spark.read.schema(schemas.REGISTRY_JSON).json(path, multiLine=True), only_public)


def registry_rows(payloads: DataFrame, only_public: bool = True) -> DataFrame:
    rows = payloads.select(F.inline("ies"))
    active = F.coalesce("ativa", F.lit(True))
    kept = rows.where(active & F.coalesce("publica", F.lit(False))) if only_public else rows.where(active)
    text = {c: F.coalesce(c, F.lit("")) for c in
            ("sigla", "nome", "categoria_administrativa", "organizacao_academica", "uf", "municipio")}
    return kept.select(*schemas.fields(
        schemas.INSTITUTIONS, id=F.col("codigo_emec"), codigo_emec=F.col("codigo_emec"), ativa=active,
        gratuita=F.coalesce("publica", F.lit(True)), **text,
    ))
