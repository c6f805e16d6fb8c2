"""Keyed tables: upserts, insert-if-absent, expiry, notification marks, and their stored form."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arauto import schemas

NOTICE_UPDATES = ("simhash", "status", "texto_resumo", "url_pdf")
INSTITUTION_UPDATES = ("ativa", "gratuita", "categoria_administrativa", "organizacao_academica")
SUBSCRIBER_UPDATES = (
    "email", "formacao", "areas_alvo", "niveis_aceitos", "modalidades_aceitas", "apenas_gratuitos",
    "apenas_ies_emec_publicas", "score_minimo", "digest_cron", "ativo",
)
MATCH_UPDATES = ("score", "notified", "notified_at", "explanation_json", "created_at")


def collapse(incoming: DataFrame, keys: list[str], updates: list[str], order: list[str]) -> DataFrame:
    """One row per key with ``first`` (all columns of the earliest row) and ``last`` (update columns of the latest).

    Both are aggregates, so copies of a key merge before the shuffle.
    """
    others = [c for c in incoming.columns if c not in keys]
    by = F.struct(*order)
    return incoming.groupBy(*keys).agg(
        F.min_by(F.struct(*others), by).alias("first"), F.max_by(F.struct(*updates), by).alias("last"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], updates: list[str], order: list[str]) -> DataFrame:
    """``stored`` after applying ``incoming`` in ``order``.

    A new key is inserted with its first row's values; every later row of a key only overwrites ``updates`` (also
    with nulls). One full outer join; the result has the columns of ``stored``.
    """
    new = collapse(incoming, keys, updates, order).withColumn("__new", F.lit(True))
    old = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("old")).withColumn("__old", F.lit(True))
    joined = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        kept = F.when(F.col("__old"), F.col(f"old.{c}"))
        if c in incoming.columns:
            kept = kept.otherwise(F.col(f"first.{c}"))
        return (F.when(F.col("__new"), F.col(f"last.{c}")).otherwise(kept) if c in updates else kept).alias(c)

    return joined.select(*[F.col(c) if c in keys else value(c) for c in stored.columns])


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored, the first of each key."""
    others = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"))
    return first.join(stored.select(*keys), keys, "left_anti").select(*keys, "r.*")


def upsert_institutions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["codigo_emec"], list(INSTITUTION_UPDATES), ["id"])


def upsert_subscribers(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["nome"], list(SUBSCRIBER_UPDATES), ["id"])


def upsert_matches(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A pair that matches again is updated and queued for sending again."""
    return upsert(stored, incoming, ["subscriber_id", "edital_id"], list(MATCH_UPDATES), ["created_at"])


def mark_notified(matches: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """``matches`` with the ids in ``sent`` flagged and stamped."""
    done = sent.select("id").distinct().withColumn("__sent", F.lit(True))
    hit = F.coalesce("__sent", F.lit(False))
    return matches.join(done, "id", "left").withColumns({
        "notified": F.when(hit, True).otherwise(F.col("notified")),
        "notified_at": F.when(hit, now).otherwise(F.col("notified_at")),
    }).drop("__sent")


def expire(notices: DataFrame, today: Column, now: Column, deadline: str = "inscricao_ate") -> DataFrame:
    over = F.coalesce(F.col(deadline) < today, F.lit(False))
    return notices.withColumns({
        "status": F.when(over, "expirado").otherwise(F.col("status")),
        "updated_at": F.when(over, now).otherwise(F.col("updated_at")),
    })


def notices_from(parsed: DataFrame, now: Column, *keep: str) -> DataFrame:
    """Parsed notices (hashed, classified, institution resolved) in the shape of the stored table.

    Unknown tuition counts as free. The id follows from the canonical hash. ``keep`` names columns to carry along.
    """
    own = {c: F.col(c) for c in ("titulo", "ies_id", "nivel", "modalidade", "area_cnpq_codigo", "vagas", "url_origem",
                                 "url_pdf", "texto_resumo", "canonical_hash", "simhash")}
    return parsed.select(*keep, *schemas.fields(
        schemas.NOTICES, id=F.col("canonical_hash"), is_gratuito=F.coalesce("is_gratuito", F.lit(True)),
        inscricao_de=F.col("periodo_inscricao.de"), inscricao_ate=F.col("periodo_inscricao.ate"),
        identificador_externo_valor=F.col("identificador_externo.valor"),
        identificador_externo_fonte=F.col("identificador_externo.fonte"),
        status=F.lit("publicado"), created_at=now, updated_at=now, **own))


# --- stored form ------------------------------------------------------------------------------------------
#
# What only grows (pages, parsed rows, letters, statistics, marks) is a folder of batches, batch=<n>, each written whole;
# writing a batch again replaces it, so a retried micro-batch leaves no trace. Keyed tables are stores, see below.


def write_batch(rows: DataFrame, path: str, batch: int, by: tuple[str, ...] = ()) -> None:
    """``by`` partitions the batch's folder further, so that readers of one source or day prune."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The files under a folder, or None where it does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_batches(spark: SparkSession, path: str, schema: str, below: int | None = None) -> DataFrame:
    """All batches (those before ``below``), with their number; empty when the folder does not exist."""
    rows = _files(spark, path, f"{schema}, batch bigint")
    if rows is None:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return rows if below is None else rows.where(F.col("batch") < below)


def current(batches: DataFrame, keys: list[str], updates: tuple[str, ...], order: tuple[str, ...] = ("batch",)) -> DataFrame:
    """The table a folder of batches describes: first insert, latest updates."""
    folded = collapse(batches, keys, list(updates), list(order))
    return folded.select(*[
        F.col(c) if c in keys else F.col(f"last.{c}" if c in updates else f"first.{c}").alias(c)
        for c in batches.columns if c not in ("batch", "seq")])


def batch_clock(spark: SparkSession, path: str, batch: int, now: Column) -> Column:
    """The time of a batch, kept by the first attempt: a repeated one stores the same times."""
    kept = lambda: [r["t"] for r in read_batches(spark, path, "t bigint").where(F.col("batch") == batch).collect()]
    if not kept():
        write_batch(spark.range(1).select(F.unix_micros(now).alias("t")), path, batch)
    return F.timestamp_micros(F.lit(kept()[0]))


@dataclass(frozen=True)
class Written:
    """What a batch wrote to a store: the prefixes, and how many rows it inserted or updated."""

    prefixes: list[str]
    rows: int


@dataclass(frozen=True)
class Store:
    """A keyed table cut by a hash of ``prefix_by`` into 16 ** ``digits`` prefixes, each in versions: batch=<n>/prefix=<p>.

    A batch reads only the prefixes its keys fall in, and writes them anew under its own number; the current table is the
    latest version of every prefix, found by listing. Nothing that a reader may have open is overwritten, a repeated
    batch starts from what was there before it (``below``) and replaces its own folder. ``changed_in`` names the batch
    that inserted a row or last updated it. One job writes a store; others keep marks in tables of their own.
    """

    path: str
    schema: str
    keys: tuple[str, ...]
    updates: tuple[str, ...]
    prefix_by: str
    digits: int = 2

    def _prefix(self) -> Column:
        slot = F.pmod(F.xxhash64(self.prefix_by), F.lit(16**self.digits))
        return F.concat(F.lit("p"), F.lpad(F.lower(F.hex(slot)), self.digits, "0"))

    def prefixes(self, rows: DataFrame) -> list[str]:
        """Prefixes that ``rows`` touch: 16 ** ``digits`` at most."""
        return sorted(r["p"] for r in rows.select(self._prefix().alias("p")).distinct().collect())

    def _listed(self, spark: SparkSession) -> list[tuple[int, str]]:
        files = _files(spark, self.path, self.schema)
        found = [] if files is None else files.inputFiles()
        return sorted({(int(m[1]), m[2]) for f in found if (m := re.search(r"/batch=(\d+)/prefix=(p[0-9a-f]+)/", f))})

    def versions(self, spark: SparkSession, below: int | None = None) -> dict[str, int]:
        """The latest batch (before ``below``) of every prefix."""
        return {p: b for b, p in self._listed(spark) if below is None or b < below}

    def current(self, spark: SparkSession, below: int | None = None, prefixes: list[str] | None = None) -> DataFrame:
        """The rows (those under ``prefixes``), with ``changed_in``; no other file is read."""
        latest = self.versions(spark, below)
        folders = [f"{self.path}/batch={b}/prefix={p}" for p, b in sorted(latest.items()) if prefixes is None or p in prefixes]
        schema = f"{self.schema}, changed_in bigint"
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def upsert(self, incoming: DataFrame, batch: int, order: list[str]) -> Written:
        """Applies ``incoming`` in ``order`` as a batch. Gives one shuffle by key and one that deals rows to prefixes by size;
        changed rows are counted as they are written."""
        spark = incoming.sparkSession
        touched = self.prefixes(incoming)
        if not touched:
            return Written([], 0)
        stored = self.current(spark, batch, touched)
        merged = upsert(stored, incoming.withColumn("changed_in", F.lit(batch).cast("bigint")), list(self.keys), [*self.updates, "changed_in"], order)
        passing = Observation()
        merged = merged.observe(passing, F.count_if(F.col("changed_in") == batch).alias("rows"))
        write_batch(merged.withColumn("prefix", self._prefix()).hint("rebalance", F.col("prefix")), self.path, batch, by=("prefix",))
        return Written(touched, passing.get["rows"])

    def superseded(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Folders of versions that have ``keep`` newer ones of their prefix."""
        by_prefix: dict[str, list[int]] = {}
        for b, p in self._listed(spark):
            by_prefix.setdefault(p, []).append(b)
        return [f"{self.path}/batch={b}/prefix={p}" for p, bs in by_prefix.items() for b in bs[:-keep - 1]]

    def vacuum(self, spark: SparkSession, keep: int = 2) -> None:
        """Removes superseded versions, which bounds what is listed; ``keep`` is what running readers and a repeated batch need."""
        for folder in self.superseded(spark, keep):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Marks a job sets on rows of a store: they hold for the version of the row that they name.
MARKS = "id string, changed_in bigint, at timestamp"


def marked(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """``rows`` of a store with ``marked_at``, the latest mark of the row as it is now (null without one)."""
    latest = marks.groupBy(F.col("id").alias(key), "changed_in").agg(F.max("at").alias("marked_at"))
    return rows.join(latest, [key, "changed_in"], "left")
