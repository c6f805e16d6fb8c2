"""The daily run as one batch: pages to notices, changes, matches, dead letters and statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arauto import dims, schemas
from arauto.functions.fields import host, window_is_valid
from arauto.operators import classify, contracts, dedup, digest, enrich, extract, gate, match, ops, tables
from arauto.session import cut_lineage
from arauto.sources import frontier, pages



@dataclass(frozen=True)
class Dimensions:
    sources: DataFrame
    contracts: DataFrame
    institutions: DataFrame
    subscribers: DataFrame


def default_dimensions(spark: SparkSession, institutions: DataFrame, subscribers: DataFrame) -> Dimensions:
    sources = dims.active_sources(spark).unionByName(dims.seed_sources(spark))
    return Dimensions(sources, dims.contracts(spark), institutions, subscribers)


def tagged(raw: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Fetched pages with all that decides where they go: ``violation`` of their contract, ``kind`` and institution of their source
    ('page' for unknown sources), and ``route``: rejected, the kind, or of listings feed, listing or null."""
    known = sources.where("kind is not null").select(F.col("codigo").alias("source"), "kind", F.coalesce("ies_nome", F.lit("")).alias("ies_nome"))
    rows = contracts.check_contracts(pages.with_content_type(raw), rules).join(F.broadcast(known), "source", "left")
    rows = rows.withColumn("kind", F.coalesce("kind", F.lit("page")))
    listing = extract.listing_route(F.col("content_type"), F.col("body"))
    return rows.withColumn("route", F.when(F.col("violation").isNotNull(), "rejected").when(F.col("kind") == "listing", listing).otherwise(F.col("kind")))


def of_kind(raw: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """Pages of one kind of source, with the institution behind it; pages of unknown sources are of kind 'page'."""
    if "kind" in raw.columns:
        return raw.where(F.col("kind") == kind)
    known = sources.where("kind is not null")
    if kind == "page":
        return raw.join(known.select(F.col("codigo").alias("source")), "source", "left_anti")
    s = known.where(F.col("kind") == kind).select(F.col("codigo").alias("source"), F.coalesce("ies_nome", F.lit("")).alias("ies_nome"))
    return raw.join(s, "source")


def extract_listings(raw: DataFrame) -> DataFrame:
    routed = raw if "route" in raw.columns else raw.withColumn("route", extract.listing_route(F.col("content_type"), F.col("body")))
    return extract.extract_feed(routed.where("route = 'feed'"), broken=True).unionByName(extract.extract_listing(routed.where("route = 'listing'")))


#: What turns the pages of each kind of source into parsed notices; a new kind is another entry.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "listing": extract_listings, "search": extract.extract_search, "catalogue": extract.extract_table,
    "page": lambda raw: extract.extract_routed(raw, extract.default_parsers()),
}


def extract_all(raw: DataFrame, sources: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]] = EXTRACTORS) -> DataFrame:
    """Every page through the job its source's kind calls for; one table of parsed notices with ``notice_key``."""
    parsed = frontier.all_sources(*[job(of_kind(raw, sources, kind)) for kind, job in extractors.items()])
    key = F.sha2(F.concat_ws("|", "page_url", F.col("fetched_at").cast("string"), F.col("position").cast("string")), 256)
    return parsed.withColumn("notice_key", key)


def prepare(parsed: DataFrame, institutions: DataFrame) -> DataFrame:
    """Hashes, area and institution of parsed notices. The simhash covers the summary, or the title without one."""
    text = F.coalesce(F.nullif("texto_resumo", F.lit("")), "titulo")
    hashed = parsed.withColumns({"canonical_hash": dedup.canonical_hash(), "simhash": dedup.simhash_of(text)})
    classified = classify.classify_area(hashed).drop("texto_completo", "extras")  # nothing after this reads them
    return gate.resolve_institution(classified, institutions)


def run_batch(raw: DataFrame, d: Dimensions, root: str, batch: int, now: Column, enrichment: DataFrame | None = None,
              extractors: dict[str, Callable[[DataFrame], DataFrame]] = EXTRACTORS) -> None:
    """Process one batch of fetched pages into the tables under ``root``.

    Each table's share is written as ``batch=<n>`` and replaced when the batch runs again. Parsed notices are
    written once and read back, so pages are parsed once for all that follows; the pages of the batch are kept by route until
    the next batch replaces them. Of the stored notices and matches only
    the prefixes that the batch's keys fall in are read and written.
    """
    spark = raw.sparkSession
    at = lambda name: f"{root}/{name}"
    # one pass over the bodies tells where each page goes; it is written by route, so each reader below reads its own part
    routed = tagged(raw, d.sources, d.contracts)
    routed.write.mode("overwrite").partitionBy("kind", "route").parquet(at("routed"))
    routed = spark.read.schema(routed.schema).parquet(at("routed"))
    good = routed.where("route IS NULL OR route != 'rejected'")
    rejected = contracts.violation_letters(routed.where("route = 'rejected'"))

    stored_pages = tables.read_batches(spark, at("snapshots"), schemas.SNAPSHOTS, below=batch)
    tables.write_batch(pages.new_snapshots(good, stored_pages, F.to_date("fetched_at")), at("snapshots"), batch, by=("source", "date"))

    parsed_schema = f"page_url string, fetched_at timestamp, position int, {schemas.PARSED_NOTICES}, notice_key string"
    tables.write_batch(extract_all(good, d.sources, extractors), at("parsed"), batch)
    every = spark.read.schema(parsed_schema).parquet(f"{root}/parsed/batch={batch}")
    unreadable = F.col("parser_name").eqNullSafe(F.lit(extract.BROKEN_FEED))
    parsed = every.where(~unreadable)

    catalogue = parsed.where(extract.is_catalogue_row())
    tables.write_batch(catalogue, at("catalogue"), batch)
    notices = parsed.where(~extract.is_catalogue_row())
    reversed_window = notices.where(~window_is_valid("periodo_inscricao"))
    notices = notices.where(window_is_valid("periodo_inscricao"))

    letters = [
        rejected,
        contracts.dead_letters(reversed_window, "parse", F.lit("reversed window"), F.col("fetched_at"),
                               url=F.col("page_url"), spider=F.col("fonte_codigo")),
        contracts.dead_letters(every.where(unreadable), "parse", F.lit(extract.BROKEN_FEED), F.col("fetched_at"), url=F.col("page_url"), spider=F.col("fonte_codigo")),
    ]
    if enrichment is not None:
        letters.append(contracts.enrichment_conflicts(enrich.low_confidence(notices), enrichment))
        notices = enrich.merge_enrichment(notices, enrichment)
    else:
        notices = notices.withColumn("enriched", F.lit(False))
    tables.write_batch(frontier.all_sources(*letters), at("dead_letters"), batch)

    changes = store_notices(prepare(notices, d.institutions), root, batch, now)
    found = match_changes(changes, d, root, batch, now)

    source_of = changes.select(F.col("canonical_hash").alias("edital_id"), F.col("fonte_codigo").alias("source")).distinct()
    stats = ops.run_stats(
        discovered=routed.select("source"), parsed=parsed.select(F.col("fonte_codigo").alias("source")),
        enriched=changes.where("enriched").select(F.col("fonte_codigo").alias("source")),
        persisted=changes.select(F.col("fonte_codigo").alias("source")),
        matched=found.join(source_of, "edital_id").select("source"),
        failed=spark.read.schema(schemas.DEAD_LETTERS).parquet(f"{root}/dead_letters/batch={batch}").where("stage != 'enrich'").select(
            F.get_json_object("payload", "$.spider").alias("source")))
    tables.write_batch(stats, at("stats"), batch)


# --- stored notices and matches -----------------------------------------------------------------------------


def notice_store(root: str) -> tables.Store:
    return tables.Store(f"{root}/notices", schemas.NOTICES, ("canonical_hash",), tables.NOTICE_UPDATES, "canonical_hash")


def match_store(root: str) -> tables.Store:
    """Cut like the notices, so that a batch of notices touches the same prefixes of both."""
    return tables.Store(f"{root}/matches", schemas.MATCHES, ("subscriber_id", "edital_id"), tables.MATCH_UPDATES, "edital_id")


def institution_store(root: str) -> tables.Store:
    return tables.Store(f"{root}/institutions", schemas.INSTITUTIONS, ("codigo_emec",), tables.INSTITUTION_UPDATES, "codigo_emec", digits=1)


def refresh_registry(registry: DataFrame, root: str, batch: int) -> int:
    """A registry file's institutions into the store; how many were upserted (A13), counted as they are written."""
    return institution_store(root).upsert(registry.where("codigo_emec IS NOT NULL"), batch, ["id"]).rows


def store_notices(prepared: DataFrame, root: str, batch: int, now: Column) -> DataFrame:
    """Prepared notices into the store; returns them with their change kind against what was stored before the batch.

    The changes are kept as a batch of ``changes`` and read back: the matcher and the statistics read them again. Stored
    rows are read and written for the prefixes of the incoming keys only.
    """
    store, spark = notice_store(root), prepared.sparkSession
    prepared = cut_lineage(prepared)
    changes = dedup.classify_change(prepared, store.current(spark, batch, store.prefixes(prepared)))
    tables.write_batch(changes, f"{root}/changes", batch)
    changes = spark.read.schema(changes.schema).parquet(f"{root}/changes/batch={batch}")
    store.upsert(tables.notices_from(changes, now, "fetched_at", "notice_key"), batch, ["fetched_at", "notice_key"])
    store.vacuum(spark)
    return changes


def match_changes(changes: DataFrame, d: Dimensions, root: str, batch: int, now: Column) -> DataFrame:
    """Notices that are new or materially changed through the matcher; cosmetic changes are stored but not matched (F8).

    Returns the batch's matches as stored.
    """
    spark, store, matches = changes.sparkSession, notice_store(root), match_store(root)
    changed = changes.where(F.col("change") != "cosmetic").groupBy("canonical_hash").agg(F.min("ies_nome").alias("ies_nome"))
    candidates = store.current(spark, batch + 1, store.prefixes(changed)).join(changed, "canonical_hash")
    written = matches.upsert(match.match_records(match.match_notices(candidates, d.subscribers, d.institutions), now), batch, ["created_at"])
    matches.vacuum(spark)
    return matches.current(spark, batch + 1, written.prefixes).where(F.col("changed_in") == batch)


def _notices(spark: SparkSession, root: str, expired_below: int | None = None) -> DataFrame:
    """Stored notices with ``changed_in``; those marked as expired since their last change say so."""
    marks = tables.read_batches(spark, f"{root}/expired", tables.MARKS, expired_below)
    rows = tables.marked(notice_store(root).current(spark), marks, "canonical_hash")
    over = F.col("marked_at").isNotNull()
    return rows.withColumns({"status": F.when(over, "expirado").otherwise(F.col("status")), "updated_at": F.coalesce("marked_at", "updated_at")}).drop("marked_at")


def _matches(spark: SparkSession, root: str, sent_below: int | None = None) -> DataFrame:
    """Stored matches with ``changed_in``; those marked as sent since they were last found are notified."""
    marks = tables.read_batches(spark, f"{root}/sent", tables.MARKS, sent_below)
    rows = tables.marked(match_store(root).current(spark), marks, "id")
    return rows.withColumns({"notified": F.col("notified") | F.col("marked_at").isNotNull(), "notified_at": F.coalesce("marked_at", "notified_at")}).drop("marked_at")


def current_notices(spark: SparkSession, root: str) -> DataFrame:
    return _notices(spark, root).select(*[f.name for f in schemas.struct(schemas.NOTICES)])


def current_matches(spark: SparkSession, root: str) -> DataFrame:
    return _matches(spark, root).select(*[f.name for f in schemas.struct(schemas.MATCHES)])


def register_views(spark: SparkSession, root: str, subscribers: DataFrame) -> None:
    """The stored tables as temporary views: notices, matches, institutions, subscribers."""
    stored = {"notices": current_notices(spark, root), "matches": current_matches(spark, root), "subscribers": subscribers,
              "institutions": institution_store(root).current(spark).drop("changed_in")}
    for name, rows in stored.items():
        rows.createOrReplaceTempView(name)


def run_expiry(spark: SparkSession, root: str, run: int, today: Column, now: Column) -> None:
    """Marks stored notices past their deadline as expired. ``run`` counts the expiry's own runs.

    Marks are a table of this job's own, so it may run beside the ingest: a notice that a later capture updates is no
    longer marked. A repeated run replaces its marks.
    """
    open_ = _notices(spark, root, run).where("status != 'expirado'")
    over = tables.expire(open_, today, now).where("status = 'expirado'")
    tables.write_batch(over.select(F.col("canonical_hash").alias("id"), "changed_in", F.col("updated_at").alias("at")), f"{root}/expired", run)


def run_digest(spark: SparkSession, root: str, d: Dimensions, run: int, today: Column, now: Column, hours: int = 24,
               sink: Callable[[DataFrame], None] | None = None, **render: object) -> None:
    """Pending matches to digests, and marks on those that were sent. ``run`` counts the digest's own runs.

    Digests are written as a batch of ``digests``; ``sink`` gets the written rows (to hand them to a channel), and only
    then the matches of the subscribers they went to are marked, in a table of this job's own: it may run beside the
    ingest, in any order. A match that is found again later is no longer marked. A repeated run sends the same again.
    """
    due = cut_lineage(digest.pending(_matches(spark, root, run), now, hours))
    # read for the sizes of the groups, for the ranks and for the marks
    items = cut_lineage(digest.digest_items(due, current_notices(spark, root), d.institutions, dims.areas(spark)))
    tables.write_batch(digest.render_digests(items, d.subscribers, today, **render), f"{root}/digests", run)
    written = spark.read.parquet(f"{root}/digests/batch={run}")
    if sink is not None:
        sink(written)
    shown = items.select(F.col("match_id").alias("id"), "subscriber_id").join(written.select("subscriber_id").distinct(), "subscriber_id", "left_semi")
    sent = due.join(shown.select("id").distinct(), "id", "left_semi")
    tables.write_batch(sent.select("id", "changed_in", now.alias("at")), f"{root}/sent", run)


def match_all(notices: DataFrame, d: Dimensions) -> DataFrame:
    """Matches of all stored notices, for subscribers that joined after the notices came in."""
    named = notices.join(d.institutions.select(F.col("id").alias("ies_id"), F.col("nome").alias("ies_nome")), "ies_id", "left")
    return match.match_notices(named.withColumn("ies_nome", F.coalesce("ies_nome", F.lit(""))), d.subscribers, d.institutions)


def fetch_requests(frontier_rows: DataFrame, robots: DataFrame, rps: float = 0.5, capacity: int = 5) -> DataFrame:
    """Allowed frontier rows with the time the host's rate limit lets each go."""
    allowed = contracts.robots_verdict(frontier_rows, robots).where("allowed").drop("allowed")
    return ops.throttle(allowed.withColumn("host", host("url")), rps, capacity, ts="requested_at", id="url")
