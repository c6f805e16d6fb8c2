"""What the plans must look like, whatever the data."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arauto import dims, schemas
from arauto.operators import listing, ops
from arauto.plans import catalog, ingest, q_ops, q_pages, q_tables, q_text

SMALL = "/root/testdata/sf0.001"
STREAMED = {n for n in catalog.QUERIES if n.startswith(("stream_", "ingested_"))}


def plan(df):
    return df._jdf.queryExecution().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMED - {"near_duplicate_families"}))
def test_no_cross_joins(spark, name):
    text = physical(catalog.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_listing_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    q_tables.order_notices(spark, SMALL).write.parquet(path)
    page, total = listing.list_notices(spark.read.parquet(path), today=F.lit("1998-06-15").cast("date"), level="O")
    text = physical(page)
    assert "EqualTo(nivel,O)" in text and "GreaterThanOrEqual(inscricao_ate,1998-06-15)" in text and "TakeOrderedAndProject" in text
    schema = re.search(r"ReadSchema: (\S+)", physical(total)).group(1)
    assert "texto_resumo" not in schema and "titulo" not in schema


def test_scans_are_pruned(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in physical(q_text.document_hashes(spark, SMALL))
    assert "props" not in physical(q_ops.circuit_open(spark, SMALL))


def test_paths_without_python(spark):
    for fn in (q_text.near_duplicates, q_text.canonical_hashes, q_text.classify_area, q_text.application_windows, q_tables.match_notices,
               q_tables.digests, q_ops.throttle, q_ops.circuit_open):
        assert "Python" not in physical(fn(spark, SMALL)) and "Arrow" not in physical(fn(spark, SMALL))


def test_schemas_parse(spark):
    for name, ddl in vars(schemas).items():
        if name.isupper() and isinstance(ddl, str) and name not in ("PERIOD", "TARGET_AREAS"):
            assert schemas.struct(ddl).fields


def test_a_filter_on_listings_takes_no_second_parse(spark):
    plan = entry.queries()["listing_articles"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse(") == 1


def test_the_class_of_characters_that_change_stands_behind_bounds(spark):
    import unicodedata

    from arauto.functions import text as t

    source, _, unstable = t._nfkc_rules()
    inside = lambda cp: any(lo <= cp <= hi for lo, hi in t._STABLE_BLOCKS)
    same = lambda cp: cp < 0x80 or cp == 0xFEFF or inside(cp) and unicodedata.normalize("NFKC", chr(cp)) == chr(cp)
    chars = [cp for cp in range(1, 0x110000) if not 0xD800 <= cp < 0xE000]
    rows = spark.createDataFrame([(cp, chr(cp)) for cp in chars if cp < 0x12000 or cp % 977 == 0], "cp int, c string")
    got = {r.cp for r in rows.where(F.col("c").rlike(unstable)).collect()}
    assert got == {cp for cp in chars if (cp < 0x12000 or cp % 977 == 0) and not same(cp)} and set(map(ord, source)) <= got
    assert unstable.startswith("[\\x{A0}-\\x{10FFFF}&&[")  # Latin letters meet one range


def test_the_groups_of_a_digest_are_sorted_once(spark):
    digests = q_tables.digest.render_digests(q_tables.order_items(spark, SMALL), q_tables.nation_subscribers(spark, SMALL), F.lit("1998-03-01"))
    plan = digests.select("body_html")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1  # in a lambda it would be sorted again for every item


def test_what_a_match_says_is_worked_out_before_the_join(spark):
    plan = q_tables.match_explanations(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan[:plan.index("Join")]


def test_parts_as_pages_are_dealt_to_all_cores(spark):
    assert entry.queries()["blog_notices"](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert catalog.dealt(spark.range(45).coalesce(1), 5).rdd.getNumPartitions() == 9


def unbroadcast(spark, make):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return physical(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_pages_are_not_dealt_by_their_source(spark):
    sources = dims.active_sources(spark).unionByName(dims.seed_sources(spark))
    for make in (lambda: q_pages.page_contracts(spark, SMALL), lambda: ingest.tagged(q_pages.html_responses(spark, SMALL).drop("content_type"), sources, q_pages.contract_rows(spark))):
        text = unbroadcast(spark, make)
        assert "BroadcastHashJoin" in text and "hashpartitioning(source" not in text


def test_digest_items_are_not_dealt_by_their_area(spark):
    assert "hashpartitioning(codigo" not in unbroadcast(spark, lambda: q_tables.order_items(spark, SMALL))
