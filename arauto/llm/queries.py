"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL_GROUPS = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
  u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id)
  SELECT s.doc_id, len(g)::bigint AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(low) AS component_id FROM r GROUP BY 1) USING (doc_id)"""

SQL_WINDOWS = f"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
  x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d),
  f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) AS k FROM x),
  gone AS (SELECT DISTINCT doc_id, p + i AS p FROM f, range(20) t(i) WHERE k > 1),
  v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
  t AS (SELECT v.doc_id, count(gone.p) AS removed, string_agg(word, ' ' ORDER BY v.p) FILTER (gone.p IS NULL) AS kept FROM v LEFT JOIN gone ON gone.doc_id = v.doc_id AND gone.p = v.p GROUP BY 1)
  SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

SQL_NEGATIVES = """WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::bigint AS score FROM (SELECT * FROM r WHERE vec_id % 50 = 0) a JOIN r b ON a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT s.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY s.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::int AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
  SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

SQL_ARCHIVE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages), d AS (SELECT *, sha1(h) AS s FROM p)
  SELECT page_id, strlen(h)::bigint AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (k // 8 * 10 + 1)::int, 10))::bigint >> (35 - 5 * (k % 8))::int) & 31)::int + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d"""

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op9_substring_dedup", SQL_WINDOWS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op9_substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=20, with_text=False).drop("kept")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op10_suffixes import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), length=50, with_text=False).drop("kept")


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op1_sharding import ShardTree, shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), ShardTree(16))


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op2_mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op4_language import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


@query("op7_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op7_pages import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op8_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op8_pieces import encode_documents, load

    return encode_documents(table(spark, sf_dir, "documents"), load(), with_text=False)


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op5_fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op3_jaccard_groups", SQL_GROUPS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op3_jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


@query("op6_embedding_groups")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op6_caps import cap_groups

    return cap_groups(table(spark, sf_dir, "embeddings"))


@query("op11_hard_negatives", SQL_NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op11_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, every=50, positives=5, negatives=3, scale=256)


@query("op12_warc", SQL_ARCHIVE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op12_warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)


@query("op13_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arauto.llm.op13_spelling import document_variants

    return document_variants(table(spark, sf_dir, "documents"), least=7, least_n=2, ratio=10, damage=31)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
