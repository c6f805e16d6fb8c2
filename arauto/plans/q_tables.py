"""Keyed tables, registry, matching, listing and digest queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arauto import dims, schemas
from arauto.operators import contracts, dedup, digest, enrich, gate, listing, match, ops, tables
from arauto.plans import ingest
from arauto.plans.catalog import dealt, query, sql_simhash, table
from arauto.plans.q_text import CAPTURES, SQL_FROM, SQL_LEVEL, SQL_MODE, SQL_TO, order_texts, part_notices, sql_pick
from arauto.functions import fields as f
from arauto.session import checkpoint_dir
from arauto.sources import frontier, pages

# --- upserts ----------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT o_custkey AS k, arg_min(o_orderdate, (o_orderdate, o_orderkey)) AS first_day, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
    arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1)
  SELECT coalesce(c.c_custkey, n.k) AS k, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name ELSE strftime(n.first_day, '%Y-%m-%d') END AS titulo,
    CASE WHEN n.k IS NOT NULL THEN n.status ELSE c.c_mktsegment END AS status,
    CASE WHEN n.k IS NOT NULL THEN CASE WHEN n.priority = '5-LOW' THEN NULL ELSE n.priority END ELSE 'stored' END AS resumo
  FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN n ON n.k = c.c_custkey""")
def notice_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers in credit as stored rows, orders as incoming captures; nulls overwrite too."""
    stored = table(spark, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("titulo"), F.col("c_mktsegment").alias("status"), F.lit("stored").alias("resumo"))
    incoming = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("titulo"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("resumo"), "o_orderdate", "o_orderkey")
    return tables.upsert(stored, incoming, ["k"], ["status", "resumo"], ["o_orderdate", "o_orderkey"])


@query("""SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 THEN 'velha' ELSE 'nova' END AS nome, 'C' || s_nationkey AS categoria, s_acctbal > 5000 AS ativa FROM supplier""")
def institution_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    row = lambda name, category, active: s.select(*schemas.fields(
        schemas.INSTITUTIONS, id=F.col("s_suppkey"), codigo_emec=F.col("s_suppkey"), nome=F.lit(name), categoria_administrativa=category, ativa=active,
        gratuita=F.lit(True)), "s_acctbal")
    stored = row("velha", F.lit("?"), F.lit(True)).where("s_acctbal > 0").drop("s_acctbal")
    incoming = row("nova", F.concat(F.lit("C"), F.col("s_nationkey").cast("string")), F.col("s_acctbal") > 5000).drop("s_acctbal")
    done = tables.upsert_institutions(stored, incoming)
    return done.select(F.col("codigo_emec").cast("long").alias("id"), "nome", F.col("categoria_administrativa").alias("categoria"), "ativa")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def source_insert(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "documents").select("doc_id", "lang")
    return tables.insert_absent(table(spark, d, "labels").select("doc_id"), incoming, ["doc_id"], ["lang"])


@query("""SELECT s_name AS nome, s_name || '@new' AS email, 2.0::double AS score_minimo, s_acctbal > 0 AS ativo FROM supplier""")
def subscriber_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    row = lambda mail, minimum: s.select(*schemas.fields(
        schemas.SUBSCRIBERS, id=F.col("s_suppkey"), nome=F.col("s_name"), email=F.concat("s_name", F.lit(mail)), score_minimo=F.lit(minimum), ativo=F.col("s_acctbal") > 0))
    return tables.upsert_subscribers(row("@old", 1.0), row("@new", 2.0)).select("nome", "email", "score_minimo", "ativo")


@query("""SELECT CASE WHEN o_orderdate::date < DATE '1998-01-01' THEN 'expirado' ELSE 'publicado' END AS status, count(*) AS n,
  count(*) FILTER (o_orderdate::date < DATE '1998-01-01') AS touched FROM orders GROUP BY 1""")
def expired_notices(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("inscricao_ate"), F.lit("publicado").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    done = tables.expire(n, F.lit("1998-01-01").cast("date"), F.lit("1998-01-01").cast("timestamp"))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("updated_at").alias("touched"))


# --- listing ----------------------------------------------------------------------------------------------

SQL_UUID = "regexp_replace(md5(o_orderkey::varchar), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')"
SQL_LISTED = f"""SELECT {SQL_UUID} AS id, o_orderstatus AS nivel, o_orderpriority AS modalidade, ate FROM (
  SELECT *, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate::date END AS ate FROM orders)
  WHERE o_orderstatus = 'O' AND (ate IS NULL OR ate >= DATE '1998-06-15')"""


def order_notices(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders (the table, or a stream of it) as stored notices: the date is the deadline, unless the priority is not specified."""
    orders = table(spark, d, "orders") if orders is None else orders
    uuid = F.regexp_replace(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    return orders.select(*schemas.fields(
        schemas.NOTICES, id=uuid, titulo=F.concat(F.lit("Pedido "), F.col("o_orderkey").cast("string")), nivel=F.col("o_orderstatus"), modalidade=F.col("o_orderpriority"),
        inscricao_ate=F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.to_date("o_orderdate")), ies_id=F.col("o_custkey"), is_gratuito=F.lit(True),
        url_origem=F.concat(F.lit("https://o.org/"), F.col("o_orderkey").cast("string")), 
        area_cnpq_codigo=F.when(F.col("o_orderstatus") == "O", "10300007").when(F.col("o_orderstatus") == "P", "99999999"), status=F.lit("publicado"), created_at=F.col("o_orderdate")))


TODAY = "1998-06-15"


@query(f"SELECT id, nivel, modalidade, ate::varchar AS inscricao_ate FROM ({SQL_LISTED}) ORDER BY ate ASC NULLS LAST, id LIMIT 50 OFFSET 100")
def listing_page(spark: SparkSession, d: str) -> DataFrame:
    got, _ = listing.list_notices(order_notices(spark, d), today=F.lit(TODAY).cast("date"), level="O", limit=50, offset=100)
    return got.select("id", "nivel", "modalidade", F.col("inscricao_ate").cast("string").alias("inscricao_ate"))


@query(f"SELECT count(*) AS total FROM ({SQL_LISTED})")
def listing_total(spark: SparkSession, d: str) -> DataFrame:
    return listing.list_notices(order_notices(spark, d), today=F.lit(TODAY).cast("date"), level="O")[1]


@query(f"""SELECT {SQL_UUID} AS id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate::date::varchar END AS inscricao_ate FROM orders
  ORDER BY CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate::date END ASC NULLS LAST, id LIMIT 100""")
def active_notices(spark: SparkSession, d: str) -> DataFrame:
    return listing.list_active(order_notices(spark, d)).select("id", F.col("inscricao_ate").cast("string").alias("inscricao_ate"))


@query(f"SELECT {SQL_UUID} AS id, o_orderstatus AS nivel, 'publicado' AS status, true AS is_gratuito, 'Pedido ' || o_orderkey AS titulo FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels WHERE quality = 1)")
def looked_up_notices(spark: SparkSession, d: str) -> DataFrame:
    """Requested ids: those of labelled documents; the low-quality ones are malformed."""
    ids = table(spark, d, "labels").select(F.concat(
        F.md5(F.col("doc_id").cast("string").cast("binary")), F.when(F.col("quality") == 1, "").otherwise("zz")).alias("id"))
    uuid = F.regexp_replace("id", "^(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    found = listing.lookup(listing.public_view(order_notices(spark, d)), ids.select(uuid.alias("id")))
    return found.select("id", "nivel", "status", "is_gratuito", "titulo")


# --- registry ---------------------------------------------------------------------------------------------


def nation_institutions(spark: SparkSession, d: str) -> DataFrame:
    """Nations as institutions; those of Europe charge fees and those of Asia are closed."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(*schemas.fields(
        schemas.INSTITUTIONS, id=F.col("n_nationkey"), codigo_emec=F.col("n_nationkey"), sigla=F.col("n_name"), nome=F.concat(F.lit("Universidade de "), "n_name"),
        ativa=F.col("r_name") != "ASIA", gratuita=F.col("r_name") != "EUROPE"))


SQL_OPEN_NATIONS = "SELECT n_nationkey, lower(n_name) AS term FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')"
SQL_CUSTOMER_IES = "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' NATION_' || c_nationkey || ' ' WHEN c_mktsegment = 'FURNITURE' THEN 'Faculdade ' || c_mktsegment ELSE 'Câmpus ' || c_mktsegment || ' - nation_' || c_nationkey || ' - unidade' END"


def customer_notices(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_nationkey").cast("string")
    name = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit(" NATION_"), key, F.lit(" "))).when(
        F.col("c_mktsegment") == "FURNITURE", F.concat(F.lit("Faculdade "), "c_mktsegment")).otherwise(
        F.concat(F.lit("Câmpus "), "c_mktsegment", F.lit(" - nation_"), key, F.lit(" - unidade")))
    return table(spark, d, "customer").select("c_custkey", name.alias("ies_nome"))


@query(f"""SELECT c_custkey, EXISTS (SELECT 1 FROM ({SQL_OPEN_NATIONS}) t WHERE contains(lower({SQL_CUSTOMER_IES}), t.term)) AS in_registry FROM customer""")
def registry_gate(spark: SparkSession, d: str) -> DataFrame:
    return gate.registry_gate(customer_notices(spark, d), nation_institutions(spark, d)).select("c_custkey", "in_registry")


@query(f"""SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_nationkey::varchar END AS ies_id FROM customer""")
def resolved_institutions(spark: SparkSession, d: str) -> DataFrame:
    got = gate.resolve_institution(customer_notices(spark, d), nation_institutions(spark, d))
    return got.select("c_custkey", "ies_id")


@query("""SELECT p_brand AS marca, CASE WHEN p_brand IN (SELECT 'Brand#' || n_nationkey FROM nation) THEN regexp_extract(p_brand, '[0-9]+') ELSE (
    SELECT min(n_nationkey::varchar) FROM nation WHERE contains(lower('Curso Brand#' || n_nationkey || ' EAD'), lower(p_brand))) END AS ies_id FROM part GROUP BY 1""")
def resolved_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Brands looked up among institutions whose full names contain them."""
    brand = F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string"))
    inst = table(spark, d, "nation").select(*schemas.fields(
        schemas.INSTITUTIONS, id=F.col("n_nationkey"), sigla=F.upper(brand), nome=F.concat(F.lit("Curso "), brand, F.lit(" EAD"))))
    brands = table(spark, d, "part").select(F.col("p_brand").alias("ies_nome")).distinct()
    return gate.resolve_institution(brands, inst).select(F.col("ies_nome").alias("marca"), "ies_id")


@query("SELECT count(DISTINCT n_nationkey) AS size FROM nation")
def registry_size(spark: SparkSession, d: str) -> DataFrame:
    return gate.registry_size(nation_institutions(spark, d))


@query("SELECT s_suppkey::varchar AS codigo, s_name AS nome, s_nationkey <> 3 AS gratuita FROM supplier WHERE s_acctbal > 0")
def registry_file(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers packed into registry payloads of one institution each and read like a registry file."""
    entry = F.struct(F.col("s_suppkey").cast("string").alias("codigo_emec"), F.col("s_name").alias("nome"), (F.col("s_acctbal") > 0).alias("ativa"), (F.col("s_nationkey") != 3).alias("publica"))
    payload = table(spark, d, "supplier").select(F.from_json(F.to_json(F.struct(F.array(entry).alias("ies"))), schemas.REGISTRY_JSON).alias("p"))
    return pages.registry_rows(payload.select("p.ies"), only_public=False).select(F.col("codigo_emec").alias("codigo"), "nome", "gratuita")


# --- matching ---------------------------------------------------------------------------------------------

BRAND_NUMBER = "regexp_extract(p_brand, '[0-9]+')::int"


def part_match_notices(spark: SparkSession, d: str) -> DataFrame:
    """Parts as notices: brand is the area, type the level, size the mode and price the tuition."""
    n = part_notices(dealt(table(spark, d, "part")))
    return n.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("area_cnpq_codigo"), f.level_from_text("titulo").alias("nivel"),
        f.mode_from_text("texto").alias("modalidade"), (F.col("p_retailprice") > 1000).alias("is_gratuito"),
        F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string")).alias("ies_nome"))


def supplier_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as subscribers: two target brands, levels and modes by nation, thresholds by balance."""
    key = F.col("s_suppkey")
    brand = lambda n: F.concat(F.lit("Brand#"), (F.pmod(n, F.lit(25)) + 1).cast("string"))
    area = lambda code, mode, weight, needs: F.struct(
        code.alias("codigo_cnpq"), F.lit(mode).alias("modo"), F.lit(weight).alias("peso"), F.lit(needs).alias("requer_aceita_cs"))
    return table(spark, d, "supplier").select(*schemas.fields(
        schemas.SUBSCRIBERS, id=key, nome=F.col("s_name"), email=F.lit(""),
        areas_alvo=F.array(area(brand(key), "exact", 1.0, False), area(brand(key + 1), "cross_discipline", 0.7, True), area(brand(key), "cross_discipline", 0.25, False)),
        niveis_aceitos=F.when(F.col("s_nationkey") < 12, F.array(*map(F.lit, ("mba", "especializacao", "doutorado")))).otherwise(F.array(*map(F.lit, dims.LEVELS[2:5]))),
        modalidades_aceitas=F.array(*map(F.lit, ("presencial", "ead", "uab"))), apenas_gratuitos=F.col("s_nationkey") < 20,
        apenas_ies_emec_publicas=F.col("s_acctbal") < 8000, score_minimo=F.when(F.col("s_acctbal") < 2000, 1.2).otherwise(0.7), ativo=F.col("s_acctbal") > -500))


ADMITTING = tuple(f"Brand#{i}" for i in range(1, 16))
SQL_PAIRS = f"""WITH n AS (SELECT p_partkey, p_brand, {SQL_LEVEL} AS nivel, {SQL_MODE} AS modalidade, p_retailprice > 1000 AS free,
    EXISTS (SELECT 1 FROM ({SQL_OPEN_NATIONS}) t WHERE contains('nation_' || p_partkey % 25, t.term)) AS listed FROM part),
  s AS (SELECT *, 'Brand#' || (s_suppkey % 25 + 1) AS b1, 'Brand#' || ((s_suppkey + 1) % 25 + 1) AS b2, CASE WHEN s_acctbal < 2000 THEN 1.2 ELSE 0.7 END AS low FROM supplier),
  p AS (SELECT *, CASE WHEN p_brand = b1 THEN 1.25 WHEN p_brand = b2 AND {BRAND_NUMBER} <= 15 THEN 0.7 ELSE 0 END AS raw,
    CASE WHEN s_nationkey < 20 AND NOT free THEN 'hard:nao_gratuito' WHEN s_acctbal < 8000 AND NOT listed THEN 'hard:ies_fora_whitelist:NATION_' || p_partkey % 25
         WHEN (s_nationkey < 12 AND nivel NOT IN ('mba', 'especializacao', 'doutorado')) OR (s_nationkey >= 12 AND nivel NOT IN ('mestrado_academico', 'mestrado_profissional', 'doutorado')) THEN 'hard:nivel_nao_aceito:' || nivel
         WHEN modalidade NOT IN ('presencial', 'ead', 'uab') THEN 'hard:modalidade_nao_aceita:' || modalidade END AS hard FROM n JOIN s ON TRUE)"""
SQL_SOFT = "'soft:score=' || printf('%.2f', raw) || CASE WHEN raw >= low THEN '>=min=' ELSE '<min=' END || low"
SQL_CONTRIB = "CASE raw WHEN 1.25 THEN b1 || ':exact:+1.00,' || b1 || ':cross_discipline:+0.25' WHEN 0.7 THEN b2 || ':cross_discipline:+0.70' ELSE '' END"


@query(f"""{SQL_PAIRS} SELECT s_suppkey::varchar AS subscriber_id, p_partkey::varchar AS edital_id, raw::double AS score, CASE WHEN raw >= 0.85 THEN 'high' ELSE 'mid' END AS bucket,
  {SQL_SOFT} AS reason, {SQL_CONTRIB} AS contributing FROM p WHERE s_acctbal > -500 AND hard IS NULL AND raw >= low""")
def match_notices(spark: SparkSession, d: str) -> DataFrame:
    m = match.match_notices(part_match_notices(spark, d), supplier_profiles(spark, d), nation_institutions(spark, d), admitting=ADMITTING)
    return m.select("subscriber_id", "edital_id", "score", "bucket", F.col("reasons")[0].alias("reason"), F.array_join("contributing_areas", ",").alias("contributing"))


@query(f"""{SQL_PAIRS} SELECT s_suppkey::varchar AS subscriber_id, p_partkey::varchar AS edital_id, '{{"matched":true,"score":' || raw::double || ',"reasons":["' || {SQL_SOFT} || '"],"contributing_areas":["'
  || replace({SQL_CONTRIB}, ',', '","') || '"]}}' AS explanation_json FROM p WHERE s_acctbal > -500 AND hard IS NULL AND raw >= low""")
def match_explanations(spark: SparkSession, d: str) -> DataFrame:
    m = match.match_notices(part_match_notices(spark, d), supplier_profiles(spark, d), nation_institutions(spark, d), admitting=ADMITTING)
    return m.select("subscriber_id", "edital_id", "explanation_json")


@query(f"""{SQL_PAIRS} SELECT s_name AS profile, CASE WHEN raw >= 0.85 THEN 'high' ELSE 'mid' END AS bucket, count(*) AS n FROM p
  WHERE s_acctbal > -500 AND hard IS NULL AND raw >= low GROUP BY ALL""")
def match_buckets(spark: SparkSession, d: str) -> DataFrame:
    m = match.match_notices(part_match_notices(spark, d), supplier_profiles(spark, d), nation_institutions(spark, d), admitting=ADMITTING, counted=True)
    return ops.stage_counters(m.select(F.col("subscriber").alias("profile"), "bucket", "notices"), "profile", "bucket", value="notices")


@query(f"""{SQL_PAIRS}, q AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  SELECT s_suppkey::varchar AS subscriber_id, p_partkey::varchar AS edital_id, hard IS NULL AND raw >= low AS matched, CASE WHEN hard IS NULL THEN raw ELSE 0 END::double AS score,
  coalesce(hard, {SQL_SOFT}) AS reason, CASE WHEN hard IS NULL THEN {SQL_CONTRIB} ELSE '' END AS contributing FROM p JOIN q ON l_partkey = p_partkey AND l_suppkey = s_suppkey""")
def explained_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every (part, supplier) pair that was ever ordered, explained."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("subscriber_id"), F.col("l_partkey").cast("string").alias("edital_id")).distinct()
    e = match.explain_pairs(pairs, part_match_notices(spark, d), supplier_profiles(spark, d), nation_institutions(spark, d), ADMITTING)
    return e.select("subscriber_id", "edital_id", "matched", "score", F.col("reasons")[0].alias("reason"), F.array_join("contributing_areas", ",").alias("contributing"))


@query("""SELECT s_name AS nome, 'Brand#' || (s_suppkey % 25 + 1) AS area, CASE WHEN s_nationkey < 12 THEN 'mba' ELSE 'mestrado_academico' END AS nivel, 3::int AS areas,
  s_nationkey < 20 AS apenas_gratuitos FROM supplier""")
def profile_json(spark: SparkSession, d: str) -> DataFrame:
    p = match.profile_from_json(match.profile_to_json(supplier_profiles(spark, d)))
    return p.select("nome", F.col("areas_alvo")[0]["codigo_cnpq"].alias("area"), F.col("niveis_aceitos")[0].alias("nivel"), F.size("areas_alvo").alias("areas"), "apenas_gratuitos")


# --- pending matches and digests --------------------------------------------------------------------------

NOW = "1998-03-01 12:00:00"
SQL_PENDING = f"""SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, o_orderdate FROM orders
  WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR"""


def order_matches(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    """Orders (the table, or a stream of it) as match records of the customer's nation (subscriber) and the order (notice)."""
    o = (table(spark, d, "orders") if orders is None else orders).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(*schemas.fields(
        schemas.MATCHES, id=F.col("o_orderkey"), subscriber_id=F.col("c_nationkey"), edital_id=F.col("o_orderkey"), score=F.round(F.col("o_totalprice") / 500000, 3),
        notified=F.col("o_orderstatus") == "F", created_at=F.col("o_orderdate")))


@query(f"SELECT o_orderkey::varchar AS id, round(o_totalprice / 500000, 3) AS score FROM ({SQL_PENDING})")
def pending_matches(spark: SparkSession, d: str) -> DataFrame:
    return digest.in_order(digest.pending(order_matches(spark, d), F.lit(NOW).cast("timestamp"), 2400)).select("id", "score")


@query(f"SELECT o_orderkey::varchar AS id, o_orderstatus = 'F' AS notified FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR")
def resent_matches(spark: SparkSession, d: str) -> DataFrame:
    """All matches since a date, sent ones too."""
    since = F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - 2400 * 3600)
    return digest.pending(order_matches(spark, d), F.lit(NOW).cast("timestamp"), since=since).select("id", "notified")


@query(f"SELECT o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR AS notified, o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR AS stamped, count(*) AS n FROM orders GROUP BY ALL")
def marked_matches(spark: SparkSession, d: str) -> DataFrame:
    m, now = order_matches(spark, d), F.lit(NOW).cast("timestamp")
    done = tables.mark_notified(m, digest.pending(m, now, 2400), now)
    return done.groupBy("notified", F.col("notified_at").isNotNull().alias("stamped")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey::varchar AS subscriber_id, o_clerk AS edital_id, score, notified FROM (
    SELECT o_custkey, o_orderpriority AS o_clerk, arg_max(round(o_totalprice / 500000, 3), (o_orderdate, o_orderkey)) AS score, false AS notified FROM orders GROUP BY ALL)""")
def match_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Repeated matches of a (customer, priority) pair: updated and queued again."""
    o = table(spark, d, "orders").select(
        *schemas.fields(schemas.MATCHES, id=F.concat_ws("|", "o_custkey", "o_orderpriority"), subscriber_id=F.col("o_custkey"), edital_id=F.col("o_orderpriority"),
                        score=F.round(F.col("o_totalprice") / 500000, 3), notified=F.lit(False),
                        created_at=F.timestamp_micros(F.unix_micros(F.col("o_orderdate")) + F.col("o_orderkey"))), "o_orderstatus")
    stored = tables.insert_absent(o.where("false").drop("o_orderstatus"), o.where("o_orderstatus = 'F'").drop("o_orderstatus").withColumn("notified", F.lit(True)), ["subscriber_id", "edital_id"], ["created_at"])
    return tables.upsert_matches(stored, o.drop("o_orderstatus")).select("subscriber_id", "edital_id", "score", "notified")


def sql_items(orders: str, extra: str = "") -> str:
    return f"""SELECT {extra}o_orderkey::varchar AS match_id, c_nationkey::varchar AS subscriber_id, 'Pedido ' || o_orderkey AS titulo, c_name AS ies_nome,
  upper(o_orderstatus) AS nivel_label, {sql_pick('o_orderpriority', [('1-URGENT', '1-urgent'), ('2-HIGH', '2-high'), ('3-MEDIUM', '3-medium'), ('4-NOT SPECIFIED', '4-not Specified'), ('5-LOW', '5-low')])} AS modalidade_label,
  CASE o_orderstatus WHEN 'O' THEN 'Ciencia da Computacao' ELSE '' END AS area_label, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%d') END AS prazo,
  'https://o.org/' || o_orderkey AS url_origem, round(o_totalprice / 500000, 3) AS score FROM ({orders}) JOIN customer ON c_custkey = o_custkey"""


SQL_ITEMS = sql_items(SQL_PENDING)
#: The text of a digest over items ``r`` with their rank, grouped with the name of the subscriber; ``{day}`` is its day.
SQL_BODY = """'Editais — ' || {day} || chr(10) || chr(10) || count(*) || ' edital(is) encontrado(s) no seu perfil (' || n_name || ').' || chr(10) || chr(10) || string_agg(
      '- ' || titulo || chr(10) || '  ' || ies_nome || ' | ' || modalidade_label || CASE area_label WHEN '' THEN '' ELSE ' | ' || area_label END || coalesce(chr(10) || '  Inscrições até: ' || prazo, '')
      || chr(10) || '  Score: ' || printf('%.2f', score) || chr(10) || '  ' || url_origem || chr(10), '' ORDER BY rank)"""


def notice_of_match() -> Column:
    """A match names the order by its key, the notice by an id derived from it."""
    return F.regexp_replace(F.md5(F.col("edital_id").cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def order_items(spark: SparkSession, d: str) -> DataFrame:
    inst = table(spark, d, "customer").select(*schemas.fields(schemas.INSTITUTIONS, id=F.col("c_custkey"), nome=F.col("c_name")))
    pending = digest.pending(order_matches(spark, d), F.lit(NOW).cast("timestamp"), 2400)
    notices = order_notices(spark, d)
    return digest.digest_items(pending.withColumn("edital_id", notice_of_match()), notices, inst, dims.areas(spark))


@query(SQL_ITEMS)
def digest_items(spark: SparkSession, d: str) -> DataFrame:
    return order_items(spark, d).drop("url_pdf")


@query(f"SELECT subscriber_id, nivel_label, count(*) AS n FROM ({SQL_ITEMS}) GROUP BY ALL")
def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    return digest.level_groups(order_items(spark, d))


def nation_subscribers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(*schemas.fields(
        schemas.SUBSCRIBERS, id=F.col("n_nationkey"), nome=F.col("n_name"), email=F.when(F.col("n_regionkey") == 0, "").otherwise(F.lower("n_name")), ativo=F.col("n_regionkey") != 4))


@query(f"""WITH i AS ({SQL_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY score DESC, match_id) AS rank FROM i)
  SELECT subscriber_id, count(*) AS total, '[editais] ' || count(*) || ' novo(s) edital(is) — 1998-03-01' AS subject,
    CASE WHEN n_regionkey = 0 THEN 'all@example.org' ELSE lower(n_name) END AS recipient,
    md5('Editais — 1998-03-01' || chr(10) || chr(10) || count(*) || ' edital(is) encontrado(s) no seu perfil (' || n_name || ').' || chr(10) || chr(10) || string_agg(
      '- ' || titulo || chr(10) || '  ' || ies_nome || ' | ' || modalidade_label || CASE area_label WHEN '' THEN '' ELSE ' | ' || area_label END || coalesce(chr(10) || '  Inscrições até: ' || prazo, '')
      || chr(10) || '  Score: ' || printf('%.2f', score) || chr(10) || '  ' || url_origem || chr(10), '' ORDER BY rank)) AS body
  FROM r JOIN nation ON n_nationkey::varchar = subscriber_id WHERE n_regionkey <> 4 GROUP BY subscriber_id, n_regionkey, n_name""")
def digests(spark: SparkSession, d: str) -> DataFrame:
    out = digest.render_digests(order_items(spark, d), nation_subscribers(spark, d), F.lit("1998-03-01"), "all@example.org", part_size=100_000)
    return out.select("subscriber_id", "total", "subject", "recipient", F.md5("body_text").alias("body"))


@query(f"""WITH i AS ({SQL_ITEMS}), t AS (SELECT subscriber_id, count(*) AS total FROM i JOIN nation ON n_nationkey::varchar = subscriber_id WHERE n_regionkey <> 4 GROUP BY 1)
  SELECT subscriber_id, part::int AS part, ceil(total / 50.0)::int AS parts, least(50, total - (part - 1) * 50) AS items FROM t, range(1, 100000) x(part) WHERE part <= ceil(total / 50.0)""")
def digest_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same digests in parts of 50 items."""
    out = digest.render_digests(order_items(spark, d), nation_subscribers(spark, d), F.lit("1998-03-01"), part_size=50)
    items = F.size(F.split("body_html", "<div>")) - 1
    return out.select("subscriber_id", "part", "parts", items.cast("long").alias("items"))


@query(f"""WITH i AS ({SQL_ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY score DESC, match_id) AS rank, count(*) OVER (PARTITION BY subscriber_id) AS total FROM i)
  SELECT subscriber_id, ((rank - 1) // 500 + 1)::int AS part, md5('Editais — 1998-03-01' || chr(10) || chr(10) || total || ' edital(is) encontrado(s) no seu perfil (' || n_name || ').' || chr(10) || chr(10) || string_agg(
      '- ' || titulo || chr(10) || '  ' || ies_nome || ' | ' || modalidade_label || CASE area_label WHEN '' THEN '' ELSE ' | ' || area_label END || coalesce(chr(10) || '  Inscrições até: ' || prazo, '')
      || chr(10) || '  Score: ' || printf('%.2f', score) || chr(10) || '  ' || url_origem || chr(10), '' ORDER BY rank)) AS body
  FROM r JOIN nation ON n_nationkey::varchar = subscriber_id WHERE n_regionkey <> 4 GROUP BY subscriber_id, part, total, n_name""")
def digest_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Digest texts at the default part size."""
    out = digest.render_digests(order_items(spark, d), nation_subscribers(spark, d), F.lit("1998-03-01"), "all@example.org")
    return out.select("subscriber_id", "part", F.md5("body_text").alias("body"))


@query(f"""SELECT o_orderkey::varchar AS id, o_orderstatus = 'F' OR (o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR AND n_regionkey <> 4) AS notified,
  o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR AND n_regionkey <> 4 AS stamped
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def digest_job(spark: SparkSession, d: str) -> DataFrame:
    """The stored matches after the digest job: those it sent are marked, those of inactive subscribers stay."""
    root = f"{checkpoint_dir(spark)}/digest-{uuid.uuid4().hex}"
    ingest.match_store(root).upsert(order_matches(spark, d).withColumn("edital_id", notice_of_match()), 0, ["created_at"])
    ingest.notice_store(root).upsert(order_notices(spark, d).withColumn("canonical_hash", F.col("id")), 0, ["id"])
    inst = table(spark, d, "customer").select(*schemas.fields(schemas.INSTITUTIONS, id=F.col("c_custkey"), nome=F.col("c_name")))
    dimensions = ingest.Dimensions(None, None, inst, nation_subscribers(spark, d))
    ingest.run_digest(spark, root, dimensions, 1, F.lit("1998-03-01"), F.lit(NOW).cast("timestamp"), 2400)
    return ingest.current_matches(spark, root).select("id", "notified", F.col("notified_at").isNotNull().alias("stamped"))


@query(f"""SELECT subscriber_id, count(*) AS total FROM ({SQL_ITEMS}) JOIN nation ON n_nationkey::varchar = subscriber_id WHERE n_regionkey <> 4 GROUP BY 1""")
def delivered_digests(spark: SparkSession, d: str) -> DataFrame:
    """What the digest job hands to its sink, here a folder."""
    root = f"{checkpoint_dir(spark)}/delivered-{uuid.uuid4().hex}"
    ingest.match_store(root).upsert(order_matches(spark, d).withColumn("edital_id", notice_of_match()), 0, ["created_at"])
    ingest.notice_store(root).upsert(order_notices(spark, d).withColumn("canonical_hash", F.col("id")), 0, ["id"])
    inst = table(spark, d, "customer").select(*schemas.fields(schemas.INSTITUTIONS, id=F.col("c_custkey"), nome=F.col("c_name")))
    dimensions = ingest.Dimensions(None, None, inst, nation_subscribers(spark, d))
    sink = lambda rows: rows.write.parquet(f"{root}/sent-out")
    ingest.run_digest(spark, root, dimensions, 1, F.lit("1998-03-01"), F.lit(NOW).cast("timestamp"), 2400, sink=sink)
    return spark.read.parquet(f"{root}/sent-out").select("subscriber_id", "total").distinct()


@query("""SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN false END, true) AS is_gratuito, 'publicado' AS status, true AS known FROM labels""")
def persisted_notices(spark: SparkSession, d: str) -> DataFrame:
    """Labels as parsed notices in the stored shape: unknown tuition counts as free, the state is one of the lifecycle's."""
    free = F.when(F.col("quality") == 1, True).when(F.col("toxic") == 1, False)
    parsed = table(spark, d, "labels").select("doc_id", *schemas.fields(schemas.PARSED_NOTICES, is_gratuito=free), F.lit(None).cast("string").alias("ies_id"),
                                              F.col("doc_id").cast("string").alias("canonical_hash"), F.lit(0).cast("long").alias("simhash"))
    n = tables.notices_from(parsed, F.lit(NOW).cast("timestamp"), "doc_id")
    return n.select("doc_id", "is_gratuito", "status", F.col("status").isin(*dims.STATUSES).alias("known"))


@query("""SELECT o_orderstatus AS nivel, count(*) AS matches, count(DISTINCT c_nationkey) AS subscribers, max(round(o_totalprice / 500000, 3)) AS best FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def stored_views(spark: SparkSession, d: str) -> DataFrame:
    """Plain SQL over the stored tables."""
    root = f"{checkpoint_dir(spark)}/views-{uuid.uuid4().hex}"
    ingest.match_store(root).upsert(order_matches(spark, d).withColumn("edital_id", notice_of_match()), 0, ["created_at"])
    ingest.notice_store(root).upsert(order_notices(spark, d).withColumn("canonical_hash", F.col("id")), 0, ["id"])
    ingest.register_views(spark, root, nation_subscribers(spark, d))
    return spark.sql("""SELECT n.nivel, count(*) AS matches, count(DISTINCT s.id) AS subscribers, max(m.score) AS best
      FROM matches m JOIN notices n ON n.id = m.edital_id JOIN subscribers s ON s.id = m.subscriber_id GROUP BY n.nivel""")


# --- enrichment -------------------------------------------------------------------------------------------


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as parsed notices (confidence by length) and labels as their enrichment."""
    docs = table(spark, d, "documents")
    parsed = docs.select(F.col("doc_id").cast("string").alias("notice_key"), *schemas.fields(
        schemas.PARSED_NOTICES, titulo=F.col("lang"), ies_nome=F.col("source"), nivel=F.when(F.col("lang") == "en", "mba").otherwise("desconhecido"),
        modalidade=F.lit("ead"), vagas=F.lit(5), confidence=F.when(F.col("n_chars") > 2000, 0.9).otherwise(0.4), parser_name=F.lit("pdf"),
        extras=F.create_map(F.lit("n"), F.col("n_chars").cast("string"))))
    enrichment = table(spark, d, "labels").select(*schemas.fields(
        schemas.ENRICHMENT, notice_key=F.col("doc_id"), titulo=F.when(F.col("quality") == 1, "bom").otherwise(""), nivel=F.when(F.col("quality") == 1, "Doutorado em x").otherwise("mba"),
        modalidade=F.when(F.col("toxic") == 1, "presencial"), vagas=F.col("toxic"), is_gratuito=F.col("quality") == 1,
        periodo_inscricao=F.lit('{"ate":"2026-01-02"}'), confidence=F.when(F.col("toxic") == 0, 0.8)))
    return parsed, enrichment


@query("""SELECT d.doc_id::varchar AS notice_key, CASE WHEN u AND quality = 1 THEN 'bom' ELSE lang END AS titulo, source AS ies_nome,
  CASE WHEN u THEN CASE WHEN quality = 1 THEN 'doutorado' ELSE 'mba' END WHEN lang = 'en' THEN 'mba' ELSE 'desconhecido' END AS nivel,
  CASE WHEN u AND toxic = 1 THEN 'presencial' ELSE 'ead' END AS modalidade, CASE WHEN u THEN toxic ELSE 5 END::int AS vagas, CASE WHEN u THEN quality = 1 END AS gratuito,
  CASE WHEN u THEN '?..2026-01-02' ELSE '' END AS periodo, CASE WHEN n_chars > 2000 THEN 0.9 WHEN u THEN CASE WHEN toxic = 0 THEN 0.8 ELSE 0.7 END ELSE 0.4 END::double AS confidence,
  CASE WHEN u THEN 'pdf+llm' ELSE 'pdf' END AS parser_name, CASE WHEN u THEN 'true' END AS marca
  FROM (SELECT d.*, quality, toxic, l.doc_id IS NOT NULL AND n_chars <= 2000 AS u FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) d""")
def enrichment_merge(spark: SparkSession, d: str) -> DataFrame:
    m = enrich.merge_enrichment(*labelled(spark, d))
    return m.select("notice_key", "titulo", "ies_nome", "nivel", "modalidade", "vagas", F.col("is_gratuito").alias("gratuito"), f.window_label("periodo_inscricao").alias("periodo"),
                    "confidence", "parser_name", F.col("extras")["llm_enriched"].alias("marca"))


@query("""SELECT reason, count(*) AS n FROM (SELECT 'conflict:' || CASE WHEN a AND b THEN 'nivel,modalidade' WHEN a THEN 'nivel' ELSE 'modalidade' END AS reason FROM (
    SELECT lang = 'en' AND quality = 1 AS a, toxic = 1 AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars <= 2000) WHERE a OR b) GROUP BY 1""")
def enrichment_conflicts(spark: SparkSession, d: str) -> DataFrame:
    parsed, enrichment = labelled(spark, d)
    letters = contracts.enrichment_conflicts(enrich.low_confidence(parsed), enrichment)
    return letters.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- frontier ---------------------------------------------------------------------------------------------


@query("""SELECT s_name AS source, CASE WHEN s_acctbal > 5000 THEN 'https://f.org/' || s_suppkey ELSE 'https://l.org/' || s_suppkey END AS url, s_suppkey::int AS priority FROM supplier WHERE s_acctbal > 0 AND s_nationkey <> 3""")
def listing_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sources: some with a feed, some with a listing only, one nation switched off, debtors with neither."""
    key = F.col("s_suppkey").cast("string")
    s = table(spark, d, "supplier").select(*schemas.fields(
        schemas.SOURCES, codigo=F.col("s_name"), ativa=F.col("s_nationkey") != 3, feed_url=F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("https://f.org/"), key)),
        listing_url=F.when(F.col("s_acctbal") > 0, F.concat(F.lit("https://l.org/"), key)).otherwise(""), priority=F.col("s_suppkey")))
    return frontier.listing_frontier(frontier.active(s))


@query("""SELECT DISTINCT o_orderdate::date::varchar AS day, t AS termo, 'https://www.in.gov.br/consulta/-/buscar/dou?q=' || replace(t, ' ', '+') || '&delta=ate&publicadoDe=' ||
  strftime(o_orderdate - INTERVAL 7 DAY, '%d-%m-%Y') || '&publicadoAte=' || strftime(o_orderdate, '%d-%m-%Y') || '&currentPage=1&rowsPerPage=50' AS url FROM orders,
  unnest(['edital pos-graduacao', 'processo seletivo mestrado', 'processo seletivo doutorado', 'chamada publica especializacao', 'edital programa de pos-graduacao']) u(t)""")
def search_frontier(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return frontier.search_frontier(days, "day").select(F.col("day").cast("string").alias("day"), "termo", "url")


@query("""SELECT DISTINCT p_brand AS codigo, 'https://sucupira.capes.gov.br/sucupira/public/consultas/coleta/programa/listaPrograma.jsf?areaConhecimentoCodigo=' || replace(p_brand, '#', '%23') AS url FROM part""")
def catalogue_frontier(spark: SparkSession, d: str) -> DataFrame:
    return frontier.catalogue_frontier(table(spark, d, "part").select(F.col("p_brand").alias("codigo")).distinct()).select("codigo", "url")


@query("""SELECT source, count(*) AS n FROM (SELECT s_name AS source FROM supplier UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_brand FROM part) GROUP BY 1""")
def source_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.col(c).alias("source"), F.col(extra)) for t, c, extra in
             (("supplier", "s_name", "s_suppkey"), ("customer", "c_mktsegment", "c_name"), ("part", "p_brand", "p_size"))]
    return frontier.all_sources(*parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, CAST({SQL_FROM} AS VARCHAR) || '..' || CAST({SQL_TO} AS VARCHAR) AS periodo FROM orders WHERE {SQL_FROM} > {SQL_TO}")
def reversed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Notices whose window ends before it starts: set aside one by one."""
    n = order_texts(table(spark, d, "orders")).select("o_orderkey", f.application_window("texto").alias("w"))
    return n.where(~f.window_is_valid("w")).select("o_orderkey", f.window_label("w").alias("periodo"))


# --- stored tables ----------------------------------------------------------------------------------------


def turn_captures(spark: SparkSession, d: str, batch: int) -> DataFrame:
    """Conversations as notices, their turns as captures. At first a fifth of the conversations is captured whole, most others with one
    turn; then the captures go on, of the whole ones only the last turn is fetched again."""
    c = table(spark, d, "conversations")
    c = c.join(c.groupBy("conv_id").agg(F.max("turn").alias("last")), "conv_id")
    kind = F.col("conv_id") % 5
    c = c.where((kind == 1) | ((kind != 0) & (F.col("turn") < 1))) if batch == 0 else c.where((kind != 1) | (F.col("turn") == F.col("last")))
    at = F.timestamp_seconds(F.lit(1_767_225_600 + batch * 864_000) + F.col("turn") * 3600)
    key = F.col("conv_id").cast("string")
    return c.select(*schemas.fields(
        schemas.PARSED_NOTICES, titulo=key, ies_nome=F.lit("NATION_1"), fonte_codigo=F.lit("s"), nivel=F.lit("mba"), modalidade=F.lit("ead"), is_gratuito=F.lit(True), texto_resumo=F.col("text")),
        key.alias("canonical_hash"), dedup.simhash_of("text").alias("simhash"), F.lit(None).cast("string").alias("ies_id"), at.alias("fetched_at"),
        F.concat_ws("|", "conv_id", "turn").alias("notice_key"), "turn")


def open_profile(spark: SparkSession) -> DataFrame:
    """A subscriber to whom every notice of its level and mode is a match."""
    row = {"id": "all", "nome": "all", "email": "", "formacao": "", "areas_alvo": [], "niveis_aceitos": ["mba"], "modalidades_aceitas": ["ead"], "apenas_gratuitos": False,
           "apenas_ies_emec_publicas": False, "score_minimo": 0.0, "digest_cron": "", "ativo": True}
    return spark.createDataFrame([tuple(row.values())], schemas.SUBSCRIBERS)


@query(f"""WITH x AS (SELECT id // 1000 AS k, id % 1000 AS turn, simhash, max(id % 1000) OVER (PARTITION BY id // 1000) AS last FROM ({sql_simhash(CAPTURES)})),
  c AS (SELECT k, turn, simhash, 0 AS b FROM x WHERE k % 5 = 1 OR (k % 5 <> 0 AND turn < 1) UNION ALL SELECT k, turn, simhash, 1 FROM x WHERE k % 5 <> 1 OR turn = last),
  p AS (SELECT *, lag(simhash) OVER (PARTITION BY k ORDER BY b, turn) AS prior FROM c),
  q AS (SELECT k, turn, CASE WHEN prior IS NULL THEN 'insert' WHEN bit_count(xor(prior, simhash)) <= 3 THEN 'cosmetic' ELSE 'update' END AS change FROM p WHERE b = 1),
  t AS (SELECT conv_id AS k, arg_max(text, turn) AS resumo FROM conversations GROUP BY 1)
  SELECT k::varchar AS notice, turn::int AS turn, change, bool_or(change <> 'cosmetic') OVER (PARTITION BY k) AS matched, resumo, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS created_in FROM q JOIN t USING (k)""")
def second_batch_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two batches through the stored tables: how the second changes what the first left, and which notices went to the matcher."""
    root = f"{checkpoint_dir(spark)}/second-{uuid.uuid4().hex}"
    dimensions = ingest.Dimensions(None, None, nation_institutions(spark, d), open_profile(spark))
    for batch in (0, 1):
        now = F.timestamp_seconds(F.lit(1_767_225_600 + batch * 864_000))
        changes = ingest.store_notices(turn_captures(spark, d, batch), root, batch, now)
        found = ingest.match_changes(changes, dimensions, root, batch, now)
    stored = ingest.current_notices(spark, root).select("canonical_hash", F.col("texto_resumo").alias("resumo"), (F.unix_timestamp("created_at") > 1_767_225_600).cast("int").alias("created_in"))
    matched = found.select(F.col("edital_id").alias("canonical_hash"), F.lit(True).alias("matched"))
    out = changes.select("canonical_hash", F.col("turn").cast("int").alias("turn"), "change").join(stored, "canonical_hash").join(matched, "canonical_hash", "left")
    return out.select(F.col("canonical_hash").alias("notice"), "turn", "change", F.coalesce("matched", F.lit(False)).alias("matched"), "resumo", "created_in")


@query("""SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS first, count(*) AS second, count(*) FILTER (s_acctbal <= 0) AS added,
  count(*) FILTER (NOT (s_nationkey <> 3)) AS closed FROM supplier""")
def registry_refresh_count(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in credit as a registry, then all of them: rows upserted by either refresh, and what the second did."""
    root = f"{checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}"
    s = table(spark, d, "supplier")
    row = lambda open_, active: s.where("s_acctbal > 0" if open_ else "true").select(*schemas.fields(
        schemas.INSTITUTIONS, id=F.col("s_suppkey"), codigo_emec=F.col("s_suppkey"), nome=F.lit("first" if open_ else "second"), ativa=active, gratuita=F.lit(True)))
    first = ingest.refresh_registry(row(True, F.lit(True)), root, 0)
    second = ingest.refresh_registry(row(False, F.col("s_nationkey") != 3), root, 1)
    stored = ingest.institution_store(root).current(spark)
    return stored.agg(F.lit(first).alias("first"), F.lit(second).alias("second"), F.count_if(F.col("nome") == "second").alias("added"), F.count_if(~F.col("ativa")).alias("closed"))
