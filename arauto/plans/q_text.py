"""Text, field, hash and classification queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arauto import dims
from arauto.functions import fields as f
from arauto.functions.text import clip, normalize_text, strip_tags, to_ascii, tokens
from arauto.operators import classify, dedup
from arauto.plans.catalog import query, sql_fold, sql_simhash, sql_squeeze, table

# --- derived texts ----------------------------------------------------------------------------------------

LEVEL_PHRASES = {
    "STANDARD": ("Mestrado Profissional", "mestrado_profissional"), "MEDIUM": ("Mestrado", "mestrado_academico"),
    "LARGE": ("Doutorado", "doutorado"), "SMALL": ("MBA", "mba"), "ECONOMY": ("ESPECIALIZAÇÃO", "especializacao"),
    "PROMO": ("Doutorado e Mestrado", "mestrado_academico"),
}
MODE_PHRASES = (("polo UAB", "uab"), ("ensino híbrido", "semipresencial"), ("a distância", "ead"),
                ("aulas no modo presencial", "presencial"), ("campus central", "desconhecida"))
MONTH_NAMES = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro",
               "novembro", "dezembro")


def pick(key: Column, values) -> Column:
    column = F.lit(None).cast("string")
    for k, v in values:
        column = F.when(key == k, v).otherwise(column)
    return column


def sql_pick(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values) + " END"


def part_notices(parts: DataFrame) -> DataFrame:
    """Parts as notices: the type names a level, the size a mode and the seats, the price the tuition."""
    level = pick(F.col("p_type"), [(k, v[0]) for k, v in LEVEL_PHRASES.items()])
    mode = pick(F.col("p_size") % 5, [(i, v[0]) for i, v in enumerate(MODE_PHRASES)])
    fee = F.when(F.col("p_retailprice") > 1000, "Curso gratuito.").otherwise("Taxa de mensalidade.")
    return parts.withColumns({
        "titulo": F.concat(F.lit("Edital de "), level, F.lit(" em "), "p_name"),
        "texto": F.concat(F.lit("Oferta: "), mode, F.lit(". São "), F.col("p_size").cast("string"), F.lit(" vagas. "), fee),
    })


SQL_LEVEL = sql_pick("p_type", [(k, v[1]) for k, v in LEVEL_PHRASES.items()])
SQL_MODE = sql_pick("p_size % 5", [(i, v[1]) for i, v in enumerate(MODE_PHRASES)])


def order_texts(orders: DataFrame) -> DataFrame:
    """Orders as notices: the priority decides how the application window is worded."""
    day = F.to_date("o_orderdate")
    numeric = lambda d: F.date_format(d, "dd/MM/yyyy")
    worded = lambda d: F.concat_ws(" de ", F.day(d).cast("string"), F.element_at(F.array(*map(F.lit, MONTH_NAMES)), F.month(d)), F.year(d).cast("string"))
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Inscricoes: de "), numeric(day), F.lit(" a "), worded(F.date_add(day, 30))))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("Prazo: ate "), F.date_format(day, "d-M-yyyy")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("Inscricoes "), worded(day)))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Inscricoes 30/02/2020 ou 31 de abril de 2021"))
        .otherwise(F.concat(F.repeat(F.lit("texto "), 150), F.lit("submissao de "), numeric(day), F.lit(" a "), numeric(F.date_sub(day, 1))))
    )
    return orders.withColumn("texto", text)


SQL_FROM = "CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN o_orderdate::date END"
SQL_TO = """CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate::date + 30 WHEN '2-HIGH' THEN o_orderdate::date
            WHEN '5-LOW' THEN o_orderdate::date - 1 END"""

# --- text -------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length({sql_squeeze('text')})::int AS n, md5({sql_squeeze('text')}) AS digest FROM documents")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("t", normalize_text("text"))
    return docs.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query(rf"""SELECT doc_id, md5({sql_fold('text')}) AS digest, len(regexp_extract_all({sql_fold('text')}, '\w+'))::int AS tokens FROM documents""")
def ascii_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("t", to_ascii("text"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.size(tokens("t")).alias("tokens"))


@query(rf"""SELECT source, length(tok)::int AS n_chars, count(*) AS tokens, count(DISTINCT tok) AS words FROM (
              SELECT source, unnest(regexp_extract_all({sql_fold('text')}, '\w+')) AS tok FROM documents) GROUP BY ALL""")
def token_lengths(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("source", F.explode(tokens(to_ascii("text"))).alias("tok"))
    # counted per word first, so neither a frequent word nor a large source gathers in one task
    counted = words.groupBy("source", "tok").count()
    return counted.groupBy("source", F.length("tok").alias("n_chars")).agg(F.sum("count").alias("tokens"), F.count("tok").alias("words"))


STRIPPED = sql_squeeze("regexp_replace(html, '<[^>]+>', ' ', 'g')")


@query(f"SELECT page_id, md5({STRIPPED}) AS digest FROM pages")
def stripped_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(normalize_text(strip_tags("html"))).alias("digest"))


# --- fields -----------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, {SQL_LEVEL} AS nivel, {SQL_MODE} AS modalidade FROM part")
def level_and_mode(spark: SparkSession, d: str) -> DataFrame:
    n = part_notices(table(spark, d, "part"))
    return n.select("p_partkey", f.level_from_text("texto", "titulo").alias("nivel"), f.mode_from_text("texto").alias("modalidade"))


@query("""SELECT p_partkey, p_size AS vagas, CASE WHEN p_retailprice > 1000 THEN true END AS gratuito,
                 CASE WHEN p_retailprice > 1000 THEN true END AS gratuito_documento FROM part""")
def seats_and_tuition(spark: SparkSession, d: str) -> DataFrame:
    n = part_notices(table(spark, d, "part"))
    return n.select("p_partkey", f.seats("texto").alias("vagas"), f.free_hint("texto").alias("gratuito"),
                    f.free_hint("texto", dims.RE_FREE_DOCUMENT).alias("gratuito_documento"))


@query(f"SELECT o_orderkey, CAST({SQL_FROM} AS VARCHAR) AS de, CAST({SQL_TO} AS VARCHAR) AS ate FROM orders")
def application_windows(spark: SparkSession, d: str) -> DataFrame:
    w = order_texts(table(spark, d, "orders")).select("o_orderkey", f.application_window("texto").alias("w"))
    return w.select("o_orderkey", F.col("w.de").cast("string").alias("de"), F.col("w.ate").cast("string").alias("ate"))


@query(f"""SELECT rotulo, valido, aberto, encerrado, count(*) AS n FROM (
  SELECT CASE WHEN de IS NULL AND ate IS NULL THEN '' ELSE coalesce(strftime(de, '%Y-%m-%d'), '?') || '..' || coalesce(strftime(ate, '%Y-%m-%d'), '?') END AS rotulo,
         coalesce(de <= ate, true) AS valido, coalesce(de <= DATE '1998-06-01', true) AND coalesce(ate >= DATE '1998-06-01', true) AS aberto,
         coalesce(ate < DATE '1998-06-01', false) AS encerrado
  FROM (SELECT {SQL_FROM} AS de, {SQL_TO} AS ate FROM orders)) GROUP BY ALL""")
def window_states(spark: SparkSession, d: str) -> DataFrame:
    today = F.lit("1998-06-01").cast("date")
    w = order_texts(table(spark, d, "orders")).select(f.application_window("texto").alias("w"))
    return w.groupBy(
        f.window_label("w").alias("rotulo"), f.window_is_valid("w").alias("valido"), f.window_is_open("w", today).alias("aberto"),
        f.window_is_over("w", today).alias("encerrado")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'EDITAL N' || ' ' || o_orderkey || '/' || year(o_orderdate) || ' turma ' || o_custkey || ' fim. Segunda frase bem longa aqui.'
                                  WHEN o_orderstatus = 'O' THEN 'Esta frase passa dos vinte caracteres ' || o_custkey ELSE '(sem titulo)' END AS titulo FROM orders""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Oi. EDITAL N "), key, F.lit("/"), F.year("o_orderdate").cast("string"), F.lit(" turma "), customer,
                                                       F.lit(" fim. Segunda frase bem longa aqui.")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("Curta. Esta frase passa dos vinte caracteres "), customer, F.lit(". Fim")))
        .otherwise("Curta. Outra"))
    return table(spark, d, "orders").select("o_orderkey", f.document_title(text).alias("titulo"))


@query(f"""SELECT p_partkey, {SQL_LEVEL} AS do_texto, CASE p_type WHEN 'SMALL' THEN 'mba' ELSE 'desconhecido' END AS do_codigo,
                  'ufrgs:' || p_brand AS externo, CASE WHEN p_size % 5 = 4 THEN NULL ELSE {SQL_MODE} END AS modo,
                  {sql_pick('p_type', [('STANDARD', 'Mestrado Profissional'), ('MEDIUM', 'Mestrado Academico'), ('LARGE', 'Doutorado'), ('SMALL', 'Mba'), ('ECONOMY', 'Especializacao'), ('PROMO', 'Mestrado Academico')])} AS rotulo
           FROM part""")
def enum_fields(spark: SparkSession, d: str) -> DataFrame:
    n = part_notices(table(spark, d, "part")).withColumn("nivel", f.parse_level("titulo"))
    mode = F.when(F.col("p_size") % 5 != 4, f.mode_from_text("texto"))
    return n.select(
        "p_partkey", F.col("nivel").alias("do_texto"),
        f.parse_level(F.when(F.col("p_type") == "SMALL", "mba").otherwise("nada")).alias("do_codigo"),
        f.external_id("p_brand", F.lit("ufrgs")).alias("externo"), f.parse_mode(mode).alias("modo"), f.level_label("nivel").alias("rotulo"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'O' THEN o_orderdate::date::varchar || '..?'
                 ELSE o_orderdate::date::varchar || '..' || (o_orderdate::date + 10)::varchar END AS periodo FROM orders""")
def json_windows(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    doc = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(day.cast("string").alias("de"), F.lit("13/13").alias("ate")))).otherwise(
        F.to_json(F.struct(day.cast("string").alias("de"), F.when(F.col("o_orderstatus") == "P", F.date_add(day, 10).cast("string")).alias("ate"))))
    w = table(spark, d, "orders").select("o_orderkey", f.parse_window_json(doc).alias("w"))
    return w.select("o_orderkey", F.nullif(f.window_label("w"), F.lit("")).alias("periodo"))


# --- hashes and near duplicates ---------------------------------------------------------------------------

SIMHASHES = sql_simhash("SELECT doc_id AS id, text FROM documents")


def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.simhash64(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT id AS doc_id, simhash FROM ({SIMHASHES})")
def simhash64(spark: SparkSession, d: str) -> DataFrame:
    return document_hashes(spark, d)


@query(f"SELECT id AS doc_id, simhash FROM ({SIMHASHES})")
def simhash_in_row(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", dedup.simhash_of("text").alias("simhash"))


@query(f"""WITH v AS (SELECT DISTINCT simhash FROM ({SIMHASHES}) WHERE simhash <> 0)
  SELECT a.simhash AS simhash_a, b.simhash AS simhash_b, bit_count(xor(a.simhash, b.simhash))::int AS distance
  FROM v a JOIN v b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates(document_hashes(spark, d))


@query(f"""WITH h AS ({SIMHASHES}), v AS (SELECT DISTINCT simhash FROM h WHERE simhash <> 0),
  p AS (SELECT DISTINCT simhash FROM h JOIN labels l ON l.doc_id = h.id WHERE simhash <> 0)
  SELECT p.simhash AS probe, v.simhash AS stored, bit_count(xor(p.simhash, v.simhash))::int AS distance
  FROM p JOIN v ON bit_count(xor(p.simhash, v.simhash)) <= 3""")
def find_near_simhash(spark: SparkSession, d: str) -> DataFrame:
    hashes = document_hashes(spark, d)
    probes = hashes.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return dedup.find_near(probes, hashes)


@query(f"""WITH RECURSIVE h AS MATERIALIZED ({SIMHASHES}), v AS MATERIALIZED (SELECT simhash, min(id) AS first FROM h WHERE simhash <> 0 GROUP BY simhash),
  e AS MATERIALIZED (SELECT a.simhash AS u, b.simhash AS w FROM v a JOIN v b ON bit_count(xor(a.simhash, b.simhash)) <= 3),
  reach AS (SELECT u, w FROM e UNION SELECT r.u, e.w FROM reach r JOIN e ON e.u = r.w),
  names AS (SELECT r.u AS simhash, min(v.first) AS family FROM reach r JOIN v ON v.simhash = r.w GROUP BY r.u)
  SELECT h.id AS doc_id, coalesce(n.family, h.id) AS family FROM h LEFT JOIN names n ON n.simhash = h.simhash""")
def near_duplicate_families(spark: SparkSession, d: str) -> DataFrame:
    return dedup.families(dedup.cut_lineage(document_hashes(spark, d)), "doc_id")


SQL_CANONICAL = f"sha256({sql_fold('text')} || '|' || {sql_fold('source')} || '|' || lang || '|desconhecida||' || source)"


def document_canonical() -> Column:
    return dedup.canonical_hash("text", "source", "lang", F.lit("desconhecida"), F.lit(None).cast("struct<de:date,ate:date>"), "source")


@query(f"SELECT doc_id, {SQL_CANONICAL} AS canonical_hash FROM documents")
def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", document_canonical().alias("canonical_hash"))


@query(f"SELECT {SQL_CANONICAL} AS canonical_hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").select("doc_id", document_canonical().alias("canonical_hash"))
    counted = hashed.groupBy("canonical_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    return counted.where("copies > 1")


CAPTURES = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@query(f"""WITH h AS ({sql_simhash(CAPTURES)}), p AS (SELECT id // 1000 AS conv_id, id % 1000 AS turn, simhash, lag(simhash) OVER (PARTITION BY id // 1000 ORDER BY id) AS prior FROM h)
  SELECT conv_id, turn, simhash, prior, CASE WHEN prior IS NULL THEN 'insert' WHEN bit_count(xor(prior, simhash)) <= 3 THEN 'cosmetic' ELSE 'update' END AS change FROM p""")
def capture_changes(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", dedup.simhash_of("text").alias("simhash"))
    return dedup.capture_changes(turns, "conv_id", ["turn"], F.floor(F.col("turn") / 4))


@query(f"""WITH h AS ({sql_simhash(CAPTURES)}), s AS (SELECT id AS doc_id, simhash AS stored FROM ({SIMHASHES})),
  p AS (SELECT id // 1000 AS conv_id, id % 1000 AS turn, simhash, lag(simhash) OVER (PARTITION BY id // 1000 ORDER BY id) AS prior FROM h),
  q AS (SELECT conv_id, turn, simhash, coalesce(prior, stored) AS prior FROM p LEFT JOIN s ON s.doc_id = p.conv_id)
  SELECT CASE WHEN prior IS NULL THEN 'insert' WHEN bit_count(xor(prior, simhash)) <= 3 THEN 'cosmetic' ELSE 'update' END AS change, count(*) AS n FROM q GROUP BY 1""")
def stored_changes(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "conversations").select(
        F.col("conv_id").alias("canonical_hash"), F.col("turn").alias("notice_key"),
        F.timestamp_seconds(F.col("turn") * 3600).alias("fetched_at"), dedup.simhash_of("text").alias("simhash"))
    stored = document_hashes(spark, d).withColumnRenamed("doc_id", "canonical_hash")
    return dedup.classify_change(incoming, stored).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# --- classification ---------------------------------------------------------------------------------------

WORD_AREAS = {
    "10300007": ("the", "and", "tion", "ing"), "10700001": ("der", "und", "sch", "ung"), "10100002": ("que", "eau", "oi", "ment"),
    "10200006": ("cion", "ado", "mente", "que"), "30400000": ("password", "license"),
}
_HITS = ", ".join(
    f"list_filter({list(words)!r}, lambda k: contains(t, k)) AS h{i}" for i, words in enumerate(WORD_AREAS.values()))
_BEST = "greatest(" + ", ".join(f"len(h{i})" for i in range(len(WORD_AREAS))) + ")"
_AREA = "CASE " + " ".join(f"WHEN len(h{i}) = best THEN {code!r}" for i, code in enumerate(WORD_AREAS)) + " END"
_EVID = "CASE " + " ".join(f"WHEN len(h{i}) = best THEN array_to_string(h{i}, ',')" for i in range(len(WORD_AREAS))) + " END"


@query(f"""WITH n AS (SELECT doc_id, {sql_fold("source || ' ' || text || ' ' || lang || ' ' || substr(text, 1, 3000)")} AS t FROM documents),
  h AS (SELECT doc_id, {_HITS} FROM n), b AS (SELECT *, {_BEST} AS best FROM h)
  SELECT doc_id, CASE WHEN best > 0 THEN {_AREA} END AS area, CASE WHEN best > 0 THEN round(least(0.95, 0.3 + 0.15 * best), 4)::double ELSE 0::double END AS confidence,
         CASE WHEN best > 0 THEN {_EVID} ELSE '' END AS evidence FROM b""")
def classify_area(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("titulo"), F.col("text").alias("texto_resumo"), F.col("lang").alias("area_concentracao"),
        F.col("text").alias("texto_completo"), F.lit(None).cast("string").alias("area_cnpq_codigo"))
    c = classify.classify_area(docs, WORD_AREAS)
    return c.select("doc_id", F.col("classification.area").alias("area"), F.round("classification.confidence", 4).alias("confidence"),
                    F.array_join("classification.evidence", ",").alias("evidence"))


SQL_KEYWORDS = "SELECT DISTINCT keyword, length(keyword)::int % 7 AS rank FROM (SELECT unnest(regexp_extract_all(text, '[a-zà-ÿ]+')) AS keyword FROM conversations) WHERE length(keyword) >= 7"


@query(f"""WITH h AS (SELECT doc_id, rank, count(*) AS n, string_agg(keyword, ' ' ORDER BY keyword) AS evidence FROM documents JOIN ({SQL_KEYWORDS}) ON contains(text, keyword) GROUP BY ALL),
  b AS (SELECT doc_id, arg_max(struct_pack(rank, n, evidence), (n, -rank)) AS b FROM h GROUP BY 1)
  SELECT doc_id, 'A' || b.rank AS area, CASE WHEN b IS NULL THEN 0 ELSE least(0.95, round(0.3 + 0.15 * b.n, 2)) END::double AS confidence, md5(coalesce(b.evidence, '')) AS evidence
  FROM documents LEFT JOIN b USING (doc_id)""")
def classify_by_keyword_table(spark: SparkSession, d: str) -> DataFrame:
    """Documents by thousands of keywords: the long words of conversations, seven areas by their length."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zà-ÿ]+)"))).alias("keyword")).where(F.length("keyword") >= 7).distinct()
    rank = F.length("keyword") % 7
    keywords = words.select(F.concat(F.lit("A"), rank.cast("string")).alias("area"), rank.alias("rank"), "keyword")
    got = classify.classify_by_table(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), keywords)
    return got.select(F.col("id").alias("doc_id"), "area", F.round("confidence", 2).alias("confidence"), F.md5(F.array_join("evidence", " ")).alias("evidence"))
