"""Explicit schemas of every table the jobs read or write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD = "struct<de:date,ate:date>"

RAW_RESPONSES = (
    "url string, final_url string, status int, headers map<string,string>, body binary, "
    "fetched_at timestamp, via string, source string"
)

PARSED_NOTICES = (
    "titulo string, ies_nome string, fonte_codigo string, nivel string, modalidade string, "
    "area_concentracao string, area_cnpq_codigo string, is_gratuito boolean, vagas int, "
    f"periodo_inscricao {PERIOD}, identificador_externo struct<valor:string,fonte:string>, "
    "url_origem string, url_pdf string, texto_resumo string, texto_completo string, "
    "confidence double, parser_name string, extras map<string,string>"
)

NOTICES = (
    "id string, titulo string, ies_id string, fonte_id string, nivel string, modalidade string, "
    "area_cnpq_codigo string, is_gratuito boolean, vagas int, inscricao_de date, inscricao_ate date, "
    "identificador_externo_valor string, identificador_externo_fonte string, url_origem string, "
    "url_pdf string, texto_resumo string, canonical_hash string, simhash bigint, status string, "
    "created_at timestamp, updated_at timestamp"
)

INSTITUTIONS = (
    "id string, codigo_emec string, sigla string, nome string, categoria_administrativa string, "
    "organizacao_academica string, uf string, municipio string, ativa boolean, gratuita boolean"
)

REGISTRY_JSON = (
    "ies array<struct<codigo_emec:string,sigla:string,nome:string,categoria_administrativa:string,"
    "organizacao_academica:string,uf:string,municipio:string,ativa:boolean,publica:boolean>>"
)

SOURCES = (
    "codigo string, nome string, tipo string, base_url string, ativa boolean, intervalo_minutos int, "
    "ies_nome string, feed_url string, listing_url string, kind string, priority int"
)

TARGET_AREAS = "array<struct<codigo_cnpq:string,modo:string,peso:double,requer_aceita_cs:boolean>>"

SUBSCRIBERS = (
    f"id string, nome string, email string, formacao string, areas_alvo {TARGET_AREAS}, "
    "niveis_aceitos array<string>, modalidades_aceitas array<string>, apenas_gratuitos boolean, "
    "apenas_ies_emec_publicas boolean, score_minimo double, digest_cron string, ativo boolean"
)

PROFILE_JSON = (
    f"areas_alvo {TARGET_AREAS}, niveis_aceitos array<string>, modalidades_aceitas array<string>, "
    "apenas_gratuitos boolean, apenas_ies_emec_publicas boolean"
)

MATCHES = (
    "id string, subscriber_id string, edital_id string, score double, notified boolean, "
    "notified_at timestamp, explanation_json string, created_at timestamp"
)

SNAPSHOTS = (
    "id string, url string, http_status int, content_type string, sha256 string, bytes_size bigint, "
    "storage_path string, headers map<string,string>, body binary, source string, date string, "
    "final_url string, fetched_at timestamp"
)

DEAD_LETTERS = "stage string, reason string, payload string, ts timestamp"

SOURCE_CONTRACTS = "source string, min_bytes bigint, max_bytes bigint, must_contain array<string>"

ENRICHMENT = (
    "notice_key string, titulo string, nivel string, modalidade string, ies_nome string, "
    "area_concentracao string, vagas int, is_gratuito boolean, periodo_inscricao string, "
    "link_pdf string, confidence double"
)

FEED_XML = (
    "channel struct<item:array<struct<title:string,link:string,description:string,`content:encoded`:string>>>, "
    "item array<struct<title:string,link:string,description:string,`content:encoded`:string>>"
)

SITEMAP_XML = "url array<struct<loc:string>>"

_HIT = (
    "struct<title:string,titulo:string,urlTitulo:string,url:string,orgao:string,ementa:string,"
    "conteudo:string,secao:string,pubDate:string>"
)
SEARCH_JSON = f"items array<{_HIT}>, hits array<{_HIT}>"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def fields(ddl: str, **values: Column) -> list[Column]:
    """One column per field of ``ddl``, taken from ``values`` and null where absent, cast to the field's type."""
    return [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl).fields
    ]
