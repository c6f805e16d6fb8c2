"""Paged listing and lookup of stored notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC = (
    "id", "titulo", "nivel", "modalidade", "area_cnpq_codigo", "is_gratuito", "vagas", "inscricao_de", "inscricao_ate",
    "url_origem", "url_pdf", "texto_resumo", "status", "canonical_hash", "created_at", "updated_at",
)
UUID = r"^(?i)(urn:uuid:)?\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$"
RECORD_ID = r"^[0-9a-f]{64}$"


def public_view(notices: DataFrame) -> DataFrame:
    """The 16 published columns; the timestamps under their public names."""
    return notices.select(*PUBLIC).withColumnsRenamed({"created_at": "criado_em", "updated_at": "atualizado_em"})


def filter_notices(notices: DataFrame, *, today: Column, level: str | None = None, mode: str | None = None,
                   area: str | None = None, open_only: bool = True, deadline: str = "inscricao_ate") -> DataFrame:
    """Equality filters and 'no deadline or not past it'. All of them reach the Parquet scan."""
    for column, value in (("nivel", level), ("modalidade", mode), ("area_cnpq_codigo", area)):
        if value:
            notices = notices.where(F.col(column) == value)
    if open_only:
        notices = notices.where(F.col(deadline).isNull() | (F.col(deadline) >= today))
    return notices


def page(notices: DataFrame, limit: int = 50, offset: int = 0, deadline: str = "inscricao_ate") -> DataFrame:
    """One page by deadline, open-ended notices last, id as tie-break. Spark keeps only limit + offset rows per task."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    return notices.orderBy(F.col(deadline).asc_nulls_last(), "id").offset(offset).limit(limit)


def total(notices: DataFrame) -> DataFrame:
    return notices.agg(F.count(F.lit(1)).alias("total"))


def list_notices(notices: DataFrame, *, today: Column, level: str | None = None, mode: str | None = None, area: str | None = None,
                 open_only: bool = True, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the filtered notices."""
    chosen = filter_notices(notices, today=today, level=level, mode=mode, area=area, open_only=open_only)
    return public_view(page(chosen, limit, offset)), total(chosen)


def list_active(notices: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(notices, limit, offset)


def valid_id(value: Column) -> Column:
    """A UUID in any accepted spelling, or one of the content-derived ids this engine gives its rows."""
    return value.rlike(UUID) | value.rlike(RECORD_ID)


def get_notice(notices: DataFrame, id: str) -> DataFrame:
    """The notice with this id; a malformed id is an error, an unknown one gives no row."""
    import re

    if not (re.match(UUID.replace("(?i)", ""), id, re.IGNORECASE) or re.match(RECORD_ID, id)):
        raise ValueError("invalid id")
    return notices.where(F.col("id") == id)


def lookup(notices: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Notices for a table of requested ids."""
    return notices.join(ids.where(valid_id(F.col(id))).select(id).distinct(), id, "left_semi")
