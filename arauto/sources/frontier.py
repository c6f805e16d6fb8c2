"""URLs to fetch next, per kind of source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arauto import dims


def active(sources: DataFrame) -> DataFrame:
    return sources.where("ativa")


def _query(base: str, **params: Column | str) -> Column:
    pairs = [
        F.concat(F.lit(f"{k}="), F.url_encode(v if isinstance(v, Column) else F.lit(v))) for k, v in params.items()
    ]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))


def listing_frontier(sources: DataFrame) -> DataFrame:
    """Feed address, else listing address; sources with neither drop out. Rows keep the dispatch order column."""
    url = F.coalesce(F.nullif("feed_url", F.lit("")), F.nullif("listing_url", F.lit("")))
    return sources.select(F.col("codigo").alias("source"), url.alias("url"), "priority").where("url is not null")


def search_frontier(days: DataFrame, day: str, terms: tuple[str, ...] = dims.GAZETTE_TERMS, span: int = 7) -> DataFrame:
    """One search address per day and term, over the ``span`` days up to that day."""
    expanded = days.select(day, F.explode(F.array(*map(F.lit, terms))).alias("termo"))
    url = _query(
        dims.GAZETTE_SEARCH, q=F.col("termo"), delta="ate",
        publicadoDe=F.date_format(F.date_sub(day, span), "dd-MM-yyyy"),
        publicadoAte=F.date_format(day, "dd-MM-yyyy"), currentPage="1", rowsPerPage="50",
    )
    return expanded.select(day, "termo", F.lit(dims.GAZETTE).alias("source"), url.alias("url"))


def catalogue_frontier(areas: DataFrame, code: str = "codigo") -> DataFrame:
    return areas.select(
        F.lit(dims.CATALOGUE).alias("source"), F.col(code),
        _query(dims.CATALOGUE_SEARCH, areaConhecimentoCodigo=F.col(code)).alias("url"),
    )


def all_sources(*notices: DataFrame) -> DataFrame:
    """The notices of every source in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), notices)
