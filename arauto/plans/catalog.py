"""Registry of the queries over the driver tables, each next to the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL when SQL can state it."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; zoneless timestamps become timestamps (session zone UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def dealt(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """A narrow table dealt to at least all cores, about ``most`` rows a task at most: its file is one or two splits, whatever is then made of each row."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // most)))


# --- SQL fragments ----------------------------------------------------------------------------------------


def sql_fold(c: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents(replace({c}, 'ß', 'ss'))), '\s+', ' ', 'g'))"


def sql_squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def sql_simhash(source: str) -> str:
    """SQL giving (id, simhash) for a source of (id, text)."""
    return rf"""
    SELECT s.id, coalesce(v.simhash, 0)::bigint AS simhash FROM ({source}) s LEFT JOIN (
      SELECT id, (CASE WHEN u >= 9223372036854775808::hugeint THEN u - 18446744073709551616::hugeint ELSE u END)::bigint AS simhash
      FROM (SELECT id, sum(CASE WHEN on_bit THEN 1::hugeint << b ELSE 0 END) AS u
            FROM (SELECT id, b, 2 * sum(((h >> b) & 1)::int) > count(*) AS on_bit
                  FROM (SELECT id, ('0x' || substr(md5(tok), 17, 16))::ubigint AS h
                        FROM (SELECT id, unnest(regexp_extract_all({sql_fold('text')}, '\w+')) AS tok FROM ({source})))
                  CROSS JOIN (SELECT unnest(range(64))::int AS b)
                  GROUP BY id, b)
            GROUP BY id)) v ON v.id = s.id"""


SQL_DECODE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
