"""Sources as table functions: a page in, any number of rows out, in SQL as well as in the ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arauto.functions import fields as f
from arauto.operators.extract import parsed_row

#: What a source's function says of a notice; all else follows from the text.
FIELDS = ("titulo", "url_origem", "ies_nome", "texto")
ROWS = "position int, " + ", ".join(f"{c} string" for c in FIELDS) + ", error string"

Parse = Callable[[str, bytes, str], Iterable[dict[str, str]]]


@dataclass(frozen=True)
class SourceFunction:
    """A registered table function and the extraction job made of it."""

    name: str
    function: object

    def _rows(self, raw: DataFrame) -> DataFrame:
        pages = raw.select("url", "fetched_at", "source", "body", "content_type")
        return pages.lateralJoin(self.function(*[F.col(c).outer() for c in ("url", "body", "content_type")]))

    def extract(self, raw: DataFrame) -> DataFrame:
        """Parsed notices of the pages; an entry of the ingest's extractors."""
        rows = self._rows(raw).where("error IS NULL").withColumn("texto", F.coalesce("texto", F.lit("")))
        rows = rows.withColumn("periodo", f.application_window("texto"))
        return rows.select(*parsed_row(
            titulo=F.col("titulo"), ies_nome=F.coalesce("ies_nome", F.lit("")), fonte_codigo=F.col("source"), nivel=f.level_from_text("texto", "titulo"),
            modalidade=f.mode_from_text("texto"), periodo_inscricao=F.col("periodo"), url_origem=F.coalesce("url_origem", F.lit("")),
            texto_resumo=F.substring("texto", 1, 1000), texto_completo=F.col("texto"), confidence=F.lit(0.5), parser_name=F.lit(self.name)))

    def failures(self, raw: DataFrame) -> DataFrame:
        """(url, error) of pages on which the function failed; they give no other row."""
        return self._rows(raw).where("error IS NOT NULL").select("url", "error")


def register_source(spark: SparkSession, name: str, parse: Parse) -> SourceFunction:
    """Makes ``parse(url, body, content_type)``, which yields a dict of FIELDS a notice, the table function ``name``:

    ``SELECT p.url, t.* FROM pages p, LATERAL name(p.url, p.body, p.content_type) t``
    """
    def rows(url: str, body: bytes, content_type: str) -> list[tuple]:
        try:
            found = list(parse(url, body, content_type))
        except Exception as e:  # noqa: BLE001  (whatever a source's own code raises is the page's failure, not the job's)
            return [(None, *[None] * len(FIELDS), f"{type(e).__name__}: {e}")]
        return [(n, *[row.get(c) for c in FIELDS], None) for n, row in enumerate(found)]

    class Pages:
        def eval(self, url: str, body: bytes, content_type: str):
            yield from rows(url, body, content_type)

    function = F.udtf(Pages, returnType=ROWS)
    spark.udtf.register(name, function)
    return SourceFunction(name, function)
