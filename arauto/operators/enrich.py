"""Merging externally produced fields into low-confidence notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arauto import dims
from arauto.functions import fields as f


def low_confidence(parsed: DataFrame, threshold: float = dims.CONFIDENCE_THRESHOLD) -> DataFrame:
    return parsed.where(F.col("confidence") < threshold)


def merge_enrichment(parsed: DataFrame, enrichment: DataFrame, threshold: float = dims.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Parsed notices with the enriched value of each field where there is one, the parsed value elsewhere.

    Only notices under the threshold take part. Empty strings count as missing; false and 0 do not. Confidence
    becomes the larger of both (0.7 when the enrichment states none).
    """
    e = enrichment.select("notice_key", F.struct(*[c for c in enrichment.columns if c != "notice_key"]).alias("e"))
    joined = parsed.join(e, "notice_key", "left")
    use = F.col("e").isNotNull() & (F.col("confidence") < threshold)
    merged = {
        **{c: f.truthy_or(f"e.{c}", c) for c in ("titulo", "ies_nome", "area_concentracao")},
        "nivel": F.coalesce(f.parse_level("e.nivel"), "nivel"),
        "modalidade": F.coalesce(f.parse_mode("e.modalidade"), "modalidade"),
        "is_gratuito": F.coalesce("e.is_gratuito", "is_gratuito"),
        "vagas": F.coalesce("e.vagas", "vagas"),
        "periodo_inscricao": F.coalesce(f.parse_window_json("e.periodo_inscricao"), "periodo_inscricao"),
        "url_pdf": f.truthy_or("e.link_pdf", "url_pdf"),
        "confidence": F.greatest("confidence", F.coalesce("e.confidence", F.lit(0.7))),
        "parser_name": F.concat("parser_name", F.lit("+llm")),
        "extras": F.map_concat(
            F.map_filter("extras", lambda k, v: k != "llm_enriched"), F.create_map(F.lit("llm_enriched"), F.lit("true"))),
    }
    return joined.withColumns({c: F.when(use, v).otherwise(F.col(c)) for c, v in merged.items()}).withColumn("enriched", use).drop("e")
