"""Notices against subscriber profiles: hard filters, weighted areas, explanations.

A match needs a target area equal to the notice's area (unless the profile's minimum is 0 or less), so matching is
an equi-join on (area, level, mode). Those keys are few; the ones that hold much of the notices are split by their measured
share, and only their offers are copied. Rejected pairs are never enumerated;
``explain_pairs`` evaluates the pairs it is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arauto import dims, schemas
from arauto.functions.fields import two_decimals
from arauto.functions.text import ColumnLike, _col
from arauto.operators.gate import registry_gate
from arauto.operators.lookup import heavy_keys
from arauto.session import cut_lineage

#: Notices for every list of ids that a kind of them is cut into.
LISTED = 20_000


def contribution(area: Column, alvo: Column, admitting: tuple[str, ...] = dims.AREAS_ADMITTING_COMPUTING) -> Column:
    """Weight a target area adds for a notice of ``area``; 0 when it does not apply."""
    applies = (area == alvo["codigo_cnpq"]) & (
        (alvo["modo"] == "exact") | ~F.coalesce(alvo["requer_aceita_cs"], F.lit(False)) | area.isin(*admitting))
    return F.when(F.coalesce(applies, F.lit(False)), alvo["peso"]).otherwise(0.0)


def soft_score(area: Column, targets: Column, admitting: tuple[str, ...] = dims.AREAS_ADMITTING_COMPUTING) -> Column:
    """struct(score, contributing) of a notice's area against a profile's target areas, in profile order."""
    live = F.filter(targets, lambda a: contribution(area, a, admitting) > 0)
    labels = F.transform(live, lambda a: F.concat(a["codigo_cnpq"], F.lit(":"), a["modo"], F.lit(":+"), two_decimals(a["peso"])))
    return F.struct(
        F.aggregate(live, F.lit(0.0), lambda acc, a: acc + a["peso"]).alias("score"), labels.alias("contributing"))


def score_bucket(score: ColumnLike) -> Column:
    return F.when(_col(score) >= dims.HIGH_SCORE, "high").otherwise("mid")


def _soft_reason(score: Column, minimum: Column) -> Column:
    return F.concat(
        F.lit("soft:score="), two_decimals(score), F.when(score >= minimum, ">=min=").otherwise("<min="), minimum.cast("string"))


def _result(df: DataFrame, hard: Column | None) -> DataFrame:
    """Turns ``soft`` (and the first failed hard filter, if any) into the match result columns."""
    hard = F.lit(None).cast("string") if hard is None else hard
    passed, none = hard.isNull(), F.array().cast("array<string>")
    df = df.withColumns({
        "matched": passed & (F.col("soft.score") >= F.col("score_minimo")),
        "score": F.when(passed, F.round("soft.score", 3)).otherwise(0.0),
        "reasons": F.array(F.coalesce(hard, _soft_reason(F.col("soft.score"), F.col("score_minimo")))),
        "contributing_areas": F.when(passed, F.col("soft.contributing")).otherwise(none),
    })
    explanation = F.to_json(F.struct("matched", "score", "reasons", "contributing_areas"))
    return df.withColumn("explanation_json", explanation)


def _notice_side(notices: DataFrame, institutions: DataFrame) -> DataFrame:
    gated = registry_gate(notices, institutions)
    return gated.select(
        F.col("id").alias("edital_id"), "nivel", "modalidade", F.col("area_cnpq_codigo").alias("area"),
        "is_gratuito", "in_registry", "ies_nome")


def _parts(notices: DataFrame, salts: int | None, *key: str) -> Callable[..., Column]:
    """In how many parts a key is split: ``salts``, or what its measured share of the notices asks."""
    if salts is not None:
        return lambda *of: F.lit(salts)
    name = lambda *of: F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in of])
    heavy = heavy_keys(notices.select(name(*key).alias("k")), "k")
    if not heavy:
        return lambda *of: F.lit(1)
    sizes = F.create_map(*[F.lit(x) for k, n in heavy.items() for x in (k, n)])
    return lambda *of: F.coalesce(F.try_element_at(sizes, name(*of)), F.lit(1))


def match_notices(notices: DataFrame, subscribers: DataFrame, institutions: DataFrame, salts: int | None = None,
                  admitting: tuple[str, ...] = dims.AREAS_ADMITTING_COMPUTING, counted: bool = False) -> DataFrame:
    """All matching (subscriber, notice) pairs of active subscribers with score and explanation.

    ``notices`` needs id, ies_nome, nivel, modalidade, area_cnpq_codigo and is_gratuito. What a match says follows from the
    profile and the area, so it is worked out once per offer, before the join. Notices of a kind, alike in all that matching looks
    at, meet an offer as lists of their ids, and become rows last, in as many tasks as there are shuffle partitions, or four for
    every core: the pairs are many where the tables are small. ``counted`` gives, in place of ``edital_id``, one row per subscriber
    and kind, with ``notices``, how many they are.
    """
    kind, by_area, by_level = ["nivel", "modalidade", "area", "is_gratuito", "in_registry"], ["area", "nivel", "modalidade"], ["nivel", "modalidade"]
    notices = cut_lineage(notices.select("id", "ies_nome", *by_level, "area_cnpq_codigo", "is_gratuito"))
    n = _notice_side(notices, institutions)
    salts = 1 if counted else salts
    parts, wide = _parts(notices, salts, "area_cnpq_codigo", *by_level), _parts(notices, salts, *by_level)
    spark = notices.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    if counted:
        n = n.groupBy(*kind).agg(F.count(F.lit(1)).alias("notices"))
        slot, dealt = lambda of: F.lit(0), lambda rows, *key: rows
    else:
        lists = F.greatest(F.lit(max(1, -(-notices.count() // LISTED))), parts(*by_area), wide(*by_level))
        n = n.groupBy(*kind, F.pmod(F.xxhash64("edital_id"), lists).alias("list")).agg(F.collect_list(F.struct("edital_id")).alias("editais"))
        slot, dealt = lambda of: F.pmod("list", of).cast("int"), lambda rows, *key: rows.repartition(tasks, *key)
    copies = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    active = subscribers.where("ativo").select(
        F.col("id").alias("subscriber_id"), F.col("nome").alias("subscriber"), "areas_alvo", "apenas_gratuitos",
        "apenas_ies_emec_publicas", "score_minimo",
        F.array_distinct("niveis_aceitos").alias("niveis"), F.array_distinct("modalidades_aceitas").alias("modos"),
    ).repartition(tasks)
    # one row per level, mode and salt; each target area's score is settled before the join
    offers = active.withColumn("nivel", F.explode("niveis")).withColumn("modalidade", F.explode("modos")).drop("niveis", "modos")
    codes = F.array_distinct(F.transform("areas_alvo", lambda a: a["codigo_cnpq"]))
    wanted = offers.withColumn("area", F.explode(codes)).withColumn("soft", soft_score(F.col("area"), F.col("areas_alvo"), admitting))
    wanted = _result(wanted.where(F.col("soft.score") >= F.col("score_minimo")), None).drop("areas_alvo", "soft").withColumn("salt", copies(parts(*by_area)))
    open_to = (F.col("is_gratuito") | ~F.col("apenas_gratuitos")) & (F.col("in_registry") | ~F.col("apenas_ies_emec_publicas"))
    hits = dealt(n.withColumn("salt", slot(parts(*by_area))), *by_area, "salt").join(dealt(wanted, *by_area, "salt"), [*by_area, "salt"]).where(open_to)
    # profiles with a minimum of 0 or less also match notices outside their areas
    nothing = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("contributing"))
    any_area = _result(offers.where("score_minimo <= 0").withColumn("soft", nothing), None).withColumn("codes", codes)
    any_area = any_area.drop("areas_alvo", "soft").withColumn("salt", copies(wide(*by_level)))
    outside = F.col("area").isNull() | ~F.array_contains("codes", F.col("area"))
    rest = dealt(n.withColumn("salt", slot(wide(*by_level))), *by_level, "salt").join(dealt(any_area, *by_level, "salt"), [*by_level, "salt"]).where(open_to & outside)
    said = ["score", "bucket", "reasons", "contributing_areas", "explanation_json"]
    found = hits.unionByName(rest, allowMissingColumns=True).withColumn("bucket", score_bucket("score"))
    if counted:
        return found.select("subscriber_id", "subscriber", "notices", *said)
    return found.select("subscriber_id", "subscriber", F.explode("editais").alias("edital"), *said).select("subscriber_id", "subscriber", "edital.edital_id", *said)


def explain_pairs(pairs: DataFrame, notices: DataFrame, subscribers: DataFrame, institutions: DataFrame,
                  admitting: tuple[str, ...] = dims.AREAS_ADMITTING_COMPUTING) -> DataFrame:
    """The match result of given (subscriber_id, edital_id) pairs, with the first hard filter that fails.

    Filters are tried in the order free, registry, level, mode; only then is the area score computed.
    """
    n = _notice_side(notices, institutions)
    s = subscribers.select(F.col("id").alias("subscriber_id"), *[c for c in subscribers.columns if c not in ("id", "nome")])
    df = pairs.join(n, "edital_id").join(s, "subscriber_id")
    df = df.withColumn("soft", soft_score(F.col("area"), F.col("areas_alvo"), admitting))
    hard = (
        F.when(F.col("apenas_gratuitos") & ~F.col("is_gratuito"), "hard:nao_gratuito")
        .when(F.col("apenas_ies_emec_publicas") & ~F.col("in_registry"),
              F.concat(F.lit("hard:ies_fora_whitelist:"), F.substring("ies_nome", 1, 60)))
        .when(~F.array_contains("niveis_aceitos", F.col("nivel")), F.concat(F.lit("hard:nivel_nao_aceito:"), "nivel"))
        .when(~F.array_contains("modalidades_aceitas", F.col("modalidade")),
              F.concat(F.lit("hard:modalidade_nao_aceita:"), "modalidade"))
    )
    return _result(df, hard).select(
        "subscriber_id", "edital_id", "matched", "score", "reasons", "contributing_areas", "explanation_json")


def match_records(matches: DataFrame, now: Column) -> DataFrame:
    """Matches in the shape of the stored table. The id follows from the pair, so reruns agree."""
    return matches.select(*schemas.fields(
        schemas.MATCHES, id=F.sha2(F.concat_ws("|", "subscriber_id", "edital_id"), 256),
        subscriber_id=F.col("subscriber_id"), edital_id=F.col("edital_id"), score=F.col("score"),
        notified=F.lit(False), explanation_json=F.col("explanation_json"), created_at=now))


def profile_to_json(subscribers: DataFrame) -> DataFrame:
    """Profile fields packed into ``profile_json``."""
    packed = [f.name for f in schemas.struct(schemas.PROFILE_JSON)]
    return subscribers.withColumn("profile_json", F.to_json(F.struct(*packed))).drop(*packed)


def profile_from_json(rows: DataFrame) -> DataFrame:
    """``profile_json`` unpacked. Missing flags default to true, a missing level or mode list accepts nothing."""
    p = F.from_json("profile_json", schemas.PROFILE_JSON)
    none = F.array().cast("array<string>")
    areas = F.transform(F.coalesce(p["areas_alvo"], F.array().cast(schemas.TARGET_AREAS)), lambda a: a.withField(
        "requer_aceita_cs", F.coalesce(a["requer_aceita_cs"], F.lit(False))))
    return rows.withColumns({
        "areas_alvo": areas,
        "niveis_aceitos": F.array_distinct(F.coalesce(p["niveis_aceitos"], none)),
        "modalidades_aceitas": F.array_distinct(F.coalesce(p["modalidades_aceitas"], none)),
        "apenas_gratuitos": F.coalesce(p["apenas_gratuitos"], F.lit(True)),
        "apenas_ies_emec_publicas": F.coalesce(p["apenas_ies_emec_publicas"], F.lit(True)),
    }).drop("profile_json")
