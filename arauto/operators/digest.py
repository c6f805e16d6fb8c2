"""Pending matches, digest items and rendered digests."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arauto.functions.fields import level_label, mode_label, two_decimals
from arauto.functions.text import bind
from arauto.operators.lookup import lookup
from arauto.session import cut_lineage

PART_SIZE = 500


def pending(matches: DataFrame, now: Column, hours: int = 24, since: Column | None = None) -> DataFrame:
    """Matches not yet sent and created within ``hours`` of ``now``, or from ``since`` on for a re-send."""
    start = since if since is not None else now - F.lit(timedelta(hours=hours))
    fresh = F.col("created_at") >= start
    return matches.where(fresh) if since is not None else matches.where(fresh & ~F.col("notified"))


def in_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("score"), "id")


def shown_of_notices(notices: DataFrame, *keep: str) -> DataFrame:
    """What a digest shows of notices, and the columns ``keep``."""
    return notices.select(
        F.col("id").alias("edital_id"), "titulo", "ies_id", "nivel", "modalidade", F.col("area_cnpq_codigo").alias("codigo"),
        "inscricao_ate", "url_origem", "url_pdf", *keep)


def display_rows(joined: DataFrame, institutions: DataFrame, areas: DataFrame, *keep: str | Column) -> DataFrame:
    """One display row per match that has met its notice, with optional institution and area names.

    Most rows may name one area, and a stream cannot measure that, so the table of areas, which is fixed and small, goes to every task.
    """
    i = institutions.select(F.col("id").alias("ies_id"), F.col("nome").alias("ies_nome"))
    a = areas.select("codigo", F.col("nome").alias("area_label"))
    joined = lookup(joined, i, "ies_id").join(F.broadcast(a), "codigo", "left")
    return joined.select(
        F.col("id").alias("match_id"), "subscriber_id", "titulo", F.coalesce("ies_nome", F.lit("")).alias("ies_nome"),
        level_label("nivel").alias("nivel_label"), mode_label("modalidade").alias("modalidade_label"),
        F.coalesce("area_label", F.lit("")).alias("area_label"), F.date_format("inscricao_ate", "yyyy-MM-dd").alias("prazo"),
        "url_origem", "url_pdf", "score", *keep)


def digest_items(matches: DataFrame, notices: DataFrame, institutions: DataFrame, areas: DataFrame) -> DataFrame:
    """One display row per match: inner join to the notice, optional institution and area names, in one plan."""
    joined = matches.select("id", "subscriber_id", "edital_id", "score").join(shown_of_notices(notices), "edital_id")
    return display_rows(joined, institutions, areas)


#: What one digest is for; digests of several days together are ("day", "subscriber_id").
ONE_DAY = ("subscriber_id",)


def level_groups(items: DataFrame, by: tuple[str, ...] = ONE_DAY) -> DataFrame:
    return items.groupBy(*by, "nivel_label").agg(F.count(F.lit(1)).alias("n"))


def ranked(items: DataFrame, part_size: int = PART_SIZE, by: tuple[str, ...] = ONE_DAY) -> DataFrame:
    """Items with ``total``, ``rank`` (score descending, then id) and ``part`` per digest, the same at every part size.

    Items are dealt by ranges of (digest, score, id) and numbered within their range; the ranges' sizes give the
    offsets. So no task sorts a large subscriber. The ranges are fixed by a cut to the checkpoint folder.
    """
    order = [F.desc("score"), F.asc("match_id")]
    rows = cut_lineage(items.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    key = [*by, "__range"]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy(*by)
    before = everything.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(everything).alias("total"))
    local = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    numbered = rows.withColumn("__local", local).join(offsets, key)
    rank = F.col("__offset") + F.col("__local")
    return numbered.withColumns({"rank": rank, "part": F.floor((rank - 1) / part_size).cast("int") + 1}).drop("__range", "__local", "__offset")


def complete(items: DataFrame, by: tuple[str, ...] = ONE_DAY) -> DataFrame:
    """Items whose shown texts are never null, with the size of their level's group in the whole digest."""
    shown = ("titulo", "ies_nome", "nivel_label", "modalidade_label", "area_label", "url_origem")
    items = items.withColumns({c: F.coalesce(c, F.lit("")) for c in shown})
    return items.join(level_groups(items, by).withColumnRenamed("n", "group_size"), [*by, "nivel_label"])


def _escape(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def _text_line(i: Column) -> Column:
    area = F.when(i["area_label"] != "", F.concat(F.lit(" | "), i["area_label"])).otherwise("")
    deadline = F.coalesce(F.concat(F.lit("\n  Inscrições até: "), i["prazo"]), F.lit(""))
    return F.concat(
        F.lit("- "), i["titulo"], F.lit("\n  "), i["ies_nome"], F.lit(" | "), i["modalidade_label"], area, deadline,
        F.lit("\n  Score: "), two_decimals(i["score"]), F.lit("\n  "), i["url_origem"], F.lit("\n"))


def _html_block(i: Column) -> Column:
    meta = F.concat_ws(
        " &middot; ", F.concat(F.lit("<strong>"), _escape(i["ies_nome"]), F.lit("</strong>")), _escape(i["modalidade_label"]),
        F.nullif(_escape(i["area_label"]), F.lit("")), F.concat(F.lit("Inscrições até "), i["prazo"]),
        F.concat(F.lit("score "), two_decimals(i["score"])))
    pdf = F.coalesce(F.concat(F.lit(' &middot; <a href="'), _escape(i["url_pdf"]), F.lit('">PDF</a>')), F.lit(""))
    return F.concat(
        F.lit("<div><b>"), _escape(i["titulo"]), F.lit("</b><br>"), meta, F.lit('<br><a href="'), _escape(i["url_origem"]),
        F.lit('">Ver edital</a>'), pdf, F.lit("</div>\n"))


def _html_groups(rows: Column) -> Column:
    """Blocks by level label in label order, each group headed by its label and its size in the whole digest."""
    sorted_rows = F.array_sort(F.transform(rows, lambda r: F.struct(r["i"]["nivel_label"].alias("label"), r["rank"], r["i"])))

    def groups(by_level: Column) -> Column:
        def block(r: Column, at: Column) -> Column:
            starts = (at == 0) | (F.get(by_level, at - 1)["label"] != r["label"])
            size = r["i"]["group_size"]
            head = F.concat(F.lit("<h2>"), _escape(r["label"]), F.lit(" ("), size.cast("string"), F.lit(")</h2>\n"))
            return F.concat(F.when(starts, head).otherwise(""), _html_block(r["i"]))

        return F.array_join(F.transform(by_level, block), "")

    return bind(sorted_rows, groups)  # an expression that a lambda mentions is worked out for every element: here a sort


def render_digests(items: DataFrame, subscribers: DataFrame, today: Column, default_to: str = "", only_on_match: bool = True,
                   subject_prefix: str = "[editais]", part_size: int = PART_SIZE, by: tuple[str, ...] = ONE_DAY) -> DataFrame:
    """(subscriber_id, part, parts, total, subject, recipient, body_text, body_html) per active subscriber.

    The text body lists items by score, the HTML body groups them by level. A digest beyond ``part_size`` items
    continues in further parts, so a body never gathers an unbounded group. Without matches there is no digest,
    unless ``only_on_match`` is off. With ``by`` day and subscriber, ``today`` may be the day's column.
    """
    items = complete(items, by)
    fields = [c for c in items.columns if c not in by]
    parts = ranked(items, part_size, by).groupBy(*by, "part").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("i")))).alias("rows"))
    people = subscribers.where("ativo").select(F.col("id").alias("subscriber_id"), "nome", "email")
    d = people.join(parts, "subscriber_id", "inner" if only_on_match else "left")
    d = d.withColumns({"total": F.coalesce("total", F.lit(0)), "part": F.coalesce("part", F.lit(1)),
                       "rows": F.coalesce("rows", F.array().cast(parts.schema["rows"].dataType))})
    day = today.cast("string")
    count = F.col("total").cast("string")
    found = F.concat(count, F.lit(" edital(is) encontrado(s) no seu perfil ("), "nome", F.lit(").\n\n"))
    heading = F.concat(F.lit("<h1>Editais relevantes — "), day, F.lit("</h1>\n<p>"), count, F.lit(" no perfil "), _escape(F.col("nome")), F.lit("</p>\n"))
    return d.select(
        *by, "part", F.greatest(F.ceil(F.col("total") / part_size), F.lit(1)).cast("int").alias("parts"), "total",
        F.concat(F.lit(f"{subject_prefix} "), count, F.lit(" novo(s) edital(is) — "), day).alias("subject"),
        F.coalesce(F.nullif("email", F.lit("")), F.lit(default_to)).alias("recipient"),
        F.concat(F.lit("Editais — "), day, F.lit("\n\n"), found,
                 F.array_join(F.transform("rows", lambda r: _text_line(r["i"])), "")).alias("body_text"),
        F.concat(heading, _html_groups(F.col("rows"))).alias("body_html"),
    )
