"""Institution registry: eligibility, the name gate and id resolution.

Names are compared as distinct values, not per notice. "Contains" is an equi-join: the substrings of each text
that have the length of some term, joined with the terms. Nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arauto.functions.text import registry_form
from arauto.operators.lookup import lookup


def eligible(institutions: DataFrame) -> DataFrame:
    return institutions.where("ativa and gratuita")


def registry_terms(institutions: DataFrame) -> DataFrame:
    """(term, codigo_emec): short and full names of eligible institutions, folded."""
    names = eligible(institutions).select("codigo_emec", F.explode(F.array("sigla", "nome")).alias("name"))
    return names.where("name is not null and name <> ''").select(registry_form("name").alias("term"), "codigo_emec").where(
        "term <> ''").distinct()


def registry_size(institutions: DataFrame) -> DataFrame:
    """Institutions loaded, eligible or not."""
    return institutions.agg(F.count_distinct("codigo_emec").alias("size"))


def _pieces(texts: DataFrame, text: str, terms: DataFrame, term: str, *keep: str) -> DataFrame:
    """(keep, text, __term): what of each text has the length of some term."""
    lengths = terms.agg(F.collect_set(F.length(term)).alias("l")).scalar()
    cut = texts.select(text, *keep).distinct().withColumn("__len", F.explode(lengths)).where(F.length(text) >= F.col("__len"))
    starts = F.sequence(F.lit(1), F.length(text) - F.col("__len") + 1)
    at_each = F.transform(starts, lambda i: F.substring(F.col(text), i, F.col("__len")))
    return cut.select(text, *keep, F.explode(F.array_distinct(at_each)).alias("__term"))


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Pairs (text, term) of distinct values where the text contains the term."""
    terms = terms.select(F.col(term).alias("__term")).distinct()
    return _pieces(texts, text, terms, "__term").join(terms, "__term").select(text, F.col("__term").alias(term))


def registry_gate(notices: DataFrame, institutions: DataFrame, name: str = "ies_nome", out: str = "in_registry",
                  whole_words: bool = False) -> DataFrame:
    """``notices`` with a flag: the name equals a registered short or full name, or contains one anywhere.

    ``whole_words`` asks for word borders around a contained name.
    """
    terms = registry_terms(institutions).select("term").distinct()
    names = notices.select(F.col(name).alias("__name")).where("__name is not null").distinct().withColumn("__n", registry_form("__name"))
    exact = names.join(terms, names["__n"] == terms["term"], "left_semi")
    rest = names.join(terms, names["__n"] == terms["term"], "left_anti")
    searched = rest.withColumn("__n", F.concat(F.lit(" "), F.regexp_replace("__n", r"\W+", " "), F.lit(" "))) if whole_words else rest
    wanted = terms.select(F.concat(F.lit(" "), F.regexp_replace("term", r"\W+", " "), F.lit(" ")).alias("term")) if whole_words else terms
    hit = containing(searched, "__n", wanted, "term").select("__n").distinct()
    loose = searched.join(hit, "__n", "left_semi")
    passed = exact.select("__name").union(loose.select("__name")).withColumn(out, F.lit(True))
    keyed = notices.withColumn("__name", F.nullif(name, F.lit("")))  # blank names are in no registry
    return lookup(keyed, passed.where("__name <> ''").distinct(), "__name").drop("__name").withColumn(out, F.coalesce(out, F.lit(False)))


def resolve_institution(notices: DataFrame, institutions: DataFrame, name: str = "ies_nome", out: str = "ies_id") -> DataFrame:
    """``notices`` with the institution's id: short name equal (upper case), else full name containing the query.

    When several fit, equality goes first, then the smallest id. Empty names resolve to nothing.
    """
    queries = notices.select(F.col(name).alias("__q")).where("__q <> ''").distinct()
    short = queries.withColumn("__k", F.upper(F.trim("__q"))).join(
        institutions.select(F.col("sigla").alias("__k"), F.col("id").alias("__id")), "__k"
    ).select("__q", F.lit(0).alias("__rank"), "__id")
    named = institutions.select(F.lower("nome").alias("__nome"), F.col("id").alias("__id"))
    lowered = queries.withColumn("__term", F.lower("__q"))
    # the smallest id of each piece first: a short query would else meet nearly every name
    least = _pieces(named, "__nome", lowered, "__term", "__id").groupBy("__term").agg(F.min("__id").alias("__id"))
    long = lowered.join(least, "__term").select("__q", F.lit(1).alias("__rank"), "__id")
    best = short.union(long).groupBy("__q").agg(F.min(F.struct("__rank", "__id"))["__id"].alias(out))
    return lookup(notices.drop(out).withColumn("__q", F.nullif(name, F.lit(""))), best, "__q").drop("__q")
