"""Column functions on the documented cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from arauto.functions import fields as f
from arauto.functions import text as t


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("r")).first().r


def many(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", fn("v").alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_normalize_text(spark):
    values = ["foo   bar\n\nbaz", "foo​bar", "", None, " é x", "ﬁm", "２０", "áb"]
    assert many(spark, values, t.normalize_text) == ["foo bar baz", "foobar", "", "", "é x", "fim", "20", "áb"]


def test_to_ascii(spark):
    values = ["Ciência da Computação", "UFRGS", "Straße œuvre", None, "São  Paulo – 2ª"]
    assert many(spark, values, t.to_ascii) == ["ciencia da computacao", "ufrgs", "strasse oeuvre", "", "sao paulo - 2a"]


def test_tokens_and_tags(spark):
    assert one(spark, "a1 b_c, d", t.tokens) == ["a1", "b_c", "d"]
    assert one(spark, "<p>x<b>y</b>", t.strip_tags) == " x y "


@pytest.mark.parametrize("text, expected", [
    ("Periodo de inscricao: de 01/03/2026 a 15/04/2026.", (date(2026, 3, 1), date(2026, 4, 15))),
    ("Prazo: ate 30/06/2026", (None, date(2026, 6, 30))),
    ("As inscricoes vao de 1 de marco de 2026 a 15 de abril de 2026.", (date(2026, 3, 1), date(2026, 4, 15))),
    ("Inscricoes 30/02/2026", None),
    ("", None),
    ("Inscricoes 01/12/2026", (date(2026, 12, 1), None)),
    ("Inscricoes 1 de dezembro de 2026", (date(2026, 12, 1), None)),
    ("x" * 900 + " prazo 1-2-2026 e 3 de MARÇO 2026", (date(2026, 2, 1), date(2026, 3, 3))),
    ("inscrição 01/02/2026 " + "x" * 700, (date(2026, 2, 1), None)),
])
def test_application_window(spark, text, expected):
    got = one(spark, text, f.application_window)
    assert (tuple(got) if got else None) == expected


def test_window_keys_need_folding_for_accents(spark):
    text = "x" * 700 + " inscrição até 01/02/2026"
    assert one(spark, text, f.application_window) is None
    assert one(spark, text, lambda c: f.application_window(c, fold_accents=True))[0] == date(2026, 2, 1)


def test_window_labels(spark):
    rows = spark.createDataFrame([((date(2026, 1, 2), None),), (None,), ((date(2026, 3, 1), date(2026, 2, 1)),)], "p struct<de:date,ate:date>")
    got = rows.select(f.window_label("p"), f.window_is_valid("p"), f.window_is_over("p", F.lit(date(2026, 2, 2))),
                      f.window_is_open("p", F.lit(date(2026, 1, 1)))).collect()
    assert [tuple(r) for r in got] == [("2026-01-02..?", True, False, False), ("", True, False, True), ("2026-03-01..2026-02-01", False, True, False)]


def test_levels(spark):
    values = ["MBA em gestão", "Mestrado Profissional", "Mestrado e Doutorado", "Doutoradas", "ESPECIALIZAÇÃO", "lato  sensu", "nada", None]
    assert many(spark, values, f.level_from_text) == [
        "mba", "mestrado_profissional", "mestrado_academico", "doutorado", "especializacao", "especializacao", "desconhecido", "desconhecido"]
    assert one(spark, "Doutorado", lambda c: f.level_from_text(c, F.lit("MBA x"))) == "mba"
    assert one(spark, "Doutorado", lambda c: f.level_from_text(c, F.lit("Edital"))) == "doutorado"


def test_modes(spark):
    values = ["polo UAB, a distância", "Híbrido", "semi-presencial", "online", "presencial", ""]
    assert many(spark, values, f.mode_from_text) == ["uab", "semipresencial", "semipresencial", "ead", "presencial", "desconhecida"]


def test_enum_parsing(spark):
    assert many(spark, ["mba", "Mestrado", "", None], f.parse_level) == ["mba", "mestrado_academico", None, None]
    assert many(spark, ["ead", "Online", ""], f.parse_mode) == ["ead", "ead", None]


def test_small_fields(spark):
    assert many(spark, ["São 20 vagas", "1 vaga", "sem", "99999999999 vagas"], f.seats) == [20, 1, None, None]
    assert many(spark, ["curso gratuito", "sem mensalidade", "mensalidade", "sem custo"], f.free_hint) == [True, None, None, True]
    assert one(spark, "PPG (123) x", f.programme_code) == "123"
    assert many(spark, ["https://WWW.a.org/x", "nope", None], f.host) == ["www.a.org", "unknown", "unknown"]
    assert many(spark, ["Abertura EDITAL Nº 3/2026 - Mestrado", "Curto. Uma frase bem mais longa que vinte. Fim", "curto", ""],
                f.document_title) == ["EDITAL Nº 3/2026 - Mestrado", "Uma frase bem mais longa que vinte", "(sem titulo)", ""]
    assert one(spark, "mestrado_academico", f.level_label) == "Mestrado Academico"
    assert many(spark, ['{"de":"2026-01-02"}', '{"de":"x","ate":"2026-01-01"}', "{}", None], f.parse_window_json) == [
        (date(2026, 1, 2), None), None, None, None]


def test_two_decimals_round_like_printf(spark):
    values = [i / 1000 for i in range(0, 3000, 5)] + [0.125, 0.375, 1.005, 2.675, 12.345, 0.7, 1e-9]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", f.two_decimals("v").alias("r")).collect()
    assert {r.i: r.r for r in rows} == {i: "%.2f" % v for i, v in enumerate(values)}
