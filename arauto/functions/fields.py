"""Field rules as Catalyst expressions: level, mode, dates, seats, title, URLs, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arauto import dims
from arauto.functions.text import ColumnLike, _col, bind, clip, fold


def matches(text: ColumnLike, pattern: str) -> Column:
    return _col(text).rlike(dims.RE_FLAGS + pattern)


def is_relevant(title: ColumnLike, pattern: str = dims.RE_RELEVANT) -> Column:
    return matches(title, pattern)


# --- level and mode ---------------------------------------------------------------------------------------


def _scan_level(t: Column) -> Column:
    return (
        F.when(matches(t, dims.RE_MBA), "mba")
        .when(matches(t, dims.RE_PROFESSIONAL), "mestrado_profissional")
        .when(matches(t, dims.RE_MASTER), "mestrado_academico")
        .when(matches(t, dims.RE_DOCTORATE), "doutorado")
        .when(matches(t, dims.RE_SPECIALISATION), "especializacao")
        .otherwise("desconhecido")
    )


def level_from_text(text: ColumnLike, title: ColumnLike | None = None) -> Column:
    """Degree level; the title decides when it names one. A master's wins over a doctorate in the same text."""
    body = _scan_level(F.coalesce(_col(text), F.lit("")))
    if title is None:
        return body
    head = _scan_level(F.coalesce(_col(title), F.lit("")))
    return F.coalesce(F.nullif(head, F.lit("desconhecido")), body)


def mode_from_text(text: ColumnLike) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return (
        F.when(matches(t, dims.RE_UAB), "uab")
        .when(matches(t, dims.RE_HYBRID), "semipresencial")
        .when(matches(t, dims.RE_DISTANCE), "ead")
        .when(matches(t, dims.RE_ON_SITE), "presencial")
        .otherwise("desconhecida")
    )


def parse_level(value: ColumnLike) -> Column:
    """A level code as it is, anything else through the text rule; empty gives null."""
    v = F.nullif(_col(value), F.lit(""))
    return F.when(v.isin(*dims.LEVELS), v).when(v.isNotNull(), level_from_text(v))


def parse_mode(value: ColumnLike) -> Column:
    v = F.nullif(_col(value), F.lit(""))
    return F.when(v.isin(*dims.MODES), v).when(v.isNotNull(), mode_from_text(v))


# --- dates ------------------------------------------------------------------------------------------------


def parse_numeric_date(value: ColumnLike) -> Column:
    """d/m/yyyy or d-m-yyyy; impossible dates give null."""
    return F.try_to_date(F.translate(_col(value), "-", "/"), "d/M/yyyy")


def parse_worded_date(value: ColumnLike) -> Column:
    """'1 de março [de] 2026'; unknown months and impossible dates give null."""
    pattern = dims.RE_FLAGS + dims.RE_DATE_WORDS
    months = F.create_map(*[F.lit(x) for pair in dims.MONTHS.items() for x in pair])
    month = lambda v: F.coalesce(months[F.lower(F.regexp_extract(v, pattern, 2))].cast("string"), F.lit("x"))
    spelled = lambda v: F.concat_ws("/", F.regexp_extract(v, pattern, 1), month(v), F.regexp_extract(v, pattern, 3))
    return F.try_to_date(spelled(_col(value)), "d/M/yyyy")


def all_dates(text: ColumnLike) -> Column:
    """Valid dates of a text in order of appearance. The two date patterns cannot overlap, so one scan finds both."""
    pattern = f"{dims.RE_FLAGS}{dims.RE_DATE_NUMERIC}|{dims.RE_DATE_WORDS}"
    found = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))
    dates = F.transform(found, lambda s: F.when(s.rlike("[/-]"), parse_numeric_date(s)).otherwise(parse_worded_date(s)))
    return F.filter(dates, lambda d: d.isNotNull())


def window_text(text: ColumnLike, fold_accents: bool = False) -> Column:
    """The stretch that states the application window: 20 characters before the first key found (keys are tried
    in order) to 300 after its start, or the first 600 characters.

    The keys carry no accents, so 'inscrição' is found only with ``fold_accents=True``.
    """
    t = _col(text)
    searched = fold(t) if fold_accents else F.lower(t)
    at = bind(searched, lambda s: F.coalesce(*[F.nullif(F.instr(s, k), F.lit(0)) for k in dims.WINDOW_KEYS]))

    def stretch(at: Column) -> Column:
        start = F.greatest(at - 20, F.lit(1))
        return F.when(at.isNull(), F.substring(t, 1, 600)).otherwise(F.substring(t, start, at + 300 - start))

    return bind(at, stretch)


def window_from(stretch: ColumnLike) -> Column:
    """(de, ate) from the first two dates; a single date closes the window when a closing word is near."""
    w = _col(stretch)
    closing = reduce(lambda a, b: a | b, [F.contains(F.lower(w), F.lit(k)) for k in dims.CLOSING_WORDS])

    def ends(dates: Column) -> Column:
        first, second = F.get(dates, F.lit(0)), F.get(dates, F.lit(1))
        both = F.struct(first.alias("de"), second.alias("ate"))
        end = F.struct(F.lit(None).cast("date").alias("de"), first.alias("ate"))
        return F.when(first.isNull(), None).when(second.isNull() & closing, end).otherwise(both)

    return bind(all_dates(w), ends)


def application_window(text: ColumnLike, fold_accents: bool = False) -> Column:
    return bind(window_text(text, fold_accents), window_from)


def window_is_valid(period: ColumnLike) -> Column:
    """False when the window ends before it starts; such rows go to the dead letters, alone."""
    p = _col(period)
    return F.coalesce(p["de"] <= p["ate"], F.lit(True))


def window_is_open(period: ColumnLike, today: Column) -> Column:
    p = _col(period)
    return F.coalesce(p["de"] <= today, F.lit(True)) & F.coalesce(p["ate"] >= today, F.lit(True))


def window_is_over(period: ColumnLike, today: Column) -> Column:
    return F.coalesce(_col(period)["ate"] < today, F.lit(False))


def window_label(period: ColumnLike) -> Column:
    """'de..ate' with '?' for a missing end; '' without a window."""
    p = _col(period)
    ends = [F.coalesce(p[c].cast("string"), F.lit("?")) for c in ("de", "ate")]
    return F.when(p.isNull(), F.lit("")).otherwise(F.concat_ws("..", *ends))


def parse_window_json(value: ColumnLike) -> Column:
    """{'de','ate'} in ISO form; an unreadable end voids the window, as do two missing ends."""
    p = F.from_json(_col(value), "de string, ate string")
    ends = {c: F.nullif(p[c], F.lit("")) for c in ("de", "ate")}
    dates = {c: F.try_to_date(v, "yyyy-MM-dd") for c, v in ends.items()}
    bad = reduce(lambda a, b: a | b, [ends[c].isNotNull() & dates[c].isNull() for c in ends])
    some = F.coalesce(dates["de"], dates["ate"]).isNotNull()
    return F.when(~bad & some, F.struct(*[d.alias(c) for c, d in dates.items()]))


# --- other fields -----------------------------------------------------------------------------------------


def seats(text: ColumnLike, pattern: str = dims.RE_SEATS_HTML) -> Column:
    return F.nullif(F.regexp_extract(_col(text), dims.RE_FLAGS + pattern, 1), F.lit("")).try_cast("int")


def free_hint(text: ColumnLike, pattern: str = dims.RE_FREE_HTML) -> Column:
    """True when the text says so, otherwise unknown."""
    return F.when(matches(text, pattern), F.lit(True))


def document_title(text: ColumnLike) -> Column:
    """The notice heading, else the first sentence longer than 20 characters, else the placeholder; '' if no text."""
    t = _col(text)
    heading = F.nullif(F.trim(F.regexp_extract(t, dims.RE_FLAGS + dims.RE_DOCUMENT_TITLE, 0)), F.lit(""))
    sentence = F.get(F.filter(F.split(t, r"\. "), lambda s: F.length(s) > 20), F.lit(0))
    fallback = F.when(t == "", "").otherwise(F.coalesce(sentence, F.lit(dims.UNTITLED)))
    return clip(F.coalesce(heading, fallback), dims.MAX_TITLE)


def programme_code(text: ColumnLike) -> Column:
    return F.regexp_extract(_col(text), r"\((\d+)\)", 1)


def score(base: Column | float, parts: list[tuple[Column, float]], cap: float = 0.95) -> Column:
    """Base plus a weight per satisfied condition, capped."""
    start = base if isinstance(base, Column) else F.lit(base)
    total = reduce(lambda acc, p: acc + F.when(p[0], p[1]).otherwise(0.0), parts, start)
    return F.least(F.lit(cap), total)


def known_level(level: ColumnLike) -> Column:
    return _col(level) != "desconhecido"


def known_mode(mode: ColumnLike) -> Column:
    return _col(mode) != "desconhecida"


def filled(c: ColumnLike) -> Column:
    """Truthy in the sense of the field rules: neither null nor empty."""
    return F.coalesce(_col(c) != "", F.lit(False))


def two_decimals(x: ColumnLike) -> Column:
    """A non-negative score with two decimals, rounded by its exact binary value, halves to even.

    (``format_string`` would round the shortest decimal form up: 0.345 is stored below 0.345 and must give 0.34.)
    Splitting off the float part keeps both products exact, so the sign of ``over`` is right.
    """
    x = _col(x).cast("double")
    high = x.cast("float").cast("double")
    n = F.floor(x * 100)
    over = (high * 200 - (2 * n + 1)) + (x - high) * 200
    cents = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def truthy_or(first: ColumnLike, second: ColumnLike) -> Column:
    return F.coalesce(F.nullif(_col(first), F.lit("")), _col(second))


def host(url: ColumnLike) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(_col(url), F.lit("HOST"))), F.lit("unknown"))


def prefix_host(url: ColumnLike, base: str) -> Column:
    u = _col(url)
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit(base), u))


def external_id(value: ColumnLike, source: ColumnLike) -> Column:
    return F.concat_ws(":", _col(source), _col(value))


def area_text(code: ColumnLike, name: ColumnLike) -> Column:
    return F.concat_ws(" - ", _col(code), _col(name))


def level_label(level: ColumnLike) -> Column:
    return F.initcap(F.replace(_col(level), F.lit("_"), F.lit(" ")))


def mode_label(mode: ColumnLike) -> Column:
    return F.initcap(_col(mode))
