"""Text normalisation and tokens.

Everything runs on the JVM except NFKC composition, which Spark lacks. Only rows holding a character that
could change under NFKC reach the Arrow function; the others pass it a null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ColumnLike = Column | str

# Blocks whose characters never combine with a neighbour: Latin, Greek, Cyrillic, Latin Extended Additional,
# punctuation to arrows and mathematics, CJK ideographs.
_STABLE_BLOCKS = ((0x00, 0x2FF), (0x370, 0x482), (0x48A, 0x52F), (0x1E00, 0x1EFF), (0x2000, 0x22FF), (0x4E00, 0x9FFF))
_ZERO_WIDTH = "​‌‍﻿"

# Latin letters and signs with no Unicode decomposition, and their ASCII spelling.
_ASCII_SINGLE = dict(zip("ØøŁłĐđĦħıŦŧÐð‐‑‒–―‘’‚‛“”‟·•×÷«»¡¿‹›′¦¬¯", "OoLlDdHhiTtDd-----'',''\"\"\"**x/<>!?<>'|!-"))
_ASCII_MULTI = {
    "ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "—": "--",
    "…": "...", "„": ",,", "©": "(c)", "®": "(r)", "™": "tm", "€": "EUR", "£": "PS", "§": "SS", "°": "deg",
    "±": "+-", "«": "<<", "»": ">>", "ﬁ": "fi", "ﬂ": "fl", "½": "1/2", "¼": "1/4", "¾": "3/4", "№": "No",
}


def _chars():
    return (chr(cp) for cp in range(0x80, 0x1F000) if not 0xD800 <= cp <= 0xDFFF)


def _guarded_class(code_points: list[int], together: int = 8) -> str:
    """A class of many ranges. Java tries every range of a class on every character; here groups of ranges stand behind their
    bounds, and all of them behind the bounds of the whole, so that a character meets few."""
    ranges: list[list[int]] = []
    for cp in code_points:
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    spell = lambda rs: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in rs)
    bound = lambda rs: spell([(rs[0][0], rs[-1][1])])
    groups = [ranges[i:i + together] for i in range(0, len(ranges), together)]
    return f"[{bound(ranges)}&&[{''.join(f'[{bound(g)}&&[{spell(g)}]]' for g in groups)}]]"


@lru_cache(maxsize=1)
def _nfkc_rules() -> tuple[str, str, str]:
    """(from, to, pattern): one-to-one compatibility forms, and a pattern for text that still needs NFKC."""
    source, target, stable = [], [], list(range(0x80))
    for lo, hi in _STABLE_BLOCKS:
        for cp in range(max(lo, 0x80), hi + 1):
            c = chr(cp)
            folded = unicodedata.normalize("NFKC", c)
            if folded == c:
                stable.append(cp)
            elif len(folded) == 1 and not unicodedata.combining(folded):
                source.append(c)
                target.append(folded)
    same = {*stable, 0xFEFF, *range(0xD800, 0xE000)}
    return "".join(source), "".join(target), _guarded_class([cp for cp in range(0x110000) if cp not in same])


@lru_cache(maxsize=1)
def _ascii_rules() -> tuple[str, str]:
    """(from, to) for ``translate``: one ASCII letter per decomposable character; combining marks and zero-width
    characters are deleted."""
    single, marks = dict(_ASCII_SINGLE), []
    for c in _chars():
        if c in _ASCII_MULTI:
            single.pop(c, None)
            continue
        base = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        if len(base) == 1 and base.isascii():
            single[c] = base
        elif c in _ZERO_WIDTH or (not base and 0x300 <= ord(c) <= 0x36F):
            marks.append(c)
    return "".join(single) + "".join(marks), "".join(single.values())


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_ascii(t: Column) -> Column:
    return F.octet_length(t) == F.char_length(t)


def _collapse(t: Column) -> Column:
    # single blanks, by far the most common white space, need no replacement
    return F.trim(F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]", " "))


def squeeze(text: ColumnLike) -> Column:
    """Drop zero-width characters, collapse white space, trim; null becomes ''."""
    t = F.coalesce(_col(text), F.lit(""))
    return _collapse(F.when(_is_ascii(t), t).otherwise(F.regexp_replace(t, f"[{_ZERO_WIDTH}]", "")))


def nfkc(text: ColumnLike) -> Column:
    """Unicode NFKC. ASCII rows cost one regex test, Latin text one ``translate``."""
    source, target, unstable = _nfkc_rules()
    t = _col(text)
    t = F.when(_is_ascii(t), t).otherwise(F.translate(t, source, target))
    needs = t.rlike(unstable)
    return F.when(needs, _nfkc(F.when(needs, t))).otherwise(t)


def normalize_text(text: ColumnLike, compose: bool = True) -> Column:
    """NFKC, no zero-width characters, single spaces, trimmed; null becomes ''.

    ``compose=False`` leaves NFKC out for text that already had it (everything from ``dom_struct``) and keeps
    the plan free of Python.
    """
    return squeeze(nfkc(text)) if compose else squeeze(text)


def fold(text: ColumnLike) -> Column:
    """Transliterate to lower-case ASCII without touching spaces. Non-Latin scripts keep their letters."""
    source, target = _ascii_rules()
    t = _col(text)
    multi = t
    for c, spelled in _ASCII_MULTI.items():
        multi = F.replace(multi, F.lit(c), F.lit(spelled))
    multi = F.when(t.rlike(f"[{''.join(_ASCII_MULTI)}]"), multi).otherwise(t)
    return F.lower(F.when(_is_ascii(t), t).otherwise(F.translate(multi, source, target)))


def to_ascii(text: ColumnLike) -> Column:
    """``normalize_text`` then ``fold``: the form hashes and keyword rules work on."""
    return _collapse(fold(F.coalesce(_col(text), F.lit(""))))


def registry_form(text: ColumnLike) -> Column:
    """Institution names: transliterated, lower-case, trimmed; inner spaces stay."""
    return F.regexp_replace(fold(text), r"(?U)^\s+|\s+$", "")


def tokens(text: ColumnLike) -> Column:
    """Word tokens of already folded text."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)\w+"), F.lit(0))


def strip_tags(text: ColumnLike) -> Column:
    return F.regexp_replace(_col(text), r"<[^>]+>", " ")


def clip(text: ColumnLike, width: int) -> Column:
    return F.substring(_col(text), 1, width)
