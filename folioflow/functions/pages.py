"""Readers of one page: pagination, candidate scores, whether a sentence runs on, shared names."""

from __future__ import annotations

import sys
import unicodedata
from datetime import date
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip_accents

# Weights of a candidate's score.
W_POSITION, W_CAPITALS, W_ISOLATION, W_FORM, W_CITATION = 0.35, 0.45, 0.20, 0.30, 0.55


def pagination(text: str | Column) -> Column:
    """struct(index, total) of 'página X de Y'; null where it is impossible."""
    p = "(?i)\\bp[aá]g(?:ina)?\\.?\\s*(\\d{1,4})\\s*(?:de|/)\\s*(\\d{1,4})\\b"
    i, n = (F.regexp_extract(_c(text), p, k) for k in (1, 2))
    i, n = (F.when(x != "", x.cast("int")) for x in (i, n))
    return F.when((i >= 1) & (i <= n), F.struct(i.alias("index"), n.alias("total")))


def candidate_score(line: Column, total: Column, capitals: Column, words: Column, form: Column, cited: Column) -> Column:
    """From 0 to 1: how high a line stands, its share of capitals, how alone it is, the official form, and whether it is cited."""
    position = F.greatest(F.lit(0.0), 1 - F.try_divide(line.cast("double"), (total - 1).cast("double")))
    isolation = F.when(words <= 6, 1.0).when(words >= 12, 0.0).otherwise((12 - words) / 6)
    form = (form & ~cited).cast("int")
    s = W_POSITION * F.coalesce(position, F.lit(1.0)) + W_CAPITALS * capitals + W_ISOLATION * isolation + W_FORM * form - W_CITATION * cited.cast("int")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def capitals_share(text: str | Column) -> Column:
    letters = F.regexp_count(_c(text), F.lit("\\p{L}"))
    return F.when(letters > 0, F.regexp_count(_c(text), F.lit("\\p{Lu}")) / letters).otherwise(F.lit(0.0))


def tail_runs_on(text: str | Column) -> Column:
    """The last line ends in a letter or comma and has five words at least."""
    last = F.substring_index(F.rtrim(_c(text)), "\n", -1)
    return last.rlike("[\\p{L},]$") & (F.size(F.split(F.trim(last), "\\s+")) >= 5)


def head_runs_on(text: str | Column) -> Column:
    """The first line has three words at least and starts in lower case."""
    first = F.substring_index(F.ltrim(_c(text)), "\n", 1)
    return first.rlike("^\\p{Ll}") & (F.size(F.split(F.trim(first), "\\s+")) >= 3)


@cache
def _all_marked() -> tuple[str, str]:
    """All letters that are A-Z or a-z with marks, then the marks themselves; and the plain letters."""
    letters, plain, marks = [], [], []
    for x in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(x)[0] == "M":
            marks.append(x)
        elif (base := unicodedata.normalize("NFD", x)[0]).isascii() and base.isalpha():
            letters.append(x)
            plain.append(base)
    return "".join(letters + marks), "".join(plain)


def capitalised_words(text: str | Column) -> Column:
    """Different words of a capital and two small letters at least, without their marks; letters other than A-Z end a word."""
    return F.array_distinct(F.regexp_extract_all(F.translate(_c(text), *_all_marked()), F.lit("(?<![0-9A-Za-z_])([A-Z][a-z]{2,})(?![0-9A-Za-z_])"), F.lit(1)))


def shared_names(a: Column, b: Column, least: int = 2) -> Column:
    """Null where a or b is."""
    return F.array_size(F.array_intersect(a, b)) >= least


def from_path(path: str | Column, up: int) -> Column:
    """A folder's name in a path, counted from the file; null where there is none."""
    return F.try_element_at(F.split(_c(path), "[\\\\/]"), F.lit(-1 - up))


def is_id_card(text: str | Column) -> Column:
    return F.upper(strip_accents(text)).rlike("CEDULA DE CIUDADANIA|IDENTIFICACION PERSONAL|REGISTRADURIA NACIONAL|ESTATURA.{0,40}RH")


def has_stamp(text: str | Column) -> Column:
    return F.upper(F.substring(_c(text), 1, 1000)).rlike("RADICAD[OA]|RECIBIDO|FOLIOS\\s*:")


def declared_folios(text: str | Column) -> Column:
    n = F.regexp_extract(F.upper(_c(text)), "FOLIOS?\\s*:?\\s*(\\d{1,3})\\b", 1)
    return F.when(n != "", n.cast("int"))


def normalised_user(x: str | Column) -> Column:
    """An id's digits or a mail address in lower case."""
    t = F.trim(_c(x))
    return F.when(t.contains("@"), F.lower(t)).otherwise(F.regexp_replace(t, "[^0-9]", ""))


def correct_year(read: Column, around: Column, both: Column) -> Column:
    """The date with its neighbours' year: that of both sides if day and month agree, else a year one figure away that falls among them; null where it isn't clear."""

    @F.pandas_udf("date")
    def run(a: pd.Series, near: pd.Series, same: pd.Series) -> pd.Series:
        return pd.Series([_corrected(x, list(n) if n is not None else [], s) for x, n, s in zip(a, near, same, strict=True)], dtype=object)

    return run(read, around, both)


def _corrected(x: date | None, near: list, same: date | None) -> date | None:
    if x is None:
        return None
    if same is not None and same == same and (same.month, same.day) == (x.month, x.day):
        return same
    near = [n for n in near if n is not None]
    for year in sorted({n.year for n in near}, key=lambda y: (abs(y - x.year), y)):
        if sum(p != q for p, q in zip(f"{year:04d}", f"{x.year:04d}", strict=True)) == 1:
            try:
                got = x.replace(year=year)
            except ValueError:
                continue
            if min(near) <= got <= max(near):
                return got
    return None
