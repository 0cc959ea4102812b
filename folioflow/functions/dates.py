"""Dates in texts and rows. 'Today' is always a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip_accents

# Month names, words that make a date a citation, words of identity cards, contexts and the earliest year.
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
CITED = r"(?i)\b(?:ley(?:es)?|decreto|sentencias?|resoluci[oó]n(?:es)?|circular|acuerdo|art[ií]culo|art\.|numeral|inciso|expediente|radicad[oa]|[A-Z]{1,3}-\d{2,4})\b[^.\n]{0,40}$"
OF_A_CARD = r"(?i)nac[iíl1]m[iíl1]e[nm]t[o0]|estatura|\bg\.?\s*s\.?\s*rh\b|lugar\s+de\s+expedici[oó]n|fecha\s+y\s+lugar\s+de\s+expedici|registrad\w*\s+nacional"
CITATION_CONTEXT, CARD_BEFORE, CARD_AFTER, LEAST_YEAR = 60, 45, 70, 1990
DAYS_BEFORE, DAYS_AFTER = 120, 45
# A letterhead, labels of date boxes and their reach, account figures beside them, a closing formula, days in words.
PLACE_AND_DATE = r"\b([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ.]+(?: [A-Za-zÁÉÍÓÚÑáéíóúñ.]+){0,3}),\s*(\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{1,2}\s+(?:de\s+)?[A-Za-záéíóúñ]+\s+(?:del?\s+)?\d{4})"
BOX_LABELS = r"(?i)\bD[IÍ]A\b\W{1,15}\bMES\b\W{1,15}\bA(?:[ÑN]|NI)?O\b"
BOX_REACH = 260
ACCOUNT_FIGURES = r"(?i)(?:ID\s*DE\s*COBROS|\bNIC)\W{0,6}(?:\d{6,}(?:\s?-\s?\d{1,2})?|(?:\d(?!\d)[\s|*\-]{0,3}){6,})"
O_FOR_ZERO = r"(?<=\d)[Oo](?=[\d/.\-]|\s|$)|(?<!\p{L})[Oo](?=\d)"
GIVEN = r"\b(?:DAD[AO]|EXPEDID[AO])\s+EN\b(.{1,90}?)\bD[I1]AS?\b\W{0,3}(?:DEL?\s+MES\s+)?DE\s*([A-Z]{3,})(.{0,40})"
YEAR_OF_HEADING = r"\bRESOLUCI[O0]N\s*N\W{0,3}[O0]?\W{0,3}\s*[\d ]{3,8}\s+DE\s+((?:19|20)\d{2})\b"
DAY_WORDS = {
    "UNO": 1, "UN": 1, "PRIMERO": 1, "DOS": 2, "TRES": 3, "CUATRO": 4, "CINCO": 5, "SEIS": 6, "SIETE": 7, "OCHO": 8, "NUEVE": 9, "DIEZ": 10, "ONCE": 11, "DOCE": 12, "TRECE": 13, "CATORCE": 14,
    "QUINCE": 15, "DIECISEIS": 16, "DIECISIETE": 17, "DIECIOCHO": 18, "DIECINUEVE": 19, "VEINTE": 20, "VEINTIUNO": 21, "VEINTIUN": 21, "VEINTIDOS": 22, "VEINTITRES": 23, "VEINTICUATRO": 24,
    "VEINTICINCO": 25, "VEINTISEIS": 26, "VEINTISIETE": 27, "VEINTIOCHO": 28, "VEINTINUEVE": 29, "TREINTA": 30, "TREINTA Y UNO": 31, "TREINTA Y UN": 31,
}


SHAPE = "(?:\\b\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}\\b|\\b\\d{1,2} (?:de )?[A-Za-záéíóúñÁÉÍÓÚÑ]+ ?, (?:del? )?(?:a[ñn]o )?\\d{4}\\b|\\b\\d{1,2} (?:de )?[A-Za-záéíóúñÁÉÍÓÚÑ]+ (?:del? )?(?:a[ñn]o )?\\d{4}\\b)"


def _possible(day: Column, month: Column, year: Column, today: date) -> Column:
    """The date of three numbers, if there is such a day from LEAST_YEAR to today."""
    d = F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.when(month.isNotNull() & (year.cast("int") >= LEAST_YEAR) & (d <= F.lit(today)), d)


def _read(hit: Column, today: date) -> Column:
    """The date of one hit of SHAPE."""
    months = F.create_map(*[F.lit(v) for k, m in MONTHS.items() for v in (k, m)])
    figures = hit.rlike("^\\d{1,2}[/-]")
    month = F.when(figures, F.regexp_extract(hit, "^\\d{1,2}[/-](\\d{1,2})", 1).cast("int")).otherwise(F.try_element_at(months, F.lower(F.regexp_extract(hit, "^\\d{1,2} (?:de )?([^ ,0-9]+)", 1))))
    return _possible(F.regexp_extract(hit, "^(\\d{1,2})", 1), month, F.regexp_extract(hit, "(\\d{4})$", 1), today)


def own_dates(text: str | Column, today: date) -> Column:
    """Dates that a text gives as its own, in order: in figures or with a month's name, possible, from 1990 to today, not cited, not of an identity card.

    The text is cut once at its hits; where each starts is a running sum, and its surroundings are taken from the whole text.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "\\s+", " "))
    pieces = F.split(F.regexp_replace(flat, f"({SHAPE})", "\u0001$1\u0002"), "\u0001")
    none = F.array().cast("array<struct<hit:string,start:int>>")

    def step(a: Column, p: Column) -> Column:
        hit = F.struct(F.element_at(F.split(p, "\u0002"), 1).alias("hit"), a["at"].alias("start"))
        return F.struct((a["at"] + F.length(p) - 1).alias("at"), F.concat(a["hits"], F.array(hit)).alias("hits"))

    begin = F.struct((F.length(F.get(pieces, F.lit(0))) + 1).alias("at"), none.alias("hits"))
    hits = F.when(F.size(pieces) > 1, F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), begin, step)["hits"]).otherwise(none)

    def dated(h: Column) -> Column:
        start = h["start"]
        piece = lambda back, on: F.substring(flat, F.greatest(start - back, F.lit(1)), F.least(F.lit(back), start - 1) + on)
        ours = ~piece(CITATION_CONTEXT, 0).rlike(CITED) & ~piece(CARD_BEFORE, CARD_AFTER).rlike(OF_A_CARD)
        return F.when(ours, _read(h["hit"], today))

    return F.filter(F.transform(hits, dated), lambda d: d.isNotNull())


def last_date(pages: Column, today: date) -> Column:
    """The latest own date of an array of page texts."""
    return F.array_max(F.flatten(F.transform(pages, lambda t: own_dates(t, today))))


def first_date(pages: Column, today: date) -> Column:
    return F.array_min(F.flatten(F.transform(pages, lambda t: own_dates(t, today))))


def letterhead_date(text: str | Column, today: date) -> Column:
    """The date of the first 'Place, date' that has a possible one."""
    flat = F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "\\s+", " "))
    dates = F.transform(F.regexp_extract_all(flat, F.lit(PLACE_AND_DATE), F.lit(2)), lambda h: F.get(own_dates(h, today), F.lit(0)))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def boxed_date(text: str | Column, today: date) -> Column:
    """The date in the boxes of a form, after their labels day, month and year: the first three figures that are a date, with a whole year before a short one."""
    bare = F.regexp_replace(F.coalesce(_c(text), F.lit("")), ACCOUNT_FIGURES, " ")
    flat = F.regexp_replace(F.trim(F.regexp_replace(bare, "\\s+", " ")), O_FOR_ZERO, "0")
    pieces = F.split(F.regexp_replace(flat, f"({BOX_LABELS})", "$1\u0001"), "\u0001")
    n = F.size(pieces)

    def found(shape: str, century: int) -> Column:
        def after(k: Column) -> Column:
            reach = F.substring(F.array_join(F.slice(pieces, k + 1, F.greatest(n - k, F.lit(1))), ""), 1, BOX_REACH)

            def at(i: Column) -> Column:
                here = F.substr(reach, i)
                free = (i == 1) | ~F.substr(reach, i - 1, F.lit(1)).rlike("\\d")
                part = lambda g: F.regexp_extract(here, f"^{shape}", g)
                return F.when(free & (part(1) != ""), _possible(part(1), part(2).try_cast("int"), (part(3).try_cast("int") + century), today))

            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(reach), F.lit(1))), at)

        every = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), after)))
        return F.get(F.filter(every, lambda d: d.isNotNull()), F.lit(0))

    return F.coalesce(found("(\\d{1,2})\\W{1,6}(\\d{1,2})\\W{1,6}((?:19|20)\\d{2})(?!\\d)", 0), found("(\\d{1,2})\\W{1,6}(\\d{1,2})\\W{1,6}(\\d{2})(?!\\d)", 2000))


def page_date(text: str | Column, today: date) -> Column:
    """The date of a single page: its letterhead's, else its boxes', else its latest own one."""
    return F.coalesce(letterhead_date(text, today), boxed_date(text, today), F.array_max(own_dates(text, today)))


def issue_date(text: str | Column, today: date) -> Column:
    """The date of a decision from its closing formula: the day in figures or words, the month by its first five letters, the year there or in the heading."""
    flat = F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(_c(text), F.lit("")))), "\\s+", " "))
    heading = F.nullif(F.regexp_extract(flat, YEAR_OF_HEADING, 1), F.lit(""))
    part = lambda g: F.regexp_extract_all(flat, F.lit(GIVEN), F.lit(g))
    days = F.create_map(*[F.lit(v) for k, d in DAY_WORDS.items() for v in (k, d)])
    roots = F.create_map(*[F.lit(v) for k, m in MONTHS.items() for v in (k[:5], m)])

    def day(t: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(t, "[^A-Z ]", " "), " "), lambda w: w != "")
        figure = F.regexp_extract(t, "\\(\\s*(\\d{1,2})\\s*\\)|\\b(\\d{1,2})\\b", 0)
        threes = F.transform(words, lambda w, i: F.try_element_at(days, F.array_join(F.slice(words, i + 1, 3), " ")))
        ones = F.transform(words, lambda w: F.try_element_at(days, w))
        first = lambda a: F.get(F.filter(a, lambda d: d.isNotNull()), F.lit(0))
        return F.coalesce(F.regexp_replace(figure, "\\D", "").try_cast("int"), first(threes), first(ones))

    def month(t: Column) -> Column:
        low = F.lower(t)
        return F.coalesce(F.try_element_at(roots, F.substring(low, 1, 5)), F.try_element_at(roots, F.substring(low, 1, 4)))

    def year(t: Column) -> Column:
        return F.nullif(F.regexp_extract(F.regexp_replace(t, "\\b2[.,]0(\\d{2})\\b", "20$1"), "\\b((?:19|20)\\d{2})\\b", 1), F.lit(""))

    hits = F.arrays_zip(part(1).alias("d"), part(2).alias("m"), part(3).alias("t"))
    dates = F.transform(hits, lambda h: F.coalesce(_possible(day(h["d"]), month(h["m"]), year(h["t"]), today), _possible(day(h["d"]), month(h["m"]), heading, today)))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def read_row_date(x: str | Column) -> Column:
    """struct(day DATE, precision): ISO, d/m/y with / . -, or a year alone."""
    t = F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))
    iso, dmy = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})(?:[ T].*)?$", "^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})$"
    build = lambda p, y, m, d: F.try_to_date(F.concat_ws("-", F.regexp_extract(t, p, y), F.lpad(F.regexp_extract(t, p, m), 2, "0"), F.lpad(F.regexp_extract(t, p, d), 2, "0")), "yyyy-MM-dd")
    day = F.when(t.rlike(iso), build(iso, 1, 2, 3)).when(t.rlike(dmy), build(dmy, 3, 2, 1)).when(t.rlike("^\\d{4}$"), F.try_to_date(F.concat(t, F.lit("-01-01")), "yyyy-MM-dd"))
    return F.struct(day.alias("day"), F.when(t.rlike("^\\d{4}$"), "year").otherwise("day").alias("precision"))


def month_of(x: str | Column) -> Column:
    return F.date_format(_c(x), "yyyy-MM")


def in_window(day: Column, of: Column) -> Column:
    return F.datediff(day, of).between(-DAYS_BEFORE, DAYS_AFTER)


def after_window(day: Column, of: Column) -> Column:
    return F.datediff(day, of) > DAYS_AFTER


def _differing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def differs_as_a_scan(a: Column, b: Column, precision: str = "day") -> Column:
    """One digit of the day or year apart, month equal; with year precision one digit of the year."""
    if precision == "year":
        return _differing(F.date_format(a, "yyyy"), F.date_format(b, "yyyy")) == 1
    return (F.month(a) == F.month(b)) & (_differing(F.date_format(a, "ddyyyy"), F.date_format(b, "ddyyyy")) == 1)


def window_of_name(x: str | Column) -> Column:
    """struct(low, high) of '2007-2009' in a name."""
    p = "((?:19|20)\\d{2})\\s*[-–a]\\s*((?:19|20)\\d{2})"
    n = lambda i: F.when(_c(x).rlike(p), F.regexp_extract(_c(x), p, i).cast("int"))
    return F.struct(n(1).alias("low"), n(2).alias("high"))
