"""String functions as column expressions; edit distance as a vectorised UDF behind native prefilters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their plain forms.
MARKED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝáàâäãåéèêëíìîïóòôöõúùûüçñýÿ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUCNYaaaaaaeeeeiiiiooooouuuucnyy"

# Thresholds of a broken text layer.
LEAST_INTERIOR_CAPITALS = 10
LEAST_PER_THOUSAND = 11.0


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(x: str | Column) -> Column:
    return F.translate(_c(x), MARKED, PLAIN)


def strip_accents_keep_enye(x: str | Column) -> Column:
    marked = "".join(a for a in MARKED if a not in "Ññ")
    plain = "".join(b for a, b in zip(MARKED, PLAIN, strict=True) if a not in "Ññ")
    return F.translate(_c(x), marked, plain)


def normalise(x: str | Column) -> Column:
    """Upper case, no accents, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(x)), "\\s+", " "))


def normalised_lines(x: str | Column) -> Column:
    return F.transform(F.split(_c(x), "\\R"), normalise)


def name_key(x: str | Column) -> Column:
    """Upper case, accents off but Ñ kept, single blanks."""
    return F.trim(F.regexp_replace(F.upper(strip_accents_keep_enye(x)), "\\s+", " "))


def fold(x: str | Column) -> Column:
    """For search: lower case, no accents."""
    return F.lower(strip_accents(x))


def fold_confusions(x: str | Column) -> Column:
    """Letters that a scan reads as others, brought together."""
    return F.translate(F.replace(_c(x), F.lit("RN"), F.lit("M")), "01568|", "OISGBI")


def parse_code(x: str | Column) -> Column:
    """A code's value: upper case, no accents, numbering prefix, closing marks or blanks; null without a digit."""
    v = F.upper(strip_accents(F.trim(F.coalesce(_c(x), F.lit("")))))
    v = F.trim(F.regexp_replace(v, "^(?:N(?:O|RO|UM(?:ERO)?)?\\s*[.:°º]+\\s*)", ""))
    v = F.regexp_replace(F.regexp_replace(v, "[\\s.,;:]+$", ""), "\\s+", "")
    return F.when(v.rlike("[0-9]"), v)


def interior_capitals(x: str | Column) -> Column:
    return F.regexp_count(_c(x), F.lit("[a-záéíóúüñ][A-ZÁÉÍÓÚÜÑ]"))


def garble_score(x: str | Column) -> Column:
    """Interior capitals for each 1000 characters; 0 for an empty text."""
    return F.when(F.length(_c(x)) > 0, interior_capitals(x) * F.lit(1000.0) / F.length(_c(x))).otherwise(F.lit(0.0))


def is_garbled(x: str | Column) -> Column:
    return (interior_capitals(x) >= LEAST_INTERIOR_CAPITALS) & (garble_score(x) >= LEAST_PER_THOUSAND)


def slug(x: str | Column, most: int | Column = 60) -> Column:
    """Plain letters and figures joined by '-', cut between words where it would be longer than `most`."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    most = F.lit(most) if isinstance(most, int) else most
    cut = F.regexp_replace(F.regexp_replace(F.substring(whole, F.lit(1), most), "-[^-]*$", ""), "-+$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(cut)


def seconds_of(x: str | Column) -> Column:
    """'1 h 02 min 05 s' -> seconds; null without any part."""
    part = lambda unit: F.regexp_extract(_c(x), f"(\\d+)\\s*{unit}\\b", 1)
    n = lambda c: F.coalesce(F.expr("try_cast(null as int)") if c is None else F.when(c != "", c.cast("int")), F.lit(0))
    return F.when(_c(x).rlike("\\d+\\s*(h|min|s)\\b"), n(part("h")) * 3600 + n(part("min")) * 60 + n(part("s")))


def human_size(x: str | Column) -> Column:
    """Bytes with a decimal comma."""
    n = _c(x).cast("double")
    one = lambda v, unit: F.concat(F.replace(F.format_string("%.1f", F.bround(v, 1)), F.lit("."), F.lit(",")), F.lit(" " + unit))
    return F.when(n >= 1024.0**3, one(n / 1024.0**3, "GB")).when(n >= 1024.0**2, one(n / 1024.0**2, "MB")).when(n >= 1024.0, one(n / 1024.0, "KB")).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))


def natural_key(x: str | Column) -> Column:
    """Numbers in a name padded to ten digits, so that text order is number order."""
    parts = F.regexp_extract_all(fold(x), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 10, "0")).otherwise(p)), "")


def garbage_share(x: str | Column) -> Column:
    """Share of tokens that are neither a word, a number nor a code."""
    tokens = F.filter(F.split(F.trim(_c(x)), "\\s+"), lambda t: t != "")
    bad = F.filter(tokens, lambda t: ~t.rlike("^[\\p{P}]*(?:\\p{L}{2,}|\\d[\\d.,/-]*|[A-Z]{1,3}-?\\d+|[aeoyAEOY])[\\p{P}]*$"))
    return F.when(F.size(tokens) > 0, F.size(bad) / F.size(tokens)).otherwise(F.lit(0.0))


def has_looping_lines(x: str | Column, times: int = 4) -> Column:
    return _c(x).rlike(f"(?m)^(.+)$(?:\\R\\1$){{{times - 1},}}")


def number_in_text(number: str | Column, text: str | Column) -> Column:
    """Whether these figures stand in the text as a number of their own, with or without marks between figures."""
    digits = F.regexp_replace(F.coalesce(_c(number), F.lit("")), "[^0-9]", "")
    joined = F.regexp_replace(F.coalesce(_c(text), F.lit("")), "(?<=\\d)[\\s.,'’-](?=\\d)", "")
    return (digits != "") & F.regexp_like(joined, F.concat(F.lit("(?<!\\d)"), digits, F.lit("(?!\\d)")))


def search_terms(row: Column, query: str) -> Column:
    """All blank-separated terms of the query are substrings of the folded row text; marks such as % have no meaning."""
    terms = F.filter(F.split(fold(F.lit(query)), "\\s+"), lambda t: t != "")
    # the row is folded once, whatever the number of terms
    return F.get(F.transform(F.array(fold(row)), lambda r: F.forall(terms, lambda t: F.contains(r, t))), F.lit(0))


def osa(a: str, b: str, ceiling: int | None = None) -> int:
    """Optimal string alignment: edits and swaps of neighbours. Exact up to the ceiling, ceiling + 1 beyond."""
    if a == b:
        return 0
    if ceiling is not None and abs(len(a) - len(b)) > ceiling:
        return ceiling + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if ceiling is not None and min(row) > ceiling:
            return ceiling + 1
        before, last = last, row
    return last[-1] if ceiling is None else min(last[-1], ceiling + 1)


def osa_distance(a: Column, b: Column, ceiling: int | None = None) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q, ceiling) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def maybe_within(a: Column, b: Column, k: int) -> Column:
    """A native test that every pair within k edits passes: plain edit distance is at most twice as large."""
    return (F.abs(F.length(a) - F.length(b)) <= k) & (F.levenshtein(a, b) <= 2 * k)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one edit, or a swap of neighbours, at most makes a into b; native."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    edits = F.levenshtein(a, b)
    return F.when(edits <= 1, True).when((edits == 2) & (F.length(a) == F.length(b)) & (F.length(a) > 1), F.exists(F.sequence(F.lit(1), F.length(a) - 1), swapped)).otherwise(False)
