"""Identity numbers, filing codes and two or three readings of one number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import _differing
from .text import _c, fold_confusions

Z = {0.90: 1.6449, 0.95: 1.96, 0.99: 2.5758}


def digits(x: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^0-9]", "")


def filing_codes(text: str | Column) -> Column:
    """RE + 13 digits and P + 13 digits, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.upper(_c(text)), F.lit("\\b((?:RE|P)\\d{13})(?!\\d)"), F.lit(1)))


def one_digit_apart(a: Column, b: Column) -> Column:
    return (a != b) & (F.length(a) == F.length(b)) & (F.substring(a, 1, 2) == F.substring(b, 1, 2)) & (_differing(a, b) == 1)


def plausible_form(x: str | Column) -> Column:
    """6 to 10 characters that don't start with 0; null stays null."""
    return F.length(_c(x)).between(6, 10) & ~_c(x).startswith("0")


def plausible_id(x: str | Column) -> Column:
    """Whether the figures have a number's form and are not one figure again and again."""
    d = digits(x)
    return plausible_form(d) & ~d.rlike("^(\\d)\\1+$")


def reconcile_two(first: Column, second: Column) -> Column:
    """struct(value, doubt): the second fills or agrees; the first stays where they differ."""
    agree = second.isNull() | (second == "") | F.coalesce(second == first, F.lit(False))
    empty = first.isNull() | (first == "")
    return F.struct(F.when(~agree & empty, second).otherwise(first).alias("value"), (~agree & ~empty).alias("doubt"))


def break_tie(first: Column, second: Column, third: Column) -> Column:
    """struct(value, doubt) of three readings: two of three win, else the first stays in doubt."""
    two = reconcile_two(first, second)
    with_second = two["doubt"] & F.coalesce(third == second, F.lit(False))
    settled = two["doubt"] & (F.coalesce(third == first, F.lit(False)) | with_second)
    return F.struct(F.when(with_second, second).otherwise(two["value"]).alias("value"), (two["doubt"] & ~settled).alias("doubt"))


def repair_code(x: str | Column) -> Column:
    """A filing code whose figures were read as letters; null unless one reading is left."""
    v = F.translate(F.upper(F.regexp_replace(_c(x), "[\\s.-]", "")), "", "")
    body = F.translate(F.substring(v, 3, 20), "OQDILSBGZ", "000115862")
    return F.when(F.substring(v, 1, 2).isin("RE", "BE", "PE") & body.rlike("^\\d{13}$"), F.concat(F.lit("RE"), body))


def faculty_code(number: str | Column, following: Column, internal: Column | None = None) -> Column:
    """A faculty's number in one form, NNN-YYYY: three figures and the whole year, which may stand in the words that follow.

    Without a year in sight only numbers of two figures or more are filled up; other numbers stay.
    """
    n = _c(number)
    shape = "^(?:NRO|NUM|N[º°O.]*|#)?(\\d{1,3})(?:[-–]{1,2}(\\d{4}|\\d{2}))?[-–]?$"
    own = F.nullif(F.regexp_extract(n, shape, 2), F.lit(""))
    rest = F.transform(F.slice(following, 1, 2), lambda w: F.btrim(w, F.lit(",;.()")))
    of = F.coalesce(F.get(rest, F.lit(0)) == "DE", F.lit(False))
    next_ = F.when(of, F.get(rest, F.lit(1))).otherwise(F.get(rest, F.lit(0)))
    told = of | n.rlike("[-–]$") | (internal if internal is not None else F.lit(False)) | F.coalesce(next_.rlike("^[-–]"), F.lit(False))
    behind = F.nullif(F.regexp_extract(F.coalesce(next_, F.lit("")), "^(?:[-–]{0,2}((?:19|20)\\d{2})|[-–]{1,2}(\\d{2}))$", 0), F.lit(""))
    year = F.coalesce(own, F.when(told, F.regexp_replace(behind, "[-–]", "")))
    whole = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    digits_ = F.regexp_extract(n, shape, 1)
    padded = F.lpad(digits_, 3, "0")
    return F.when(~n.rlike(shape), n).when(whole.isNotNull(), F.concat_ws("-", padded, whole)).when(F.length(digits_) >= 2, padded).otherwise(n)


def account_number(text: str | Column) -> Column:
    """The customer account that a page names."""
    return F.nullif(F.regexp_extract(F.upper(_c(text)), "\\b(?:NIC|CUENTA INTERNA NO\\.?)\\W{0,4}(\\d{6,8})\\b", 1), F.lit(""))


def document_number(text: str | Column) -> Column:
    """struct(series, number) of a numbered heading such as 'FV 00123'."""
    p = "^\\s*([A-Z]{1,4})[\\s-]*0*(\\d{1,9})\\b"
    return F.struct(F.nullif(F.regexp_extract(_c(text), p, 1), F.lit("")).alias("series"), F.when(_c(text).rlike(p), F.regexp_extract(_c(text), p, 2).cast("long")).alias("number"))


def looks_equal(a: Column, b: Column) -> Column:
    return fold_confusions(a) == fold_confusions(b)


def wilson(errors: Column, n: Column, level: float = 0.95) -> Column:
    """struct(low, high) of the share of errors."""
    n = F.greatest(n, F.lit(1))
    z, p = Z[level], errors / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    radius = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(F.greatest(F.lit(0.0), centre - radius).alias("low"), F.least(F.lit(1.0), centre + radius).alias("high"))


def margin(errors: Column, doubtful: Column, n: Column, limit: float = 0.05, level: float = 0.95) -> Column:
    """struct(low, high, worst, verdict): inside, outside or uncertain; doubtful cases count as errors in the worst case."""
    e = F.least(F.greatest(errors, F.lit(0)), n)
    d = F.least(F.greatest(doubtful, F.lit(0)), n - e)
    w, worst = wilson(e, n, level), wilson(e + d, n, level)["high"]
    verdict = F.when(n == 0, "uncertain").when(w["low"] > limit, "outside").when((w["high"] <= limit) & ((d == 0) | (worst <= limit)), "inside").otherwise("uncertain")
    return F.struct(w["low"].alias("low"), w["high"].alias("high"), worst.alias("worst"), verdict.alias("verdict"))
