"""Words of names, student codes, corner folios and codes read from handwriting, as column expressions."""

from __future__ import annotations

from difflib import get_close_matches

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip_accents

# Words between names, beginnings of two consonants, short words of names, offices that file, confusions of a hand.
CONNECTORS = "DE DEL LA LAS LOS Y SAN SANTA VDA VIUDA".split()
BEGINNINGS = "BL BR CH CL CR DR FL FR GL GR LL PL PR TR TH SH RH KR WH ST SC SP KH GH PH JH DH".split()
SHORT_WORDS = ["MA"]
OFFICES = "3110 3120 4310 2310 2311 2320 8671 8672 8673 8674 8675 9231 9232 9233 9234 8310".split()
HAND = {"0": "ODQU", "1": "IL|/T", "2": "Z", "5": "S", "6": "G", "7": "PDT", "8": "B"}
HAND_CONFUSION, HAND_D_FOR_10, HAND_OTHER = 0.5, 0.5, 1.0


def doubtful_name_word(x: str | Column) -> Column:
    """Whether an upper-case word has a shape that no name has."""
    w = _c(x)
    two = ~w.rlike("^[AEIOUY]") & ~F.substring(w, 2, 1).rlike("[AEIOUY]") & ~F.substring(w, 1, 2).isin(BEGINNINGS)
    shape = (F.length(w) <= 2) | ~w.rlike("[AEIOUY]") | w.rlike("(.)\\1\\1") | w.rlike("[^AEIOUY]{4,}") | two | w.rlike("J[^AEIOUH]|Q[^U]|Q$")
    return ~w.isin(CONNECTORS + SHORT_WORDS) & shape


def possible_name_word(x: str | Column) -> Column:
    """Whether a word can be one of a name: a vowel, no letter thrice, no five consonants, not filling made of three or four letters."""
    w = _c(x)
    kinds = F.size(F.array_distinct(F.filter(F.split(w, ""), lambda ch: ch != "")))
    filling = (F.length(w) >= 7) & (kinds <= 3) | (F.length(w) >= 9) & (kinds <= 4)
    plain = (F.length(w) >= 2) & w.rlike("[AEIOU]") & ~filling & ~w.rlike("(.)\\1\\1") & ~w.rlike("[^AEIOUY]{5,}")
    return w.isin(CONNECTORS) | plain


def name_quality(words: str | Column, known: Column) -> Column:
    """2 for each known word, 0.5 for a possible one, -2 for an impossible one; connectors and single letters count nothing."""
    value = lambda w: F.when(w.isin(CONNECTORS) | (F.length(w) < 2), 0.0).when(F.array_contains(known, w), 2.0).when(possible_name_word(w), 0.5).otherwise(-2.0)
    return F.aggregate(_c(words), F.lit(0.0), lambda a, w: a + value(w))


def code_year(x: str | Column, since: int = 1950) -> Column:
    """The year of entry that a student's code says beyond doubt."""
    c = _c(x)
    year = lambda at, n: F.substring(c, at, n).try_cast("int")
    nine, ten = 1900 + year(3, 2), year(3, 4)
    return F.when(F.length(c) == 6, 1900 + year(1, 2)).when((F.length(c) == 9) & (nine >= since), nine).when((F.length(c) == 10) & ten.between(since, 2099), ten)


def corner_folio(text: str | Column, page: str | Column) -> Column:
    """The folio written in a page's corner: the last number with a bar and a v, else the last number; a page number in front of it is taken off."""
    t, p = F.coalesce(_c(text), F.lit("")), _c(page).cast("string")
    barred = F.regexp_extract_all(t, F.lit("(\\d{1,4})\\s*[/|]\\s*[vVuU1lIi0oO]"), F.lit(1))
    plain = F.regexp_extract_all(t, F.lit("\\d{1,4}"), F.lit(0))
    read = F.when(F.size(barred) > 0, F.element_at(barred, -1)).when(F.size(plain) > 0, F.element_at(plain, -1))
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    clean = F.when(bare(read) == "", read).otherwise(bare(read))
    glued = p.isNotNull() & clean.startswith(p) & (F.length(clean) > F.length(p))
    return F.when(glued, F.nullif(bare(F.substr(clean, F.length(p) + 1)), F.lit(""))).otherwise(clean)


def _letters(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(code points, padded with 0, lengths) of a series of strings."""
    size = x.str.len().to_numpy().astype(np.int64)
    out = np.zeros((len(x), int(size.max(initial=0))), np.int32)
    for i, t in enumerate(x):
        out[i, : len(t)] = [ord(c) for c in t]
    return out, size


def hand_distances(read: pd.Series, printed: pd.Series) -> np.ndarray:
    """hand_distance() of a batch: each cell of the table is computed for all pairs at once."""
    (a, n), (b, m) = _letters(read), _letters(printed)
    likes = np.zeros((128, 128), bool)
    for digit, letters in HAND.items():
        likes[[ord(c) for c in letters], ord(digit)] = True
    d = np.zeros((a.shape[1] + 1, b.shape[1] + 1, len(read)))
    d[:, 0] = np.arange(a.shape[1] + 1)[:, None] * HAND_OTHER
    d[0] = np.arange(b.shape[1] + 1)[:, None] * HAND_OTHER
    for i in range(1, a.shape[1] + 1):
        x = a[:, i - 1]
        for j in range(1, b.shape[1] + 1):
            y = b[:, j - 1]
            alike = (x < 128) & (y < 128) & likes[np.minimum(x, 127), np.minimum(y, 127)]
            cost = np.where(x == y, 0.0, np.where(alike, HAND_CONFUSION, HAND_OTHER))
            best = np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]) + HAND_OTHER, d[i - 1, j - 1] + cost)
            if j > 1:
                ten = (x == ord("D")) & (b[:, j - 2] == ord("1")) & (y == ord("0"))
                best = np.where(ten, np.minimum(best, d[i - 1, j - 2] + HAND_D_FOR_10), best)
            d[i, j] = best
    return d[n, m, np.arange(len(read))]


def hand_distance(read: str | Column, printed: str | Column) -> Column:
    """Edit distance of a hand-written code to printed digits, where letters that a hand makes of a digit cost half, and a D for 10. Null if either is."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        both = a.notna() & b.notna()
        out = pd.Series([None] * len(a), dtype="float64")
        if both.any():
            out[both.to_numpy()] = hand_distances(a[both], b[both])
        return out

    return run(_c(read), _c(printed))


def checked_hand_code(code: str | Column, stamped: str | Column, offices: Column | None = None, sure: Column | None = None) -> Column:
    """struct(value, reason) of a filing code read from a hand-written stamp.

    Its year is the stamp's or the one before; its office files, or is one digit from a single one that does (of several, from the only one
    of the box), or two readers agree on it (sure).
    """
    v, box = F.upper(F.coalesce(_c(code), F.lit(""))), offices if offices is not None else F.array().cast("array<string>")
    office, year = F.substring(v, 3, 4), F.substring(v, 7, 4).try_cast("int")
    valid = F.array_sort(F.array_union(F.array(*map(F.lit, OFFICES)), box))
    apart = lambda o: F.size(F.filter(F.zip_with(F.split(o, ""), F.split(office, ""), lambda p, q: p != q), lambda d: d))
    near = F.filter(valid, lambda o: (F.length(o) == 4) & (apart(o) == 1))
    own = F.array_intersect(near, box)
    one = F.when(F.size(near) == 1, F.get(near, F.lit(0))).when((F.size(near) > 1) & (F.size(own) == 1), F.get(own, F.lit(0)))
    whole = v.rlike("^RE\\d{13}$")
    late = _c(stamped).isNotNull() & ~year.isin(0) & (year != F.year(_c(stamped))) & (year != F.year(_c(stamped)) - 1)
    out = lambda value, reason: F.struct(value.cast("string").alias("value"), F.lit(reason).alias("reason"))
    agreed = sure if sure is not None else F.lit(False)
    return (
        F.when(~whole, out(F.lit(None), "not whole"))
        .when(late, out(F.lit(None), "another year"))
        .when(F.array_contains(valid, office), out(v, ""))
        .when(agreed, out(v, "unknown office, read alike"))
        .when(one.isNotNull(), out(F.concat(F.lit("RE"), one, F.substring(v, 7, 9)), "office corrected"))
        .otherwise(out(F.lit(None), "no such office"))
    )


# Words of a name that don't count, their least length, other words between them, words that may be missing, likeness of two words.
PARTICLES = ("DE", "DEL", "LA", "LAS", "LOS", "Y", "E", "SAN", "SANTA", "VDA", "VIUDA")
LEAST_WORD, BETWEEN_WORDS, MISSING, ALIKE = 3, 4, 1, 0.8


def _together(words: list[str], tokens: list[str]) -> bool:
    """Whether enough of the words, or words like them, stand around one like the first."""
    known = set(tokens)

    def like(w: str) -> set[str]:
        return {w} if w in known else set(get_close_matches(w, [t for t in known if t[0] == w[0] and abs(len(t) - len(w)) <= 2], 3, ALIKE))

    alike = [like(w) for w in words]
    needed, width = len(words) - (MISSING if len(words) >= 3 else 0), len(words) + BETWEEN_WORDS
    around = (set(tokens[max(0, i - width + 1) : i + width]) for i, t in enumerate(tokens) if t in alike[0])
    return any(sum(not a.isdisjoint(near) for a in alike) >= needed for near in around)


def name_in_text(name: str | Column, text: str | Column) -> Column:
    """Whether the words of a name stand together in a text, with a misread letter in each and one of three or more, but not the first, missing.

    Names without a word that counts are in any text. Names that stand there as they are, and texts without a word that starts like the
    first, are told natively; the rest is compared in batches.
    """
    plain = lambda x: F.filter(F.split(F.regexp_replace(F.upper(strip_accents(F.coalesce(_c(x), F.lit("")))), "[^A-Z0-9]+", " "), " "), lambda w: w != "")
    words, tokens = F.filter(plain(name), lambda w: (F.length(w) >= LEAST_WORD) & ~w.isin(*PARTICLES)), plain(text)
    first = F.get(words, F.lit(0))
    spaced = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    there = F.contains(spaced(tokens), spaced(words))
    maybe = F.exists(tokens, lambda t: (F.substring(t, 1, 1) == F.substring(first, 1, 1)) & (F.abs(F.length(t) - F.length(first)) <= 2))

    @F.pandas_udf("boolean")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _together(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="boolean")

    asked = (F.size(words) > 0) & ~there & maybe
    return F.when((F.size(words) == 0) | there, True).otherwise(F.coalesce(compare(F.when(asked, words), F.when(asked, tokens)), F.lit(False)))
