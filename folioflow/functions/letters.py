"""Letters: their subject line, whether a page opens or goes on with one, and whether two pages are the same letter.

Null texts are empty: they have no subject, open nothing and go on with nothing.
"""

from __future__ import annotations

from datetime import date
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import page_date
from .text import _c, normalise

# Lines of a letter's head, of a subject below its word, and looked at for a continuation; repeated heads; letters of a subject and of
# its key; words of prose and of a phrase, its share of lower-case words; likeness of copies; characters of a subject line.
HEAD, HEAD_OF_SUBJECT, TOP, HEADINGS = 30, 20, 7, 3
LEAST_LETTERS, KEY = 12, 90
PROSE, PHRASE, LOWER_SHARE = 5, 8, 0.7
LIKENESS = 0.9
MOST_OF_SUBJECT = 120
# What announces an addressee, lines below it and of a signature, least length of a name, and words that no addressee or signature has.
ADDRESSEE = ("Señores:", "Señor:", "Destinatario:")
BELOW, SIGNATURE, LONGER_THAN = 8, 10, 10
NOT_A_NAME = ("OFICINA", "CIUDAD", "FECHA", "ASUNTO", "REF:", "REFERENCIA", "NIC", "ATENTAMENTE")
NOT_A_SIGNATURE = ("ATENTAMENTE", "CORDIALMENTE", "NOTIFICACIONES", "FIRMA")
# What a subject, its word alone, a stamp's subject, a greeting, a section and a numeral look like.
SUBJECT = r"(?i)^\W{0,3}(?:REF(?:ERENCIA)?|ASUNTO)\s*[.:;!]{1,3}\s*(.*)$"
SUBJECT_ALONE = r"^\W{0,3}(?:Asunto|ASUNTO)\W{0,3}$"
SUBJECT_OF_STAMP = r"(?i)^[O0]?\d{1,2}\s+[A-Z]"
REFERENCE = r"(?i)^\W*REFERENCIA\W*"
GREETING = r"(?i)^\W*(?:SE[ÑNñ]OR(?:ES|A|ITA)?|DOCTOR(?:A)?|GERENTE|DR\.|SRES?\.)(?!\p{L})"
SECTION = r"^(?:PETI\w{1,6}|PRETENSI\w{1,6}|HECHOS|FUNDAMENTOS?\b|SOLICITUDES)\b"
NUMERAL = r"^(?:\d{1,2}|[a-h])\s*[).-]\s*\S"
SUBJECT_LINE = r"(?i)^(?:asunto|referencia|ref)\s*[:.]\s*(.{3,120})"


def lines(text: str | Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\\R"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")


def _letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^\\p{L}]", ""))


def _flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(normalise(x), "[^\\x00-\\x7F]", ""))


def subject_line(text: str | Column) -> Column:
    """What a page says behind 'Asunto:' or 'Ref.:' at the start of a line, in its own words; null without."""
    found = F.transform(F.filter(lines(text), lambda x: x.rlike(SUBJECT_LINE)), lambda x: F.regexp_replace(F.regexp_extract(x, SUBJECT_LINE, 1), "\\s+", " "))
    bare = F.transform(found, lambda x: F.rtrim(F.ltrim(x, F.lit(":.-— ")), F.lit(" .,;:")))
    return F.rtrim(F.substring(F.get(F.filter(bare, lambda x: F.length(x) >= 3), F.lit(0)), 1, MOST_OF_SUBJECT))


def subject_of_letter(text: str | Column) -> Column:
    """struct(at, subject): the line of a letter's subject and the subject with the line that goes on with it; null without."""
    head = F.slice(lines(text), 1, HEAD)
    after = lambda i, n: F.array_join(F.slice(head, i + 2, n), " ")
    stamp = lambda x: _flat(x).rlike(SUBJECT_OF_STAMP)
    long_enough = lambda x: _letters(x) >= LEAST_LETTERS

    def one(x: Column, i: Column) -> Column:
        rest = F.regexp_extract(x, SUBJECT, 1)
        own = F.trim(F.concat_ws(" ", rest, after(i, 1)))
        below = F.trim(F.regexp_replace(after(i, 2), REFERENCE, ""))
        told = F.when(x.rlike(SUBJECT), F.when(~stamp(F.trim(rest)) & long_enough(own), own)).when(x.rlike(SUBJECT_ALONE) & (i < HEAD_OF_SUBJECT) & long_enough(below) & ~stamp(below), below)
        return F.when(told.isNotNull(), F.struct(i.alias("at"), told.alias("subject")))

    return F.get(F.filter(F.transform(head, one), lambda s: s.isNotNull()), F.lit(0))


def with_letter(rows: DataFrame, text: str, today: date) -> DataFrame:
    """rows with letter: struct(subject, key, day) of a page that opens a letter, that is a subject below a greeting or a date; null for other pages.

    key is what two readings of a copy share: the first KEY letters of the subject. Steps are columns of their own, as each is used several times.
    """
    x = rows.withColumn("_found", subject_of_letter(text))
    x = x.withColumn("_before", F.when(F.col("_found").isNotNull(), F.slice(lines(text), 1, F.coalesce(F.col("_found.at"), F.lit(0)))))
    x = x.withColumn("_day", page_date(F.array_join("_before", "\n"), today))
    opens = F.exists("_before", lambda x: x.rlike(GREETING)) | F.col("_day").isNotNull()
    key = F.substring(F.regexp_replace(_flat(F.col("_found.subject")), "[^A-Z]+", ""), 1, KEY)
    x = x.withColumns({"letter": F.when(opens, F.struct(F.col("_found.subject").alias("subject"), key.alias("key"), F.col("_day").alias("day"))), "_row": F.monotonically_increasing_id()})
    # a column that is not deterministic keeps the caller's filters from being pushed below, and so repeating, the steps
    return x.filter("_row >= 0").drop("_found", "_before", "_day", "_row")


def continues_letter(text: str | Column, opens: Column) -> Column:
    """Whether a page starts in the middle of a letter: its first legible line, past repeated headings, is a section, a numeral or prose."""
    start = F.struct(F.lit(None).cast("boolean").alias("verdict"), F.lit(0).alias("headings"))

    def prose(x: Column) -> Column:
        words = F.regexp_extract_all(x, F.lit("(\\p{L}{2,})"), F.lit(1))
        rest = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
        phrase = (F.size(words) >= PHRASE) & F.coalesce(F.get(words, F.lit(0)).rlike("^\\p{Lu}\\p{Ll}+$"), F.lit(False))
        phrase &= F.size(F.filter(rest, lambda w: w.rlike("^\\p{Ll}"))) >= LOWER_SHARE * F.size(rest)
        return F.when(x.rlike("^\\p{Ll}"), F.size(words) >= PROSE).otherwise(phrase)

    def step(s: Column, line: Column) -> Column:
        x = F.ltrim(line, F.lit(" \"'«“¿¡-–—•·*"))
        state = lambda v, h: F.struct(v.alias("verdict"), h.alias("headings"))
        heading = (F.upper(x) == x) & (s["headings"] < HEADINGS)
        return (
            F.when(s["verdict"].isNotNull() | (_letters(line) < 4), s)
            .when(_flat(x).rlike(SECTION) | x.rlike(NUMERAL), state(F.lit(True), s["headings"]))
            .when(heading, state(F.lit(None).cast("boolean"), s["headings"] + 1))
            .otherwise(state(prose(x), s["headings"]))
        )

    return ~opens & F.coalesce(F.aggregate(F.slice(lines(text), 1, TOP), start, step)["verdict"], F.lit(False))


def same_letter(a: Column, b: Column) -> Column:
    """Whether two letters (struct key, day) are one: the same day and nearly the same subject; without one of the days, the very same subject."""

    @F.pandas_udf("double")
    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0.0 if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    dated = a["day"].isNotNull() & b["day"].isNotNull()
    # only pairs of one day are read by Python
    asked = F.when(dated & (a["day"] == b["day"]) & (a["key"] != b["key"]), a["key"])
    alike = (a["key"] == b["key"]) | (likeness(asked, b["key"]) >= LIKENESS)
    some = (a["key"] != "") & (b["key"] != "")
    return F.coalesce(some & F.when(dated, (a["day"] == b["day"]) & alike).otherwise(a["key"] == b["key"]), F.lit(False))


def sender(text: str | Column) -> Column:
    """Who a page is addressed to, else who signs it, up to a comma or semicolon; null without either."""
    rows = F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    has = lambda x, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))
    named = lambda x, but: (F.length(x) > LONGER_THAN) & x.rlike("^\\p{Lu}") & ~has(F.upper(x), but)
    below = F.transform(rows, lambda x, i: F.when(has(x, ADDRESSEE), F.filter(F.slice(rows, i + 2, BELOW), lambda y: named(y, NOT_A_NAME))).otherwise(F.array().cast("array<string>")))
    last = F.reverse(F.slice(rows, F.greatest(F.size(rows) - SIGNATURE + 1, F.lit(1)), SIGNATURE))
    found = F.coalesce(F.get(F.flatten(below), F.lit(0)), F.get(F.filter(last, lambda y: named(y, NOT_A_SIGNATURE)), F.lit(0)))
    return F.trim(F.get(F.split(found, "[;,]"), F.lit(0)))


def sender_key(name: str | Column) -> Column:
    """A sender for comparison: upper case, no accents, no marks; null for an empty one."""
    return F.nullif(normalise(F.regexp_replace(_c(name), "[^\\p{L}\\p{N}_\\s]", "")), F.lit(""))
