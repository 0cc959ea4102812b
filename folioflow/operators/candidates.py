"""Codes that stand behind a word like 'resolución', from the words of a page.

Defined cases: pages without text have no candidates; repeated rows are rows of their own; lines are numbered from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import faculty_code
from ..functions.pages import candidate_score, capitals_share
from ..functions.text import _c, fold_confusions, maybe_within, normalise, osa_distance, parse_code, within_one_edit

# The heading's words, its short forms, the edits allowed, the least length, marks around a word.
TERMS = ("RESOLUCION", "RESOLUCIONES")
SHORT_FORMS = ("RESOL", "RES", "RSLN")
EDITS, LEAST_LENGTH = 2, 8
MARKS = ".,;:()[]\"'¡!¿?°º-–—_"
# What may stand between the word and the number, marks around a number, and what numbers look like.
SEPARATORS = ("N", "N°", "Nº", "N.", "NO", "NO.", "NE", "NRO", "NRO.", "NRO:", "NUM", "NUM.", "NUMERO", "#", ":", "-", "–", "—", ".", "·")
QUALIFIERS = ("INTERNA", "INTERNAS")
MARKS_OF_NUMBER = ",;()[]\"'_*?“”"
CODE = "^[A-Z0-9º°#][A-Z0-9/\\-.º°]*$"
GLUED = "^(?:NRO|NUM|N[º°O.]|#)\\.?\\d"
OFFICIAL = "^\\d{3,6}(?:[-/]\\d{4})?$"
LEAST_FIGURES, FIGURES = 2, 5
# Words that mark a citation, words that may stand with a heading's number, and where on the sheet a heading stands.
CITED = ("VISTO", "CONSIDERANDO", "MODIFICA", "MODIFICATORIA", "DEROGA", "RATIFICA", "SUSTITUYE", "AMPLIA", "COMPLEMENTA", "MEDIANTE", "APROBADA POR", "APROBADO POR", "CONFORME")
WITH_A_NUMBER = (
    "N", "NO", "NRO", "NUM", "NUMERO", "INTERNA", "INTERNAS", "DE", "DEL",
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "SETIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
)
HIGHEST, CENTRE = 0.30, (0.30, 0.75)


def anchors(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages' other columns with (line, token, word, term, distance, before, after, following, line_text, n_lines): each word like the heading's.

    before and after are the words around it on its line, following those of the next line. Short forms must be exact. Texts are read
    natively; only words that start like the heading and may be within the edits reach the exact distance.
    """
    keep = [c for c in pages.columns if c != text]
    parts = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    raw = F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "\\R$", ""), "\\R")
    x = pages.select(*keep, F.transform(raw, lambda r: F.struct(r.alias("raw"), parts(normalise(r)).alias("w"))).alias("_lines"))
    one = lambda s, i: F.struct(s["raw"].alias("raw"), s["w"].alias("w"), F.get("_lines", i + 1)["w"].alias("next"), F.size("_lines").alias("n"))
    x = x.select(*keep, F.posexplode(F.transform("_lines", one)).alias("line", "_l"))
    short = lambda f: f.isin(*SHORT_FORMS)
    maybe = lambda f: short(f) | (F.length(f) >= LEAST_LENGTH) & f.startswith("R") & (maybe_within(f, F.lit(TERMS[0]), EDITS) | maybe_within(f, F.lit(TERMS[1]), EDITS))
    words = F.transform("_l.w", lambda w, i: F.struct(i.alias("i"), F.btrim(w, F.lit(MARKS)).alias("word"), fold_confusions(F.btrim(w, F.lit(MARKS))).alias("f")))
    x = x.withColumn("_h", F.filter(words, lambda s: maybe(s["f"]))).select(*keep, "line", "_l", F.explode("_h").alias("_h"))
    f = F.col("_h.f")
    # most words are right, and need no exact distance
    exact = short(f) | f.isin(*TERMS)
    asked = F.when(~exact, f)
    x = x.withColumns({"_a": osa_distance(asked, F.lit(TERMS[0]), EDITS), "_b": osa_distance(asked, F.lit(TERMS[1]), EDITS)})
    x = x.filter(exact | (F.least("_a", "_b") <= EDITS))
    return x.select(
        *keep, "line", F.col("_h.i").alias("token"), F.col("_h.word").alias("word"),
        F.when(exact, f).when(F.col("_a") <= F.col("_b"), TERMS[0]).otherwise(TERMS[1]).alias("term"), F.when(exact, 0).otherwise(F.least("_a", "_b")).alias("distance"),
        F.slice("_l.w", 1, F.col("_h.i")).alias("before"), F.slice("_l.w", F.col("_h.i") + 2, F.size("_l.w")).alias("after"), F.coalesce("_l.next", F.array().cast("array<string>")).alias("following"),
        F.col("_l.raw").alias("line_text"), F.col("_l.n").alias("n_lines"),
    )


def with_first_code(rows: DataFrame, words: str, code: str, announced: str) -> DataFrame:
    """rows with the code that an array of words starts with and whether a numbering word announced it; null where another word comes first."""
    w = F.col(words)
    separator = lambda x: x.isin(*SEPARATORS) | F.rtrim(x, F.lit(".:")).isin(*SEPARATORS)
    skipped = lambda x: (x == "") | x.isin(*QUALIFIERS) | separator(x)
    x = rows.withColumn("_bare", F.transform(w, lambda t: F.btrim(t, F.lit(MARKS_OF_NUMBER))))
    x = x.withColumn("_at", F.array_position(F.transform("_bare", lambda t: ~skipped(t)), True).cast("int"))
    before = F.slice("_bare", 1, F.greatest(F.col("_at") - 1, F.lit(0)))
    own, behind = F.get("_bare", F.col("_at") - 1), F.btrim(F.get(w, F.col("_at")), F.lit(MARKS_OF_NUMBER))
    broken = own.rlike("^0\\d*$") & behind.rlike("^\\d+$") & (F.length(own) + F.length(behind) == FIGURES)
    x = x.withColumns({"_said": F.exists(before, separator), "_internal": F.exists(before, lambda t: t.isin(*QUALIFIERS)), "_own": F.when(F.col("_at") > 0, F.when(F.coalesce(broken, F.lit(False)), F.concat(own, behind)).otherwise(own))})
    x = x.withColumn("_n", faculty_code("_own", F.slice(w, F.greatest(F.col("_at"), F.lit(0)) + 1, 2), F.col("_internal")))
    fits = ~(F.col("_internal") & F.col("_n").rlike("^(?:19|20)\\d{2}$")) & F.col("_n").rlike(CODE) & (F.length(F.regexp_replace("_n", "\\D", "")) >= LEAST_FIGURES)
    x = x.withColumn(code, F.when(fits, parse_code("_n")))
    x = x.withColumn(announced, F.col("_said") | F.col("_own").rlike(GLUED) | (F.length("_n") > F.length(code)))
    return x.drop("_bare", "_at", "_said", "_internal", "_own", "_n")


def code_candidates(pages: DataFrame, text: str = "text") -> DataFrame:
    """anchors() with the code behind each, on its line or else at the start of the next, and official: announced, and shaped like a heading's number."""
    x = with_first_code(with_first_code(anchors(pages, text), "after", "_c1", "_a1"), "following", "_c2", "_a2")
    # a column that is not deterministic keeps the filter from being pushed below, and so repeating, the reading of codes
    x = x.withColumns({"code": F.coalesce("_c1", "_c2"), "announced": F.when(F.col("_c1").isNotNull(), F.col("_a1")).otherwise(F.col("_a2")), "_row": F.monotonically_increasing_id()})
    x = x.filter("code IS NOT NULL AND _row >= 0")
    return x.withColumn("official", F.col("announced") & F.col("code").rlike(OFFICIAL)).drop("_c1", "_c2", "_a1", "_a2", "following", "_row")


def scored(found: DataFrame, top: str | None = None, centre: str | None = None) -> DataFrame:
    """code_candidates() with cited, score, opens and arguable (only the number's announcement may be missing).

    A heading opens a unit if it has the official form, no word stands before it, nothing but a date behind it (one misread letter a word
    is forgiven), it is not cited, and, where the sheet's geometry is known (top and centre, shares of the page), it stands high and centred.
    """
    before, after = F.array_join("before", " "), F.array_join("after", " ")
    others = F.regexp_extract_all(after, F.lit("(\\p{L}+)"), F.lit(1))
    allowed = F.array(*[F.lit(w) for w in WITH_A_NUMBER])
    alone = F.forall(others, lambda w: w.isin(*WITH_A_NUMBER) | F.exists(allowed, lambda a: within_one_edit(w, a)))
    place = F.lit(True)
    if top and centre:
        place = F.coalesce((F.col(top) <= HIGHEST) & F.col(centre).between(*CENTRE), F.lit(True))
    x = found.withColumn("cited", F.exists(F.array(*[F.lit(m) for m in CITED]), lambda m: F.contains(before, m)))
    words = F.size(F.filter(F.split("line_text", "\\s+"), lambda w: w != ""))
    score = candidate_score(F.col("line"), F.greatest(F.col("n_lines"), F.lit(2)), capitals_share("line_text"), words, F.col("official"), F.col("cited"))
    free = ~before.rlike("\\p{L}") & place & ~F.col("cited")
    return x.withColumns({"score": score, "arguable": free, "opens": F.col("official") & free & alone})


def of_pages(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, candidates): those of each page in reading order, as the choice of a page's code takes them. A page's headings are few."""
    one = F.struct("line", "token", "code", "score", "opens", "arguable")
    bare = lambda s: F.struct(s["code"].alias("code"), s["score"].alias("score"), s["opens"].alias("opens"), F.lit(False).alias("annex"), s["arguable"].alias("arguable"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(one)), bare).alias("candidates"))
