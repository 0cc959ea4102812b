"""Names of the files of a delivery: what a unit is and its number, within a length; folders and sheets by their document.

Nulls: a title or kind that is null is not known; a null code has no name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, slug, strip_accents

# Separators, words, lengths.
BETWEEN, WITH_TITLE = "_", "__"
RESOLUTION, DOCUMENT, WITHOUT_CODE = "RESOLUCION", "DOCUMENTO", "sin-codigo"
MOST_OF_CODE, MOST_OF_TITLE, MOST_OF_FOLDER, PATH = 40, 60, 60, 255
LEAST_TITLE, LEAST_KIND, LEAST_STEM = 12, 8, 8


def code_part(code: str | Column) -> Column:
    s = slug(code, MOST_OF_CODE)
    return F.when(s == "", WITHOUT_CODE).otherwise(s)


def kind_part(kind: str | Column) -> Column:
    """'Notificación por aviso' -> 'NOTIFICACION-POR-AVISO'."""
    s = F.regexp_replace(F.regexp_replace(F.upper(strip_accents(kind)), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", DOCUMENT).otherwise(s)


def without_extension(name: str | Column) -> Column:
    return F.regexp_replace(_c(name), "\\.[A-Za-z0-9]{1,5}$", "")


def resolution_name(code: str | Column, extension: str = ".pdf") -> Column:
    return F.concat(F.lit(RESOLUTION + BETWEEN), code_part(code), F.lit(extension))


def kind_name(code: str | Column, kind: str | Column, title: str | Column | None = None, budget: int | None = None, extension: str = ".pdf") -> Column:
    """code_title_KIND: the title only where it is asked for. Beyond the budget the title is cut first, then the kind, never the code."""
    c, label = code_part(code), kind_part(kind)
    who = F.lit("")
    if title is not None:
        t = slug(F.coalesce(_c(title), F.lit("")), MOST_OF_TITLE)
        # a code that is the name already is not said twice
        who = F.when(F.startswith(t, F.lower(c)), F.regexp_replace(F.substring(t, F.length(c) + 1, F.length(t)), "^[-_]+|[-_]+$", "")).otherwise(t)
    fits = F.lit(True)
    if budget is not None:
        room = budget - F.length(c) - len(BETWEEN) - len(extension)
        left = room - F.length(label) - len(BETWEEN)
        who = F.when(left < LEAST_TITLE, "").when(F.length(who) > left, slug(who, left)).otherwise(who)
        label = F.when(F.length(label) > room, F.regexp_replace(F.substring(label, F.lit(1), F.greatest(room, F.lit(0))), "[ .-]+$", "")).otherwise(label)
        fits = room >= LEAST_KIND
    parts = F.when(fits, F.concat_ws(BETWEEN, c, F.nullif(who, F.lit("")), label)).otherwise(c)
    return F.concat(parts, F.lit(extension))


def title_name(code: str | Column, title: str | Column, budget: int | None = None, extension: str = ".pdf") -> Column:
    """code__title, the title cut to what the budget leaves, or left out."""
    c, t = code_part(code), slug(F.coalesce(_c(title), F.lit("")), MOST_OF_TITLE)
    if budget is not None:
        room = budget - F.length(c) - len(WITH_TITLE) - len(extension)
        t = F.when(room < LEAST_TITLE, "").when(F.length(t) > room, slug(t, room)).otherwise(t)
    return F.concat(F.concat_ws(WITH_TITLE, c, F.nullif(t, F.lit(""))), F.lit(extension))


def folder_name(document: str | Column, fallback: str = "documento") -> Column:
    """The folder of what came out of a document: its name without extension and without what a file system refuses."""
    ends = lambda x: F.btrim(x, F.lit(" ."))
    s = ends(F.regexp_replace(F.regexp_replace(without_extension(document), '[\\\\/:*?"<>|]+', " "), "\\s+", " "))
    s = ends(F.substring(s, 1, MOST_OF_FOLDER))
    return F.when(s == "", fallback).otherwise(s)


def sheet_name(document: str | Column, suffix: str, folder_length: int = 0, fallback: str = "inventario") -> Column:
    """The workbook of a document: its bare name, cut to what the path leaves, and the suffix, which is never cut."""
    room = PATH - folder_length - len(suffix) - 1
    if room < LEAST_STEM:
        return F.lit(fallback + suffix)
    stem = F.trim(without_extension(F.regexp_replace(_c(document), "^.*[\\\\/]", "")))
    stem = F.when(F.length(stem) > room, F.regexp_replace(F.substring(stem, 1, room), "[ ._-]+$", "")).otherwise(stem)
    return F.concat(F.when(stem == "", fallback).otherwise(stem), F.lit(suffix))
