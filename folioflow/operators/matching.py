"""Joins that pair pages, rows, files and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import maybe_within, name_key, osa_distance


def page_hash(text: str | Column, least: int = 40) -> Column:
    """SHA-1 of the text with single blanks, if it has `least` characters; null otherwise."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\\s+", " "))
    return F.when(F.length(t) >= least, F.sha1(t))


def reconcile(source: DataFrame, delivered: DataFrame, hash: str = "hash") -> DataFrame:
    """Each delivered page (file, position, hash) with its source page: the k-th copy of a hash takes the k-th source page of it, and those beyond reuse the first."""
    s = source.filter(F.col(hash).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(hash).orderBy("page")))
    d = delivered.withColumn("_k", F.when(F.col(hash).isNotNull(), F.row_number().over(Window.partitionBy(hash).orderBy("file", "position"))))
    first = s.filter("_k = 1").select(hash, F.col("page").alias("_first"))
    x = d.join(s.select(hash, "_k", "page"), [hash, "_k"], "left").join(first, hash, "left")
    return x.select("file", "position", hash, F.coalesce("page", "_first").alias("page"), (F.col("page").isNull() & F.col("_first").isNotNull()).alias("reused"))


def missing_pages(source: DataFrame, matched: DataFrame) -> DataFrame:
    return source.join(matched.filter("page IS NOT NULL").select("page").distinct(), "page", "left_anti")


def check_written(expected: DataFrame, written: DataFrame) -> DataFrame:
    """(file, problem): unreadable, wrong length, or pages that differ by position; pages without a hash are not judged."""
    e = expected.groupBy("file").agg(F.count("*").alias("n_expected"))
    w = written.groupBy("file").agg(F.count("*").alias("n_written"))
    pairs = expected.join(written.withColumnRenamed("hash", "written_hash"), ["file", "position"])
    bad = pairs.groupBy("file").agg(F.count_if(F.col("hash") != F.col("written_hash")).alias("n_differ"))
    x = e.join(w, "file", "left").join(bad, "file", "left")
    problem = F.when(F.col("n_written").isNull(), "unreadable").when(F.col("n_written") != F.col("n_expected"), "length").when(F.coalesce("n_differ", F.lit(0)) > 0, "content")
    return x.select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def same_page(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a, b) with an equal text hash or an equal image hash."""
    by = lambda h: a.filter(F.col(h).isNotNull()).select(F.col("id").alias("a"), h).join(b.select(F.col("id").alias("b"), h), h).select("a", "b")
    return by("text_hash").union(by("image_hash")).distinct()


def pair_by_name_or_page(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Receipt rows with their file: by name, else by first page where one file alone has it."""
    n = F.count("*").over(Window.partitionBy("first_page"))
    alone = files.withColumn("_n", n).filter("_n = 1").select("first_page", F.col("file").alias("_by_page"))
    return rows.join(files.select(F.col("file").alias("_by_name"), F.col("file").alias("name")), "name", "left").join(alone, "first_page", "left").select(*rows.columns, F.coalesce("_by_name", "_by_page").alias("file"))


def pair_by_occurrence(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The k-th left row of a key with the k-th right row of it."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    l, r = left.withColumn("_k", rank), right.select(key, F.col(order).alias("right_" + order), rank.alias("_k"))  # noqa: E741
    return l.join(r, [key, "_k"], "left").drop("_k")


def person_by_id(pages: DataFrame, register: DataFrame) -> DataFrame:
    """The register's name of an id: the operator's entry wins; otherwise one name alone."""
    given = F.max(F.when(F.col("origin") == "operator", F.col("name")))
    names = register.groupBy("person_id").agg(given.alias("given"), F.countDistinct("name").alias("n"), F.min("name").alias("any"))
    return pages.join(names.select("person_id", F.coalesce("given", F.when(F.col("n") == 1, F.col("any"))).alias("found_name")), "person_id", "left")


def person_candidates(readings: DataFrame, register: DataFrame, most: int = 3, least: int = 4) -> DataFrame:
    """(reading, person_id, shared): register entries that share words of `least` letters, the `most` best."""
    # names with the same words have the same candidates, and of entries with the same words only the first `most` can be among the best
    words = F.array_sort(F.array_distinct(F.filter(F.split(name_key("name"), " "), lambda w: F.length(w) >= least)))
    keyed = lambda df, id: df.select(id, F.array_join(words, " ").alias(f"{id}_key")).filter(F.col(f"{id}_key") != "")
    r, p = keyed(readings, "reading"), keyed(register, "person_id").distinct()
    first = Window.partitionBy("person_id_key").orderBy("person_id")
    p = p.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")
    split = lambda df, key: df.select(key).distinct().select(key, F.explode(F.split(key, " ")).alias("word"))
    hits = split(r, "reading_key").join(split(p, "person_id_key"), "word").groupBy("reading_key", "person_id_key").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("reading_key").orderBy(F.desc("shared"), "person_id")
    top = hits.join(p, "person_id_key").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most)
    return r.distinct().join(top.select("reading_key", "person_id", "shared"), "reading_key").select("reading", "person_id", "shared")


def only_best(candidates: DataFrame, key: str, score: str) -> DataFrame:
    """The best candidate of a key, if no other is as good."""
    top = F.max(score).over(Window.partitionBy(key))
    x = candidates.withColumn("_top", top).filter(F.col(score) == F.col("_top"))
    return x.withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter("_n = 1").drop("_top", "_n")


def closest_known(readings: DataFrame, known: DataFrame, within: int = 1) -> DataFrame:
    """A code read by hand becomes the closest known code within so many edits, if no other is as close.

    A known code stays. Of others, the codes that one edit makes are looked up, with no pairs; only codes without a known one so near are paired.
    """
    k = known.select(F.col("code").alias("known")).filter("known IS NOT NULL").distinct()
    open_ = readings.select("code").filter("code IS NOT NULL").distinct().join(k, F.col("code") == F.col("known"), "left_anti")
    out = readings.join(k.select(F.col("known").alias("code"), F.col("known").alias("_same")), "code", "left")
    if within < 1:
        return out.withColumnRenamed("_same", "corrected")
    near = _one_edit_away(open_, k)
    if within > 1:
        near = near.unionByName(_by_pieces(open_.join(near, "code", "left_anti"), k, within))
    return out.join(near, "code", "left").select(*readings.columns, F.coalesce("_same", "_near").alias("corrected"))


def _one_edit_away(codes: DataFrame, known: DataFrame) -> DataFrame:
    """(code, _near) of codes, none of which is known, with a known one an edit or a swap away; null where there are several.

    Two codes are that near if and only if they are the same key: the known code, or the known code without its i-th character, at i.
    """

    def without(code: Column, i: Column) -> Column:
        return F.concat(F.substring(code, F.lit(1), i - 1), F.substring(code, i + 1, F.length(code)))

    c, i = F.col("known"), F.col("at")
    k = known.select("known", F.explode(F.sequence(F.lit(0), F.length(c))).alias("at"))
    k = k.select("at", F.when(i == 0, c).otherwise(without(c, i)).alias("rest"), "known").groupBy("at", "rest").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    c, n = F.col("code"), F.length("code")
    key = lambda at, rest: F.struct(at.alias("at"), rest.alias("rest"))
    swapped = F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, n))
    r = codes.select("code", F.explode(F.sequence(F.lit(1), n + 1)).alias("at"))
    keys = F.array(key(i, c), F.when(i <= n, key(F.lit(0), without(c, i))), F.when(i <= n, key(i, without(c, i))), F.when(i < n, key(F.lit(0), swapped)))
    r = r.select("code", F.inline(F.array_compact(keys)))
    return r.join(k, ["at", "rest"]).groupBy("code").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("code", F.when(F.col("low") == F.col("high"), F.col("low")).alias("_near"))


def _by_pieces(codes: DataFrame, known: DataFrame, within: int) -> DataFrame:
    """(code, _near) of codes with one closest known code within so many edits. Codes meet by a piece that edits leave whole: one of 2 * within + 1 parts of the known code, at its place or shifted by the edits; a swap can touch two."""
    parts = 2 * within + 1

    def piece(code: Column, i: int, shift: int) -> Column:
        size = F.floor(F.col("_len") / parts).cast("int")
        start = F.lit(i) * size + 1 + shift
        size = F.when(F.lit(i) == parts - 1, F.col("_len") - F.lit(i) * size).otherwise(size)
        # what lies before the first character is no part of it
        return F.substring(code, F.greatest(start, F.lit(1)), size + F.least(start - 1, F.lit(0)))

    k = known.withColumn("_len", F.length("known"))
    k = k.select("known", "_len", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), piece(F.col("known"), i, 0).alias("piece")) for i in range(parts)])).alias("p"))
    r = codes.withColumn("_len", F.explode(F.array(*[F.length("code") + d for d in range(-within, within + 1)]))).filter("_len >= 0")
    r = r.select("code", "_len", F.explode(F.array_distinct(F.array(*[F.struct(F.lit(i).alias("i"), piece(F.col("code"), i, s).alias("piece")) for i in range(parts) for s in range(-within, within + 1)]))).alias("p"))
    pairs = r.join(k, ["_len", "p"]).select("code", "known").distinct().filter(maybe_within(F.col("code"), F.col("known"), within))
    near = pairs.withColumn("distance", osa_distance(F.col("code"), F.col("known"), within)).filter(F.col("distance") <= within)
    return only_best(near.withColumn("distance", -F.col("distance")), "code", "distance").select("code", F.col("known").alias("_near"))


def mentions(pages: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id, unit, n_pages): which units name an id."""
    ids = pages.select("unit", "page_number", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("\\b(\\d{6,10})\\b"), F.lit(1)))).alias("person_id"))
    return ids.join(people.select("person_id").distinct(), "person_id").groupBy("person_id", "unit").agg(F.countDistinct("page_number").alias("n_pages"))


def outside(rows: DataFrame, series: DataFrame, key: str) -> DataFrame:
    return rows.join(series.select(key).distinct(), key, "left_anti")


def compare_runs(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """Per key: counts before and now, names only before and only now, as often as they are."""
    count = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    o, n = old.select(key, name), new.select(key, name)
    gone = o.exceptAll(n).groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("only_before"))
    come = n.exceptAll(o).groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("only_now"))
    x = count(old, "n_before").join(count(new, "n_now"), key, "full").join(gone, key, "left").join(come, key, "left")
    none = F.array().cast("array<string>")
    return x.select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("only_before", none).alias("only_before"), F.coalesce("only_now", none).alias("only_now"))


def square_folders(source: DataFrame, delivered: DataFrame) -> DataFrame:
    """(path, status): both, only_source or only_delivered."""
    x = source.select("path").distinct().withColumn("s", F.lit(True)).join(delivered.select("path").distinct().withColumn("d", F.lit(True)), "path", "full")
    return x.select("path", F.when(F.col("s") & F.col("d"), "both").when(F.col("s"), "only_source").otherwise("only_delivered").alias("status"))


def apply_corrections(readings: DataFrame, verified: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = verified.select(*keys, F.col(value).alias("_v"))
    return readings.join(v, keys, "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def unify_twins(codes: DataFrame) -> DataFrame:
    """A code without a year takes its only twin with one: 026 -> 026-2022."""
    x = codes.select("code").distinct()
    twins = x.filter(F.col("code").rlike("^.+-(19|20)\\d{2}$")).withColumn("base", F.regexp_replace("code", "-\\d{4}$", "")).groupBy("base").agg(F.countDistinct("code").alias("n"), F.min("code").alias("twin")).filter("n = 1")
    return codes.join(twins.select(F.col("base").alias("code"), "twin"), "code", "left").select(*[F.coalesce("twin", "code").alias("code") if c == "code" else F.col(c) for c in codes.columns])


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)
