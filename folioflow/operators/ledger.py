"""Reads over the inventory ledger: one row per delivered file. Newest first is by `ordinal`, which every source provides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, natural_key, search_terms

#: Fields that a search looks into.
SEARCHED = ("source_document", "code", "title", "type", "nic", "fecha", "file_name", "pages", "operator", "origen", "origen_ruta")
NULL = "\u0000"


def documents(rows: DataFrame) -> DataFrame:
    """One row per job: facts of its newest line, earliest non-empty time, the first 8 codes (repeats and nulls too), at most 8 distinct types."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("ordinal"))
    x = rows.withColumn("_n", F.row_number().over(newest))
    item = F.struct("_n", "code", "type")
    g = x.groupBy("job_id").agg(
        F.max_by(F.struct("source_document", "operator", "source_pages", "source_bytes", "review", "recorded_at"), "ordinal").alias("top"),
        F.min(F.when(F.col("recorded_at") != "", F.col("recorded_at"))).alias("earliest"),
        F.count("*").alias("n_units"),
        F.sum("page_count").alias("n_pages"),
        F.array_sort(F.collect_list(F.when(F.col("_n") <= 8, item))).alias("head"),
        F.array_sort(F.collect_set(F.struct(F.col("_n"), F.col("type")))).alias("typed"),
        F.max("ordinal").alias("newest"),
    )
    types = F.slice(F.array_distinct(F.transform(F.filter("typed", lambda t: F.coalesce(t["type"] != "", F.lit(False))), lambda t: t["type"])), 1, 8)
    empty = F.coalesce(F.col("top.recorded_at"), F.lit("")) == ""
    return g.select("job_id", "top.source_document", "top.operator", "top.source_pages", "top.source_bytes", "top.review", F.when(empty, F.col("top.recorded_at")).otherwise(F.col("earliest")).alias("processed_at"), "n_units", "n_pages", F.transform("head", lambda h: h["code"]).alias("codes"), types.alias("types"), "newest")


def summary(rows: DataFrame) -> DataFrame:
    """rows, distinct documents and codes (null counts as a value), pages."""
    d = lambda c: F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(NULL)))
    return rows.agg(F.count("*").alias("n_rows"), d("job_id").alias("n_documents"), d("code").alias("n_codes"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("n_pages"))


def job_ids(rows: DataFrame) -> DataFrame:
    return rows.filter("job_id IS NOT NULL AND cast(job_id as string) <> ''").select("job_id").distinct()


def row_text(rows: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED if c in rows.columns])


def search(rows: DataFrame, query: str | None) -> DataFrame:
    """Rows with all terms; a blank query keeps all."""
    return rows.filter(search_terms(row_text(rows), query)) if query and query.strip() else rows


def documents_with(rows: DataFrame, query: str | None) -> DataFrame:
    return documents(rows).join(search(rows, query).select("job_id").distinct(), "job_id", "left_semi")


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 500) -> DataFrame:
    """A page of rows; the limit is the feature."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), 5000))


def in_period(rows: DataFrame, at: str, today: Column, days: int) -> DataFrame:
    """From `days` days before today on."""
    return rows.filter(F.to_date(at) >= F.date_sub(today, days))


def with_status(docs: DataFrame, status: str) -> DataFrame:
    tests = {"review": F.col("review") > 0, "clean": (F.coalesce(F.col("review"), F.lit(0)) == 0) & ~F.col("failed"), "failed": F.col("failed")}
    return docs.filter(tests[status])


def pending(reviews: DataFrame) -> DataFrame:
    return reviews.filter(~F.col("resolved"))


def daily_production(docs: DataFrame) -> DataFrame:
    """Per day: documents, sums, failures and the share of pages that the vision model read."""
    g = docs.groupBy("day").agg(F.count("*").alias("n_documents"), F.sum("n_pages").alias("n_pages"), F.sum("n_units").alias("n_units"), F.sum("vision_pages").alias("vision_pages"), F.count_if("failed").alias("n_failed"))
    return g.withColumn("vision_percent", F.round(F.try_divide(100.0 * F.col("vision_pages"), F.col("n_pages")), 3))


def by_origin(docs: DataFrame, key: str = "origin") -> DataFrame:
    return docs.groupBy(key).agg(F.max("at").alias("latest"), F.count("*").alias("n_documents"), F.sum("n_units").alias("n_units"), F.sum("n_pages").alias("n_pages"), F.countDistinct("operator").alias("n_operators"), F.bool_or("failed").alias("any_failed"))


def day_totals(docs: DataFrame) -> DataFrame:
    g = docs.groupBy(F.to_date("at").alias("day"))
    return g.agg(F.count("*").alias("n_documents"), F.sum("n_units").alias("n_units"), F.sum("n_pages").alias("n_pages"), F.array_sort(F.collect_list("job_id")).alias("job_ids"))


def sort_key(name: str) -> list[Column]:
    recent = [F.desc("at"), F.desc("job_id")]
    return {"recent": recent, "old": [F.asc("at"), F.asc("job_id")], "units": [F.desc("n_units"), *recent], "pages": [F.desc("n_pages"), *recent], "name": [natural_key("name"), fold("name"), *recent]}[name]


def live_and_past(live: DataFrame, past: DataFrame, key: str = "job_id") -> DataFrame:
    """Live rows and those of the past whose key is not live."""
    return live.unionByName(past.join(live.select(key).distinct(), key, "left_anti").select(*live.columns))


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def patch(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes by key: non-null fields replace those of the first row with the key."""
    fields = [c for c in changes.columns if c not in keys]
    x = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")))
    c = changes.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields]).withColumn("_k", F.lit(1))
    x = x.join(c, [*keys, "_k"], "left")
    return x.select(*[F.coalesce(f"_new_{f}", f).alias(f) if f in fields else F.col(f) for f in rows.columns])


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def rename_document(rows: DataFrame, job_id: object, name: str) -> DataFrame:
    return rows.withColumn("source_document", F.when(F.col("job_id") == job_id, F.lit(name)).otherwise(F.col("source_document")))


def archive_documents(docs: DataFrame, runs: DataFrame, operators: DataFrame) -> DataFrame:
    """Documents with their run (must exist) and operator (may not)."""
    return docs.join(runs, "run_id").join(operators, "operator_id", "left")


def inventory(units: DataFrame, docs: DataFrame, operators: DataFrame) -> DataFrame:
    return units.join(docs, "job_id").join(operators, "operator_id", "left")


def pending_reviews(reviews: DataFrame, docs: DataFrame, operators: DataFrame) -> DataFrame:
    return pending(reviews).join(docs, "job_id").join(operators, "operator_id", "left")
