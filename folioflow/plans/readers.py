"""Queries over readers of one page and orders built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import pages as pg
from ..operators import ledger as lg
from ..operators import sequence as sq
from .pages import PG, sequence
from .registry import query, read

O = lambda spark, sf: read(spark, sf, "orders")  # noqa: E731, E741


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 >= 1 AND o_orderkey % 7 <= o_custkey % 9 THEN CAST(o_orderkey % 7 AS INTEGER) END AS page_index, CASE WHEN o_orderkey % 7 >= 1 AND o_orderkey % 7 <= o_custkey % 9 THEN CAST(o_custkey % 9 AS INTEGER) END AS page_total FROM orders")
def paginations(spark, sf):
    t = F.concat(F.lit("oficio\nPágina "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" de "), (F.col("o_custkey") % 9).cast("string"))
    return O(spark, sf).select(F.col("o_orderkey").alias("id"), pg.pagination(t).alias("p")).select("id", F.col("p.index").alias("page_index"), F.col("p.total").alias("page_total"))


@query("""WITH x AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) % 15 AS words, l_discount * 10 AS caps, l_returnflag = 'A' AS form, l_linestatus = 'O' AS cited FROM lineitem)
SELECT id, line, round(least(1.0, greatest(0.0, 0.35 * greatest(0.0, 1 - line / 7.0) + 0.45 * caps + 0.20 * CASE WHEN words <= 6 THEN 1.0 WHEN words >= 12 THEN 0.0 ELSE (12 - words) / 6 END + 0.30 * CASE WHEN form AND NOT cited THEN 1 ELSE 0 END - 0.55 * CASE WHEN cited THEN 1 ELSE 0 END))::DOUBLE, 6) AS score FROM x""")
def candidate_scores(spark, sf):
    x = read(spark, sf, "lineitem")
    line = F.col("l_linenumber").cast("long")
    s = pg.candidate_score(line, F.lit(8), F.col("l_discount") * 10, F.col("l_quantity").cast("long") % 15, F.col("l_returnflag") == "A", F.col("l_linestatus") == "O")
    return x.select(F.col("l_orderkey").alias("id"), line.alias("line"), F.round(s, 6).alias("score"))


@query("WITH x AS (SELECT doc_id, regexp_extract(rtrim(text, ' '), '([^\\n]*)$', 1) AS l, regexp_extract(ltrim(text, ' '), '^([^\\n]*)', 1) AS f FROM documents) SELECT doc_id, regexp_matches(l, '[\\p{L},]$') AND len(string_split_regex(trim(l), '\\s+')) >= 5 AS tail, regexp_matches(f, '^\\p{Ll}') AND len(string_split_regex(trim(f), '\\s+')) >= 3 AS head FROM x")
def running_sentences(spark, sf):
    return read(spark, sf, "documents").select("doc_id", pg.tail_runs_on("text").alias("tail"), pg.head_runs_on("text").alias("head"))


@query("WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(strip_accents(text), '\\b([A-Z][a-z]{2,})\\b', 1)) AS w FROM documents), y AS (SELECT doc_id, w, lead(w) OVER (ORDER BY doc_id) AS v FROM x) SELECT doc_id, len(list_intersect(w, v)) >= 2 AS shared FROM y WHERE v IS NOT NULL")
def neighbours_share_names(spark, sf):
    at = F.struct("_metadata.file_path", "_metadata.row_index")
    d = read(spark, sf, "documents").select("doc_id", pg.capitalised_words("text").alias("w"), at.alias("at"))
    return sq.with_next(d, "doc_id", "w", "at").filter("next IS NOT NULL").select("doc_id", pg.shared_names(F.col("w"), F.col("next")).alias("shared"))


@query("SELECT o_orderkey AS id, 'nic-' || (o_custkey % 30) AS nic, 'caja' || (o_custkey % 7) AS box, NULL::VARCHAR AS beyond FROM orders")
def folders_of_paths(spark, sf):
    p = F.concat(F.lit("caja"), (F.col("o_custkey") % 7).cast("string"), F.lit("\\nic-"), (F.col("o_custkey") % 30).cast("string"), F.lit("/a.pdf"))
    return O(spark, sf).select(F.col("o_orderkey").alias("id"), pg.from_path(p, 1).alias("nic"), pg.from_path(p, 2).alias("box"), pg.from_path(p, 5).alias("beyond"))


@query("SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS card, o_orderkey % 4 = 1 AS stamp, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey % 50 AS INTEGER) END AS folios FROM orders")
def page_kinds(spark, sf):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, "República - Cédula de Ciudadanía").when(k == 1, F.concat(F.lit("Recibido hoy. Folios: "), (F.col("o_custkey") % 50).cast("string"))).otherwise("carta simple")
    return O(spark, sf).select(F.col("o_orderkey").alias("id"), pg.is_id_card(t).alias("card"), pg.has_stamp(t).alias("stamp"), pg.declared_folios(t).alias("folios"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_custkey || '@x.co' ELSE CAST(1000000 + c_custkey AS VARCHAR) END AS who FROM customer")
def normalised_users(spark, sf):
    k = F.col("c_custkey")
    t = F.when(k % 2 == 0, F.concat(F.lit(" User"), k.cast("string"), F.lit("@X.co "))).otherwise(F.concat(F.lit("CC 1."), F.substring((1000000 + k).cast("string"), 2, 6)))
    return read(spark, sf, "customer").select(k.alias("id"), pg.normalised_user(t).alias("who"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(1990 + o_custkey % 10 AS INTEGER) END AS low, CASE WHEN o_orderkey % 2 = 0 THEN CAST(2000 + o_custkey % 10 AS INTEGER) END AS high FROM orders")
def book_windows(spark, sf):
    c = F.col("o_custkey") % 10
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Libro "), (1990 + c).cast("string"), F.lit(" - "), (2000 + c).cast("string"))).otherwise("Libro 7")
    return O(spark, sf).select(F.col("o_orderkey").alias("id"), dt.window_of_name(t).alias("w")).select("id", "w.low", "w.high")


@query(f"WITH {PG}, x AS (SELECT doc_id, page_number, CASE WHEN event_type IN ('signup', 'error') THEN event_type END AS own FROM pg) SELECT doc_id, page_number, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING), 'act') AS piece FROM x")
def session_pieces(spark, sf):
    p = sequence(spark, sf).withColumn("own", F.when(F.col("event_type").isin("signup", "error"), F.col("event_type")))
    return p.select("doc_id", "page_number", F.coalesce(sq.last_known("own", sq.until()), F.lit("act")).alias("piece"))


@query(f"WITH {PG}, g AS (SELECT doc_id, event_type AS provenance, count(*) AS n FROM pg GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_pages, CAST(coalesce(sum(n) FILTER (WHERE provenance = 'purchase'), 0) AS DOUBLE) / sum(n) AS vision_ratio FROM g GROUP BY doc_id")
def pipeline_stats(spark, sf):
    g = sequence(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("event_type") == "purchase").alias("v"))
    return g.select("doc_id", "n_pages", (F.col("v") / F.col("n_pages")).alias("vision_ratio"))


@query("SELECT o_custkey AS customer, job_id, name, row_number() OVER (PARTITION BY o_custkey ORDER BY day NULLS LAST, job_id) AS number FROM (SELECT o_custkey, o_orderkey AS job_id, 'caja ' || o_orderkey AS name, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders)")
def all_numbered_by_date(spark, sf):
    x = O(spark, sf).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("job_id"), F.concat(F.lit("caja "), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 6 != 0, F.to_date("o_orderdate")).alias("day"))
    return sq.chronological(x, "day", ["customer"], "job_id").select("customer", "job_id", "name", F.col("place").alias("number"))


@query("SELECT o_custkey AS box, o_orderkey AS item, o_orderpriority AS text FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def general_workbook(spark, sf):
    x = O(spark, sf).select(F.col("o_custkey").alias("box"), F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("text"), "o_orderstatus")
    return x.filter("o_orderstatus = 'F'").drop("o_orderstatus").unionByName(x.filter("o_orderstatus = 'O'").drop("o_orderstatus"))


@query("SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS unit, CAST(min(l_partkey) OVER (PARTITION BY l_orderkey) AS BIGINT) AS first_part FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1")
def first_of_each_unit(spark, sf):
    x = read(spark, sf, "lineitem").withColumn("first_part", F.min("l_partkey").over(Window.partitionBy("l_orderkey")))
    got = lg.first_per(x, ["l_orderkey", "l_linenumber"], [F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")])
    return got.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("unit"), "first_part")


@query()
def corrected_years(spark, sf):
    p = sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("page_number") % 9 == 0, F.add_months("day", -12 * 80)).otherwise(F.col("day")).alias("date"))
    w = sq.pages_order()
    around = F.array_compact(F.array(*[F.lag("date", i).over(w) for i in (2, 1)], *[F.lead("date", i).over(w) for i in (1, 2)]))
    both = F.when(F.lag("date").over(w) == F.lead("date").over(w), F.lag("date").over(w))
    return p.withColumns({"_n": around, "_b": both}).select("doc_id", "page_number", "date", pg.correct_year(F.col("date"), F.col("_n"), F.col("_b")).alias("corrected"))
