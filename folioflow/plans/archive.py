"""Queries over the archive: orders stand in for documents (jobs), line items for delivered units, customers for operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import consensus as cs
from ..operators import ledger as lg
from ..sources import store
from .registry import query, read

L = lambda c: F.col(c).cast("long")


def ledger(spark, sf):
    """Ledger rows of line items: ordinal by (order, line)."""
    li, o, c = read(spark, sf, "lineitem"), read(spark, sf, "orders"), read(spark, sf, "customer")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return x.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).cast("long").alias("ordinal"), F.col("o_orderkey").alias("job_id"), F.concat(F.lit("caja-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("source_document"), F.col("c_name").alias("operator"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"),
        F.concat(F.lit("R-"), (F.col("l_partkey") % 50).cast("string")).alias("code"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("type"), F.concat(F.lit("unit-"), F.col("l_linenumber").cast("string"), F.lit(".pdf")).alias("file_name"), F.floor("l_quantity").cast("long").alias("page_count"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").cast("long").alias("source_bytes"), (F.col("l_linenumber") * 3).cast("long").alias("source_pages"), (F.col("l_linenumber") % 2).cast("long").alias("review"),
    )


LED = """led AS (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS ordinal, o_orderkey AS job_id, 'caja-' || o_orderkey || '.pdf' AS source_document, c_name AS operator, strftime(o_orderdate, '%Y-%m-%d') AS recorded_at, 'R-' || (l_partkey % 50) AS code, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS type,
 'unit-' || l_linenumber || '.pdf' AS file_name, CAST(floor(l_quantity) AS BIGINT) AS page_count, o_orderpriority AS title, CAST(trunc(o_totalprice) AS BIGINT) AS source_bytes, CAST(l_linenumber * 3 AS BIGINT) AS source_pages, CAST(l_linenumber % 2 AS BIGINT) AS review
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {LED}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ordinal DESC) AS n FROM led), t AS (SELECT job_id, type, min(n) AS n FROM n WHERE type <> '' GROUP BY ALL)
SELECT n.job_id, arg_max(source_document, ordinal) AS source_document, arg_max(operator, ordinal) AS operator, arg_max(source_pages, ordinal) AS source_pages, arg_max(source_bytes, ordinal) AS source_bytes, arg_max(review, ordinal) AS review, min(recorded_at) AS processed_at, count(*) AS n_units, CAST(sum(page_count) AS BIGINT) AS n_pages,
 list(code ORDER BY n) FILTER (WHERE n <= 8) AS codes, coalesce((SELECT list(type ORDER BY t.n)[1:8] FROM t WHERE t.job_id = n.job_id), CAST([] AS VARCHAR[])) AS types, max(ordinal) AS newest FROM n GROUP BY n.job_id""")
def ledger_documents(spark, sf):
    return lg.documents(ledger(spark, sf))


@query(f"WITH {LED} SELECT count(*) AS n_rows, count(DISTINCT job_id) AS n_documents, count(DISTINCT code) AS n_codes, CAST(sum(page_count) AS BIGINT) AS n_pages FROM led")
def ledger_summary(spark, sf):
    return lg.summary(ledger(spark, sf))


@query(f"WITH {LED} SELECT DISTINCT job_id FROM led")
def ledger_jobs(spark, sf):
    return lg.job_ids(ledger(spark, sf))


SEARCH = "contains(lower(strip_accents(concat_ws(' ', source_document, code, title, coalesce(type, ''), file_name, operator))), 'urgent') AND contains(lower(strip_accents(concat_ws(' ', source_document, code, title, coalesce(type, ''), file_name, operator))), 'r-7')"


@query(f"WITH {LED} SELECT ordinal, job_id, code, file_name FROM led WHERE {SEARCH}")
def archive_search(spark, sf):
    return lg.search(ledger(spark, sf), "ÚRGENT r-7").select("ordinal", "job_id", "code", "file_name")


@query(f"WITH {LED} SELECT job_id, count(*) AS n_units FROM led WHERE job_id IN (SELECT job_id FROM led WHERE {SEARCH}) GROUP BY job_id")
def documents_search(spark, sf):
    return lg.documents_with(ledger(spark, sf), "urgent R-7").select("job_id", "n_units")


@query(f"WITH {LED} SELECT ordinal, job_id FROM led ORDER BY recorded_at DESC, ordinal DESC LIMIT 500 OFFSET 1000")
def archive_page(spark, sf):
    return lg.page(ledger(spark, sf), [F.desc("recorded_at"), F.desc("ordinal")], 1000, 500).select("ordinal", "job_id")


DOC = "doc AS (SELECT o_orderkey AS job_id, o_custkey AS operator_id, CAST(o_orderdate AS DATE) AS day, o_orderdate AS at_, o_orderpriority AS origin, 'caja ' || o_orderkey AS name, o_orderstatus = 'F' AS failed, CAST(floor(o_totalprice) AS BIGINT) % 97 AS n_pages, o_custkey % 9 AS n_units, CAST(floor(o_totalprice) AS BIGINT) % 3 AS vision_pages, o_orderkey % 2 AS review, CAST(o_custkey AS VARCHAR) AS operator FROM orders)"


def docs(spark, sf):
    o = read(spark, sf, "orders")
    t = F.floor("o_totalprice").cast("long")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("operator_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("origin"), F.concat(F.lit("caja "), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_orderstatus") == "F").alias("failed"), (t % 97).alias("n_pages"), (F.col("o_custkey") % 9).alias("n_units"), (t % 3).alias("vision_pages"), (F.col("o_orderkey") % 2).alias("review"), F.col("o_custkey").cast("string").alias("operator"))


@query(f"WITH {DOC} SELECT day, count(*) AS n_documents, CAST(sum(n_pages) AS BIGINT) AS n_pages, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(vision_pages) AS BIGINT) AS vision_pages, count(*) FILTER (WHERE failed) AS n_failed, round(100.0 * sum(vision_pages)::DOUBLE / nullif(sum(n_pages), 0), 3) AS vision_percent FROM doc GROUP BY day")
def daily_production(spark, sf):
    return lg.daily_production(docs(spark, sf))


@query(f"WITH {DOC} SELECT origin, max(at_) AS latest, count(*) AS n_documents, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(n_pages) AS BIGINT) AS n_pages, count(DISTINCT operator) AS n_operators, bool_or(failed) AS any_failed FROM doc GROUP BY origin")
def origin_groups(spark, sf):
    return lg.by_origin(docs(spark, sf))


@query(f"WITH {DOC} SELECT day, count(*) AS n_documents, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(n_pages) AS BIGINT) AS n_pages, list(job_id ORDER BY job_id) AS job_ids FROM doc GROUP BY day")
def day_totals(spark, sf):
    return lg.day_totals(docs(spark, sf))


@query(f"WITH {DOC} SELECT job_id, day FROM doc WHERE day >= DATE '1998-06-30' - 29")
def recent_documents(spark, sf):
    return lg.in_period(docs(spark, sf), "at", F.lit(date(1998, 6, 30)), 29).select("job_id", "day")


@query(f"WITH {DOC} SELECT job_id FROM doc WHERE review = 0 AND NOT failed")
def clean_documents(spark, sf):
    return lg.with_status(docs(spark, sf), "clean").select("job_id")


@query(f"WITH {DOC} SELECT job_id, name, row_number() OVER (ORDER BY lpad(regexp_extract(name, '[0-9]+'), 10, '0'), name, at_ DESC, job_id DESC) AS place FROM doc")
def natural_name_places(spark, sf):
    # places within runs of names that begin alike, behind the rows of all runs before: no task sorts all rows
    d = docs(spark, sf).withColumn("_run", F.coalesce(F.substring(lg.sort_key("name")[0], 1, 7), F.lit("")))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = d.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_run").orderBy(*lg.sort_key("name"))) + F.col("_before")
    return d.join(runs, "_run").select("job_id", "name", place.cast("long").alias("place"))


@query(f"WITH {DOC} SELECT job_id, n_pages FROM doc ORDER BY n_pages DESC, at_ DESC, job_id DESC LIMIT 100")
def largest_documents(spark, sf):
    return docs(spark, sf).orderBy(*lg.sort_key("pages")).limit(100).select("job_id", "n_pages")


@query(f"WITH {DOC} SELECT job_id, n_pages FROM doc WHERE failed UNION ALL SELECT job_id, n_pages FROM doc WHERE NOT failed")
def live_and_past(spark, sf):
    d = docs(spark, sf).select("job_id", "n_pages", "failed")
    return lg.live_and_past(d.filter("failed").select("job_id", "n_pages"), d.select("job_id", "n_pages"))


@query(f"WITH {LED} SELECT job_id, file_name, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ordinal) AS r FROM led) WHERE r = 1")
def first_review_per_code(spark, sf):
    return lg.first_per(ledger(spark, sf), ["code"], [F.asc("ordinal")]).select("job_id", "file_name", "ordinal")


@query(f"WITH {LED}, k AS (SELECT *, row_number() OVER (PARTITION BY job_id, file_name ORDER BY ordinal) AS r FROM led) SELECT job_id, file_name, ordinal, CASE WHEN r = 1 AND job_id % 5 = 0 THEN 'fixed' ELSE title END AS title, page_count FROM k")
def ledger_patch(spark, sf):
    rows = ledger(spark, sf).select("job_id", "file_name", "ordinal", "title", "page_count")
    changes = rows.filter("job_id % 5 = 0").select("job_id", "file_name", F.lit("fixed").alias("title"), F.lit(None).cast("long").alias("page_count")).distinct()
    return lg.patch(rows, changes, ["job_id", "file_name"])


@query(f"WITH {LED} SELECT job_id, file_name FROM led WHERE job_id % 7 <> 0")
def ledger_delete(spark, sf):
    return lg.without(ledger(spark, sf), F.col("job_id") % 7 == 0).select("job_id", "file_name")


@query(f"WITH {LED} SELECT job_id, ordinal, CASE WHEN job_id = 7 THEN 'renamed.pdf' ELSE source_document END AS source_document FROM led")
def ledger_rename(spark, sf):
    return lg.rename_document(ledger(spark, sf), 7, "renamed.pdf").select("job_id", "ordinal", "source_document")


def _store(spark, sf):
    d = docs(spark, sf).withColumn("run_id", F.col("job_id") % 25)
    runs = read(spark, sf, "nation").select(L("n_nationkey").alias("run_id"), F.col("n_name").alias("run"))
    people = read(spark, sf, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("operator_id"), F.col("c_name").alias("person"))
    return d, runs, people


@query(f"WITH {DOC} SELECT job_id, n_name AS run, c_name AS person, n_pages FROM doc JOIN nation ON n_nationkey = job_id % 25 LEFT JOIN customer ON c_custkey = operator_id AND c_custkey % 4 <> 0")
def archive_documents(spark, sf):
    return lg.archive_documents(*_store(spark, sf)).select("job_id", "run", "person", "n_pages")


@query(f"WITH {DOC} SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS unit, c_name AS person, day FROM lineitem JOIN doc ON job_id = l_orderkey LEFT JOIN customer ON c_custkey = operator_id AND c_custkey % 4 <> 0")
def inventory_view(spark, sf):
    d, _, people = _store(spark, sf)
    units = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), L("l_linenumber").alias("unit"))
    return lg.inventory(units, d, people).select("job_id", "unit", "person", "day")


@query(f"WITH {DOC} SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS unit, c_name AS person FROM lineitem JOIN doc ON job_id = l_orderkey LEFT JOIN customer ON c_custkey = operator_id AND c_custkey % 4 <> 0 WHERE l_linestatus = 'O'")
def pending_reviews(spark, sf):
    d, _, people = _store(spark, sf)
    r = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), L("l_linenumber").alias("unit"), (F.col("l_linestatus") != "O").alias("resolved"))
    return lg.pending_reviews(r, d, people).select("job_id", "unit", "person")


@query(f"WITH {LED}, j AS (SELECT * FROM led WHERE job_id % 3 <> 0) SELECT job_id, max(source_document) AS source_document, max(operator) AS operator, min(recorded_at) AS recorded_at, max(source_pages) AS source_pages, count(*) AS n_units FROM j GROUP BY job_id")
def relational_documents(spark, sf):
    led = ledger(spark, sf).withColumn("first_page", F.lit(1)).withColumns({"last_page": F.lit(1), "pages": F.lit("1")})
    return store.relational(led, docs(spark, sf).filter("job_id % 3 = 0"))["documento"]


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def upserted_operators(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return store.upsert(c, c.filter("id % 3 = 0").withColumn("segment", F.lit("new")), ["id"])


@query(f"WITH {LED} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ordinal) AS numero, code, title, coalesce(nullif(trim(type), ''), 'N/A') AS type, CAST(page_count AS VARCHAR) AS pages, '30/06/1998' AS fecha_de_registro FROM led")
def official_inventory(spark, sf):
    x = ledger(spark, sf).withColumn("first_page", F.col("ordinal")).withColumn("pages", F.col("page_count"))
    return store.official_row(x, F.lit(date(1998, 6, 30)))


# votes and counts


def _sample(spark, sf):
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels")
    x = d.select("doc_id", "source").join(lab, "doc_id", "left")
    return x.withColumn("outcome", F.when(F.col("quality").isNull(), "doubtful").when(F.col("quality") == 0, "error").otherwise("right"))


@query("""WITH x AS (SELECT source, CASE WHEN quality IS NULL THEN 'doubtful' WHEN quality = 0 THEN 'error' ELSE 'right' END AS o FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), g AS (SELECT source, count(*) FILTER (WHERE o = 'error') AS e, count(*) FILTER (WHERE o = 'doubtful') AS d, count(*) AS n FROM x GROUP BY source),
w AS (SELECT *, greatest(0.0, (p + z * z / (2 * n)) / dd - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / dd) AS low, least(1.0, (p + z * z / (2 * n)) / dd + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / dd) AS high, least(1.0, (q + z * z / (2 * n)) / dd + z * sqrt(q * (1 - q) / n + z * z / (4 * n * n)) / dd) AS worst
 FROM (SELECT *, e::DOUBLE / n AS p, (e + d)::DOUBLE / n AS q, 1.96::DOUBLE AS z, 1 + 1.96::DOUBLE * 1.96::DOUBLE / n AS dd FROM g))
SELECT source, e AS errors, d AS doubtful, n, round(low, 9) AS low, round(high, 9) AS high, round(worst, 9) AS worst, CASE WHEN low > 0.05 THEN 'outside' WHEN high <= 0.05 AND (d = 0 OR worst <= 0.05) THEN 'inside' ELSE 'uncertain' END AS verdict FROM w""")
def audit_margins(spark, sf):
    m = cs.margins(_sample(spark, sf), ["source"])
    return m.select("source", "errors", "doubtful", "n", *[F.round(c, 9).alias(c) for c in ("low", "high", "worst")], "verdict")


@query()
def type_verdict(spark, sf):
    e = read(spark, sf, "events")
    hits = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_number"), F.col("event_type").alias("marker"), F.col("event_type").alias("type"), F.when(F.col("event_type") == "view", 1.0).otherwise(0.6).alias("weight"), F.ascii("event_type").alias("type_order"))
    return cs.type_verdict(hits, e.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n_pages")))


@query("""WITH c AS (SELECT user_id AS box, event_type AS skill, count(*) AS n FROM events GROUP BY user_id, event_type), s AS (SELECT box, skill, n::DOUBLE / sum(n) OVER (PARTITION BY box) AS share FROM c), r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(share) OVER w, 0.0) AS second FROM s WINDOW w AS (PARTITION BY box ORDER BY share DESC, skill))
SELECT box, skill, share FROM r WHERE r = 1 AND share >= 0.15 AND share >= 1.1 * second""")
def skill_winner(spark, sf):
    from pyspark.sql import Window

    n = read(spark, sf, "events").groupBy(F.col("user_id").alias("box"), F.col("event_type").alias("skill")).agg(F.count("*").alias("n"))
    s = n.select("box", "skill", (F.col("n") / F.sum("n").over(Window.partitionBy("box"))).alias("share"))
    return cs.winner_by_share(s, "box", 0.15, 1.1)


@query("""WITH r AS (SELECT o_custkey AS person, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 100000000 + 12345678 + o_custkey ELSE 12345678 + o_custkey + o_orderkey % 2 END AS VARCHAR) AS d, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS w FROM orders), v AS (SELECT person, d, sum(w) AS w FROM r GROUP BY ALL),
x AS (SELECT v.person, coalesce(t.d, v.d) AS d, v.w FROM v LEFT JOIN v t ON t.person = v.person AND v.d LIKE '1%' AND length(v.d) = 9 AND t.d = substr(v.d, 2)), s AS (SELECT person, d, sum(w) AS w FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER q AS r, lead(w) OVER q AS second FROM s WINDOW q AS (PARTITION BY person ORDER BY w DESC, d))
SELECT person, CASE WHEN coalesce(second = w, false) THEN NULL ELSE d END AS value, w >= 2 AND NOT coalesce(second = w, false) AS confirmed FROM k WHERE r = 1""")
def id_consensus(spark, sf):
    o = read(spark, sf, "orders")
    base = 12345678 + F.col("o_custkey")
    r = o.select(F.col("o_custkey").alias("person"), F.when(F.col("o_orderkey") % 3 == 0, 100000000 + base).otherwise(base + F.col("o_orderkey") % 2).cast("string").alias("reading"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("weight"))
    return cs.id_consensus(r, "person")


@query("""WITH w AS (SELECT p_brand AS by_, p_partkey AS reader, p_size AS weight, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part), v AS (SELECT by_, place, word, sum(weight) AS w, min(reader) AS f FROM w GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY by_, place ORDER BY w DESC, f) AS r FROM v)
SELECT by_ AS brand, string_agg(word, ' ' ORDER BY place) AS name FROM b WHERE r = 1 GROUP BY by_""")
def name_by_words(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("reader"), F.col("p_size").alias("weight"), F.col("p_name").alias("name"))
    return cs.majority_words(p, "brand")


@query("WITH n AS (SELECT o_custkey AS box, o_orderpriority AS organ, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL) SELECT box, organ, n FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY n DESC, f) AS r FROM n) WHERE r = 1")
def dominant_organ(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("box"), F.col("o_orderpriority").alias("organ"), F.col("o_orderkey").alias("k"))
    return cs.commonest(o, ["box"], "organ", "k")


@query("WITH n AS (SELECT user_id AS box, CAST(floor(value) AS BIGINT) % 6 AS account, count(DISTINCT event_id) AS n FROM events GROUP BY ALL) SELECT box, account, n FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY n DESC, account DESC) AS r FROM n) WHERE r = 1 AND n >= 2")
def account_of_box(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("box"), (F.floor("value").cast("long") % 6).alias("account"), F.col("event_id").alias("page_number"))
    return cs.account_of_box(e, "box")


YR = "y AS (SELECT c_nationkey AS box, o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS first_year, CAST(year(o_orderdate) + o_orderkey % 4 AS BIGINT) AS last_year FROM orders JOIN customer ON c_custkey = o_custkey), l AS (SELECT box, list(first_year ORDER BY first_year) AS a, list(last_year ORDER BY last_year) AS b FROM y GROUP BY box), b AS (SELECT box, a[CAST(floor(0.1::DOUBLE * (len(a) - 1)) AS BIGINT) + 1] AS low, b[CAST(floor(0.9::DOUBLE * (len(b) - 1)) AS BIGINT) + 1] AS high FROM l WHERE len(a) >= 8)"


def _years(spark, sf):
    x = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    y = F.year("o_orderdate").cast("long")
    return x.select(F.col("c_nationkey").alias("box"), F.col("o_orderkey").alias("id"), y.alias("first_year"), (y + F.col("o_orderkey") % 4).alias("last_year"))


@query(f"WITH {YR} SELECT box, low, high FROM b")
def years_of_box(spark, sf):
    return cs.years_of_box(_years(spark, sf), "box")


@query(f"WITH {YR} SELECT y.box, id, first_year, last_year FROM y JOIN b ON b.box = y.box WHERE first_year < low - 1 OR last_year > high + 1")
def outside_box_years(spark, sf):
    y = _years(spark, sf)
    return cs.outside_years(y, cs.years_of_box(y, "box"), "box", 1)


@query("SELECT parameter, method, state, over_methods, n FROM (SELECT event_type AS parameter, NULL AS method, st AS state, 1 AS over_methods, count(*) AS n FROM (SELECT *, CAST(floor(value) AS BIGINT) % 3 AS st, 'ocr' || user_id % 2 AS me FROM events) GROUP BY event_type, st UNION ALL SELECT event_type, me, st, 0, count(*) FROM (SELECT *, CAST(floor(value) AS BIGINT) % 3 AS st, 'ocr' || user_id % 2 AS me FROM events) GROUP BY event_type, me, st)")
def finding_counts(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("parameter"), (F.floor("value").cast("long") % 3).alias("state"), F.concat(F.lit("ocr"), (F.col("user_id") % 2).cast("string"), F.lit(" (p. "), F.col("event_id").cast("string"), F.lit(")")).alias("method"))
    return cs.finding_counts(e)


@query("SELECT event_type AS field, count(*) AS n, list_sort(list(DISTINCT event_id % 50)) AS pages FROM events GROUP BY event_type")
def issue_summary(spark, sf):
    return cs.issue_summary(read(spark, sf, "events").select(F.col("event_type").alias("field"), (F.col("event_id") % 50).alias("page_number")))


@query("WITH n AS (SELECT user_id AS box, event_type AS provenance, count(*) AS n FROM events GROUP BY ALL) SELECT *, round(100.0 * n::DOUBLE / sum(n) OVER (PARTITION BY box), 3) AS percent FROM n")
def provenance_shares(spark, sf):
    return cs.shares(read(spark, sf, "events").select(F.col("user_id").alias("box"), F.col("event_type").alias("provenance")), ["box"], "provenance")


@query("SELECT event_type AS provider, count(*) AS pages, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(user_id % 7) AS BIGINT) AS wait_s, count(*) * CASE event_type WHEN 'view' THEN 1.5::DOUBLE WHEN 'click' THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END / 1000 AS cost FROM events GROUP BY event_type")
def consumption(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("provider"), F.lit(1).cast("long").alias("pages"), F.floor("value").cast("long").alias("tokens"), (F.col("user_id") % 7).alias("wait_s"))
    return cs.consumption(e, {"view": 1.5, "click": 4.0})


@query("SELECT o_custkey AS person, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS priority, arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS status FROM orders GROUP BY o_custkey")
def consolidated_records(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("k"), F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise("").alias("status"))
    return cs.consolidate(o, ["person"], "k", ["priority", "status"])


@query("WITH f AS (SELECT user_id AS box, event_type, min(event_id) AS at_ FROM events GROUP BY ALL) SELECT box, list(event_type ORDER BY at_) AS \"values\" FROM f GROUP BY box")
def types_in_order(spark, sf):
    return cs.distinct_in_order(read(spark, sf, "events").select(F.col("user_id").alias("box"), "event_type", "event_id"), "box", "event_type", "event_id")


@query("WITH l AS (SELECT source AS doc_id, doc_id AS page_number, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, line, count(DISTINCT page_number) AS n_pages FROM l WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT page_number) >= 3")
def repeated_lines(spark, sf):
    return cs.repeated_lines(read(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text"))


@query("SELECT event_type AS message, count(*) AS n, min(event_id) AS first_at, max(event_id) AS last_at FROM events GROUP BY event_type")
def diagnostics(spark, sf):
    return cs.diagnostics(read(spark, sf, "events").select(F.col("event_type").alias("message"), F.col("event_id").alias("at")))


@query("WITH x AS (SELECT c_nationkey AS box, c_custkey AS id, c_custkey % 20 AS code, c_mktsegment AS name FROM customer), w AS (SELECT *, count(*) OVER q AS n, min(coalesce(name, '')) OVER q AS lo, max(coalesce(name, '')) OVER q AS hi FROM x WINDOW q AS (PARTITION BY box, code)) SELECT box, id, code, name FROM w WHERE n > 1 AND NOT (lo = hi AND lo <> '')")
def duplicate_codes(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("box"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 20).alias("code"), F.col("c_mktsegment").alias("name"))
    return cs.duplicate_values(c, "box", "code", "name")


@query("WITH x AS (SELECT c_nationkey AS box, c_custkey AS id, c_mktsegment AS name FROM customer), w AS (SELECT *, lag(name) OVER q AS a, lead(name) OVER q AS b FROM x WINDOW q AS (PARTITION BY box ORDER BY id)) SELECT box, id, name FROM w WHERE a <= b AND (name < a OR name > b)")
def out_of_alphabet(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("box"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    return cs.out_of_alphabet(c, "box", "name", "id")


@query("SELECT box, number, previous FROM (SELECT l_orderkey AS box, l_linenumber * (1 + l_orderkey % 2) AS number, lag(l_linenumber * (1 + l_orderkey % 2)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * (1 + l_orderkey % 2)) AS previous FROM lineitem) WHERE number - previous <> 1")
def unit_gaps(spark, sf):
    x = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("box"), (F.col("l_linenumber") * (1 + F.col("l_orderkey") % 2)).alias("number"))
    return cs.gaps(x, "box", "number")


@query("SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS unit, list_filter([CASE WHEN l_quantity < 5 THEN 'short' END, CASE WHEN l_returnflag = 'R' THEN 'repaired' END, CASE WHEN l_discount > 0.08 THEN 'doubt' END], lambda x: x IS NOT NULL) AS problems FROM lineitem")
def expected_data(spark, sf):
    x = read(spark, sf, "lineitem")
    return cs.flag(x, {"short": F.col("l_quantity") < 5, "repaired": F.col("l_returnflag") == "R", "doubt": F.col("l_discount") > 0.08}).select(F.col("l_orderkey").alias("job_id"), L("l_linenumber").alias("unit"), "problems")


@query("SELECT source_document AS field, count(*) AS n FROM (SELECT 'quarantine' AS source_document FROM events WHERE event_type = 'error' UNION ALL SELECT 'untitled' FROM orders WHERE o_orderpriority LIKE '5%' UNION ALL SELECT 'conflict' FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O') GROUP BY 1")
def issues_by_kind(spark, sf):
    kinds = [("quarantine", read(spark, sf, "events").filter("event_type = 'error'")), ("untitled", read(spark, sf, "orders").filter("o_orderpriority LIKE '5%'")), ("conflict", read(spark, sf, "lineitem").filter("l_returnflag = 'A' AND l_linestatus = 'O'"))]
    out = None
    for name, rows in kinds:
        part = rows.select(F.lit(name).alias("field"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("field").agg(F.count("*").alias("n"))


@query()
def progress_fold(spark, sf):
    from ..streaming import progress

    return progress.fold(progress.events_of(read(spark, sf, "events")))
