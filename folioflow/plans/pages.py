"""Queries over page sequences. Pages stand in from `events`: a user is a document, its events in time order are its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import osa
from ..operators import seams as sm
from ..operators import sequence as sq
from .registry import query, read


def sequence(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, page_number, code (on purchases), event_type, value, day, ts, k (a small number of the page)."""
    e = read(spark, sf, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    v = F.floor("value").cast("long")
    return e.select(F.col("user_id").alias("doc_id"), n.alias("page_number"), F.when(F.col("event_type") == "purchase", v % 7).alias("code"), "event_type", "value", F.to_date("ts").alias("day"), v.alias("k"), "event_id")


PG = """pg AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page_number, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) % 7 END AS code,
  event_type, value, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) AS k, event_id FROM events)"""
INH = PG + ", inh AS (SELECT *, last_value(code IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS group_code FROM pg)"
RANGES = """r0 AS ({src}), r1 AS (SELECT *, page_number - row_number() OVER (PARTITION BY {by} ORDER BY page_number) AS isl FROM r0),
r2 AS (SELECT {by}, isl, min(page_number) AS a, max(page_number) AS b, count(*) AS c FROM r1 GROUP BY ALL),
r3 AS (SELECT {by}, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS page_ranges, CAST(sum(c) AS BIGINT) AS n_pages, min(a) AS first_page FROM r2 GROUP BY ALL)"""


@query(f"WITH {PG} SELECT doc_id, page_number, code FROM pg")
def page_sequence(spark, sf):
    return sequence(spark, sf).select("doc_id", "page_number", "code")


@query(f"WITH {INH}, " + RANGES.format(src="SELECT doc_id, group_code AS code, page_number FROM inh WHERE group_code IS NOT NULL", by="doc_id, code") + " SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY first_page) AS position, n_pages, first_page, page_ranges FROM r3")
def group_by_code(spark, sf):
    return sq.groups_by_code(sequence(spark, sf).select("doc_id", "page_number", "code"))


@query(f"WITH {INH} SELECT doc_id, page_number FROM inh WHERE group_code IS NULL")
def quarantine(spark, sf):
    return sq.quarantine(sequence(spark, sf).select("doc_id", "page_number", "code"))


@query(f"""WITH {PG}, e AS (SELECT DISTINCT doc_id, page_number FROM pg), f AS (SELECT doc_id, page_number FROM pg WHERE event_type <> 'signup' UNION ALL SELECT doc_id, page_number FROM pg WHERE event_type = 'error' UNION ALL SELECT doc_id, page_number + 100000 FROM pg WHERE event_type = 'signup'),
n AS (SELECT doc_id, page_number, count(*) AS n FROM f GROUP BY ALL) SELECT doc_id, page_number, CASE WHEN n.n IS NULL THEN 'missing' WHEN e.page_number IS NULL THEN 'stray' ELSE 'duplicated' END AS problem FROM e FULL JOIN n USING (doc_id, page_number) WHERE n.n IS NULL OR e.page_number IS NULL OR n.n > 1""")
def page_integrity(spark, sf):
    p = sequence(spark, sf).select("doc_id", "page_number", "event_type")
    found = p.filter("event_type <> 'signup'").union(p.filter("event_type = 'error'")).union(p.filter("event_type = 'signup'").withColumn("page_number", F.col("page_number") + 100000))
    return sq.integrity(p, found)


@query(f"""WITH {PG}, x AS (SELECT doc_id, page_number, event_id // 7 AS v FROM pg), s AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY doc_id ORDER BY page_number) + 1 THEN 0 ELSE 1 END AS s FROM x),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY page_number) AS run FROM s) SELECT doc_id, CAST(run AS BIGINT) AS run, min(v) AS run_from, max(v) AS run_to FROM g GROUP BY doc_id, run""")
def contiguous_runs(spark, sf):
    x = sequence(spark, sf).select("doc_id", "page_number", F.expr("event_id div 7").alias("v"))
    return sq.contiguous_runs(x, "v", ["doc_id"], "page_number")


def dated(spark, sf):
    return sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("event_type").isin("view", "purchase"), F.col("day")).alias("date"))


DATED = PG + ", dt AS (SELECT doc_id, page_number, CASE WHEN event_type IN ('view', 'purchase') THEN day END AS date FROM pg)"
FILLED = DATED + """, own AS (SELECT *, strftime(date, '%Y-%m') AS o FROM dt), nx AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u,
 last_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, first_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM own),
mf AS (SELECT doc_id, page_number, date, coalesce(u, nx) AS month, o IS NULL AND coalesce(u, nx) IS NOT NULL AND (bf IS NULL OR coalesce(nx <> coalesce(u, nx), false)) AS unsure FROM nx)"""


@query(f"WITH {FILLED} SELECT doc_id, page_number, date, month, unsure FROM mf")
def month_fill(spark, sf):
    return sq.fill_months(dated(spark, sf))


@query(f"WITH {FILLED}, " + RANGES.format(src="SELECT doc_id, month, page_number FROM mf WHERE month IS NOT NULL", by="doc_id, month") + ", d AS (SELECT doc_id, month, max(date) AS unit_date, count(*) FILTER (WHERE unsure) AS n_unsure FROM mf GROUP BY ALL) SELECT r3.doc_id, r3.month, n_pages, page_ranges, unit_date, n_unsure FROM r3 JOIN d ON d.doc_id = r3.doc_id AND d.month = r3.month")
def month_groups(spark, sf):
    return sq.group_by_month(dated(spark, sf))


@query(f"WITH {DATED} SELECT doc_id, page_number, date, coalesce(date, last_value(date IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(date IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS completed FROM dt")
def series_completion(spark, sf):
    return sq.complete_by_series(dated(spark, sf))


@query(f"WITH {DATED}, x AS (SELECT *, last_value(date IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(date IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM dt) SELECT doc_id, page_number, date, CASE WHEN a = b THEN a END AS agreed FROM x")
def equal_on_both_sides(spark, sf):
    return sq.equal_on_both_sides(dated(spark, sf), "date")


@query(f"WITH {DATED} SELECT doc_id, page_number, date, row_number() OVER (PARTITION BY doc_id ORDER BY date NULLS LAST, page_number) AS place FROM dt")
def chronological_order(spark, sf):
    return sq.chronological(dated(spark, sf), "date", ["doc_id"], "page_number")


def foliated(spark, sf):
    p = sequence(spark, sf)
    f = F.when(F.col("event_type") == "signup", F.lit(None)).when(F.col("page_number") % 9 == 0, F.col("k") % 60).when(F.col("page_number") % 13 == 0, F.col("page_number") - 1).otherwise(F.col("page_number") + 2)
    return p.select("doc_id", "page_number", f.cast("long").alias("folio"))


FOL = PG + ", fo AS (SELECT doc_id, page_number, CAST(CASE WHEN event_type = 'signup' THEN NULL WHEN page_number % 9 = 0 THEN k % 60 WHEN page_number % 13 = 0 THEN page_number - 1 ELSE page_number + 2 END AS BIGINT) AS folio FROM pg)"


@query(f"""WITH {FOL}, x AS (SELECT *, lag(folio) OVER w AS a, lead(folio) OVER w AS b, count(folio) OVER (PARTITION BY doc_id, folio) AS n FROM fo WINDOW w AS (PARTITION BY doc_id ORDER BY page_number))
SELECT doc_id, page_number, folio, CASE WHEN coalesce(b = a + 2 AND (folio IS NULL OR folio <> a + 1) AND (folio IS NULL OR n > 1 OR abs(folio - (a + 1)) > 10), false) THEN a + 1 ELSE folio END AS corrected FROM x""")
def folio_correction(spark, sf):
    return sq.correct_folios(foliated(spark, sf))


@query(f"""WITH {FOL}, y AS (SELECT doc_id, page_number, folio // 3 AS folio FROM fo WHERE folio // 3 <> 0), s AS (SELECT *, CASE WHEN folio = lag(folio) OVER (PARTITION BY doc_id ORDER BY page_number) THEN 0 ELSE 1 END AS s FROM y), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY page_number) AS run FROM s),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g) SELECT doc_id, page_number, folio FROM n WHERE n <= 2""")
def credible_folios(spark, sf):
    return sq.credible_folios(foliated(spark, sf).withColumn("folio", F.expr("folio div 3")))


@query(f"""WITH {FOL}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS pos FROM fo), d AS (SELECT *, folio - pos AS d FROM p WHERE folio IS NOT NULL), v AS (SELECT doc_id, d, count(*) AS v FROM d GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, abs(d), d) AS r, sum(v) OVER (PARTITION BY doc_id) AS n FROM v) SELECT d.doc_id, page_number, folio FROM d JOIN b ON b.doc_id = d.doc_id AND r = 1 AND b.v * 2 >= n WHERE abs(d.d - b.d) <= 2""")
def confirmed_folios(spark, sf):
    return sq.confirmed_folios(foliated(spark, sf))


def marked(spark, sf):
    """Documents of even id carry a mark on every second page and a stray one at times."""
    p = sequence(spark, sf)
    mark = F.when(F.col("doc_id") % 2 == 0, (F.col("page_number") % 2 == 1) | (F.col("page_number") % 24 == 0)).otherwise(F.col("k") % 3 == 0)
    return p.select("doc_id", "page_number", mark.alias("mark"))


MARK = PG + ", mk AS (SELECT doc_id, page_number, CASE WHEN doc_id % 2 = 0 THEN page_number % 2 = 1 OR page_number % 24 = 0 ELSE k % 3 = 0 END AS mark FROM pg), al AS (SELECT doc_id, count(*) >= 8 AND count(*) FILTER (WHERE g = 2) >= 0.9 * count(g) AS alternates FROM (SELECT doc_id, page_number - lag(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) AS g FROM mk WHERE mark) GROUP BY doc_id)"


@query(f"WITH {MARK} SELECT doc_id, alternates FROM al")
def alternating_books(spark, sf):
    return sq.alternating(marked(spark, sf))


@query(f"""WITH RECURSIVE {MARK}, s AS (SELECT doc_id, page_number, mark, mark AS accepted FROM mk WHERE page_number = 1 UNION ALL
SELECT m.doc_id, m.page_number, m.mark, m.mark AND NOT (coalesce(al.alternates, false) AND s.accepted) FROM s JOIN mk m ON m.doc_id = s.doc_id AND m.page_number = s.page_number + 1 LEFT JOIN al ON al.doc_id = m.doc_id) SELECT doc_id, page_number, mark, accepted FROM s""")
def folio_rhythm(spark, sf):
    return sq.keep_rhythm(marked(spark, sf))


@query(f"""WITH {PG}, u AS (SELECT doc_id, page_number, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS own_type, k % 4 + 1 AS size FROM pg)
SELECT doc_id, page_number, own_type, size, coalesce(own_type, CASE WHEN size <= 2 THEN last_value(own_type IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) AS type FROM u""")
def type_inheritance(spark, sf):
    p = sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type")).alias("own_type"), (F.col("k") % 4 + 1).alias("size"))
    return sq.inherit_types(p)


@query(f"""WITH {PG}, o AS (SELECT *, CASE WHEN event_type = 'signup' OR page_number = 1 THEN 1 ELSE 0 END AS o FROM pg), s AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY page_number) AS segment FROM o)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n_pages FROM s GROUP BY doc_id, segment""")
def opened_segments(spark, sf):
    return sq.segments(sequence(spark, sf), "event_type = 'signup'")


def fingerprints(spark, sf):
    p = sequence(spark, sf)
    k, t = F.col("k"), F.col("event_type")
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return p.select(
        "doc_id", "page_number", F.when(t == "signup", 1 + k % 3).cast("int").alias("page_index"), F.when(t == "signup", F.lit(3)).alias("page_total"), F.when(t == "purchase", (k % 5).cast("string")).alias("serial"),
        F.when(t == "view", F.array(F.struct(F.lit("nic").alias("kind"), (k % 6).cast("string").alias("value")))).otherwise(none).alias("identifiers"), (t == "error").alias("opens"), F.when(k % 17 == 0, (k % 2).cast("string")).alias("label"), (k % 11 == 0).alias("closes"), (k % 13 == 0).alias("dense"), F.when(k % 5 == 0, F.col("page_number")).cast("int").alias("folio"), F.when(k % 19 == 0, 700.0).otherwise(612.0).alias("sheet_w"), F.lit(792.0).alias("sheet_h"),
    )


SEAM = PG + """, fp AS (SELECT doc_id, page_number AS p, CASE WHEN event_type = 'signup' THEN 1 + k % 3 END AS pi, CASE WHEN event_type = 'signup' THEN 3 END AS pt, CASE WHEN event_type = 'purchase' THEN k % 5 END AS se, CASE WHEN event_type = 'view' THEN k % 6 END AS id,
 event_type = 'error' AS op, CASE WHEN k % 17 = 0 THEN k % 2 END AS la, k % 11 = 0 AS cl, k % 13 = 0 AS de, CASE WHEN k % 5 = 0 THEN page_number END AS fo, CASE WHEN k % 19 = 0 THEN 700 ELSE 612 END AS sw FROM pg),
ub AS (SELECT f.doc_id, f.id FROM fp f JOIN (SELECT doc_id, count(id) AS bearing FROM fp GROUP BY doc_id) b ON b.doc_id = f.doc_id WHERE f.id IS NOT NULL GROUP BY f.doc_id, f.id HAVING max(bearing) >= 4 AND count(*) > 0.5 * max(bearing)),
nx AS (SELECT *, lead(p) OVER w AS rp, lead(pi) OVER w AS rpi, lead(pt) OVER w AS rpt, lead(se) OVER w AS rse, lead(id) OVER w AS rid, lead(op) OVER w AS rop, lead(la) OVER w AS rla, lead(cl) OVER w AS rcl, lead(de) OVER w AS rde, lead(fo) OVER w AS rfo, lead(sw) OVER w AS rsw FROM fp WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
sv AS (SELECT n.doc_id, n.p AS left_page, n.rp AS right_page, CASE WHEN rpt IS NOT NULL AND rpi = 1 THEN 2 WHEN rpt IS NOT NULL AND pt = rpt AND rpi = pi + 1 THEN 3 WHEN rpt IS NOT NULL AND pt = rpt AND rpi > pi THEN 4 WHEN rpt IS NOT NULL THEN 5 WHEN coalesce(pi = pt, false) THEN 6 WHEN se IS NOT NULL AND rse IS NOT NULL THEN 7
 WHEN n.id = rid AND ub.id IS NULL THEN 9 WHEN n.id <> rid THEN 10 WHEN rla IS NOT NULL AND coalesce(la <> rla, true) THEN 13 WHEN rop THEN 14 WHEN abs(sw - rsw) > 8 THEN 17 WHEN coalesce(rfo = fo + 1, false) THEN 19 WHEN (op OR la IS NOT NULL) AND NOT rop AND rla IS NULL THEN 22 WHEN de AND rde AND NOT cl THEN 23 ELSE 0 END AS rule, se = rse AS same
 FROM nx n LEFT JOIN ub ON ub.doc_id = n.doc_id AND ub.id = n.id WHERE n.rp IS NOT NULL),
se2 AS (SELECT doc_id, left_page, right_page, CASE WHEN rule IN (2, 6, 10, 13, 14, 17) OR rule = 7 AND NOT same THEN 'STARTS' WHEN rule = 0 THEN 'UNDECIDED' ELSE 'CONTINUES' END AS verdict, CAST(rule AS INTEGER) AS rule FROM sv)"""


@query(f"WITH {SEAM} SELECT doc_id, left_page, right_page, verdict, rule FROM se2")
def seams(spark, sf):
    return sm.decide(fingerprints(spark, sf))


@query(f"""WITH {SEAM}, a AS (SELECT f.doc_id, f.p, s.verdict, CASE WHEN s.verdict IS NULL OR s.verdict = 'STARTS' THEN 1 ELSE 0 END AS o FROM fp f LEFT JOIN se2 s ON s.doc_id = f.doc_id AND s.right_page = f.p), g AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY p) AS segment FROM a)
SELECT doc_id, CAST(segment AS BIGINT) AS segment, min(p) AS first_page, max(p) AS last_page, count(*) AS n_pages, count(*) FILTER (WHERE verdict = 'ATTACHMENT') AS n_attachments, count(*) FILTER (WHERE verdict = 'UNDECIDED') AS n_undecided FROM g GROUP BY doc_id, segment""")
def assembled_segments(spark, sf):
    p = fingerprints(spark, sf)
    return sm.assemble(p, sm.decide(p))


CNT = PG + ", c AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM pg)"


@query(f"WITH {CNT} SELECT DISTINCT c.doc_id, c.page_number FROM c, range(0, 12) j(j) WHERE c.n <= 12 OR floor(j.j * (c.n - 1) / 11) = c.i")
def sampled_evenly(spark, sf):
    return sq.sample_evenly(sequence(spark, sf), 12).select("doc_id", "page_number")


@query(f"WITH {CNT} SELECT doc_id, page_number FROM c WHERE i % greatest(1, n // 10) = 0 AND i // greatest(1, n // 10) < 10")
def sampled_by_stride(spark, sf):
    return sq.sample_strided(sequence(spark, sf), 10).select("doc_id", "page_number")


@query(f"WITH {CNT} SELECT doc_id, page_number FROM c WHERE i < 12 OR i % 8 = 0")
def sampled_book(spark, sf):
    return sq.sample_book(sequence(spark, sf)).select("doc_id", "page_number")


@query(f"WITH {DATED}, x AS (SELECT doc_id, page_number, strftime(date, '%Y-%m') AS m FROM dt), y AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM x) SELECT doc_id, page_number FROM y WHERE m IS NULL AND a <> b")
def pages_to_refine(spark, sf):
    x = dated(spark, sf).withColumn("m", F.date_format("date", "yyyy-MM"))
    return sq.refine_where_changed(x, "m").select("doc_id", "page_number")


def spans(spark, sf):
    e = read(spark, sf, "events")
    s = F.col("ts").cast("timestamp").cast("double")
    return e.select(F.col("user_id").alias("job_id"), F.floor(s).cast("double").alias("start_s"), (F.floor(s) + F.floor("value") * 600).cast("double").alias("end_s"), F.floor("value").cast("long").alias("bytes"))


SPAN = "sp AS (SELECT user_id AS job_id, CAST(floor(epoch(ts)) AS DOUBLE) AS start_s, CAST(floor(epoch(ts)) + floor(value) * 600 AS DOUBLE) AS end_s, CAST(floor(value) AS BIGINT) AS bytes FROM events)"
BUSY = "SELECT job_id, sum(greatest(0.0, end_s - greatest(start_s, coalesce(u, start_s)))) AS busy_s, count(*) AS n_spans FROM (SELECT *, max(end_s) OVER (PARTITION BY job_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM {t}) GROUP BY job_id"


@query(f"WITH {SPAN} " + BUSY.format(t="sp"))
def busy_time(spark, sf):
    return sq.busy_time(spans(spark, sf), ["job_id"])


@query(f"WITH {SPAN}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY end_s DESC) AS r FROM sp), g AS (SELECT job_id, count(*) AS n, min(end_s) AS oldest FROM r WHERE r <= 40 GROUP BY job_id) SELECT job_id, n, CASE WHEN n >= 3 AND 2000000000.0::DOUBLE > oldest THEN 25 * (2000000000.0::DOUBLE - oldest) / (n - 1) END AS eta_s FROM g")
def remaining_time(spark, sf):
    return sq.remaining_time(spans(spark, sf), ["job_id"], "end_s", 2_000_000_000.0, 25)


@query(f"WITH {SPAN}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY end_s DESC, start_s DESC) AS r FROM sp) WHERE r <= 30), b AS (" + BUSY.format(t="r") + ") SELECT b.job_id, CASE WHEN busy_s <> 0 THEN CAST(s AS DOUBLE) / busy_s END AS bytes_per_s FROM b JOIN (SELECT job_id, sum(bytes) AS s FROM r GROUP BY job_id) g ON g.job_id = b.job_id")
def recent_speed(spark, sf):
    from ..streaming.progress import recent_speed as speed

    return speed(spans(spark, sf))


SHIFT = PG + ", sh AS (SELECT doc_id, page_number, CASE WHEN page_number % 10 = 3 THEN day + INTERVAL 400 DAY ELSE day END::DATE AS date FROM pg)"


def shifted(spark, sf):
    return sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("page_number") % 10 == 3, F.date_add("day", 400)).otherwise(F.col("day")).alias("date"))


@query(f"WITH {SHIFT}, x AS (SELECT *, lag(date) OVER w AS a, lead(date) OVER w AS b FROM sh WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)) SELECT doc_id, page_number, date FROM x WHERE a <= b AND (date < a OR date > b)")
def dates_out_of_place(spark, sf):
    return sq.dates_out_of_place(shifted(spark, sf))


@query(f"""WITH {PG}, y AS (SELECT doc_id, page_number, make_date(2000 + CASE WHEN page_number % 11 = 0 THEN 7 ELSE 1 END, CAST(k % 3 + 1 AS INTEGER), 5) AS date FROM pg), n AS (SELECT doc_id, strftime(date, '%m-%d') AS dm, year(date) AS y, count(*) AS n FROM y GROUP BY ALL), t AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS years FROM n WINDOW w AS (PARTITION BY doc_id, dm))
SELECT y.doc_id, page_number, date FROM y JOIN t ON t.doc_id = y.doc_id AND t.dm = strftime(date, '%m-%d') AND t.y = year(date) WHERE years > 1 AND n * 2 < total""")
def doubtful_years(spark, sf):
    y = F.when(F.col("page_number") % 11 == 0, 2007).otherwise(2001)
    return sq.doubtful_years(sequence(spark, sf).select("doc_id", "page_number", F.make_date(y, (F.col("k") % 3 + 1).cast("int"), F.lit(5)).alias("date")))


@query(f"WITH {PG}, d AS (SELECT doc_id, page_number, CASE WHEN event_type = 'signup' THEN k % 5 END AS declared FROM pg) SELECT doc_id, page_number, declared, coalesce(page_number <= max(CASE WHEN declared > 0 THEN page_number + declared END) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS retained FROM d")
def retained_annexes(spark, sf):
    return sq.retain_declared(sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("event_type") == "signup", F.col("k") % 5).alias("declared")))


@query("WITH x AS (SELECT l_suppkey AS series, l_orderkey AS number FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)), s AS (SELECT *, CASE WHEN number = lag(number) OVER w + 1 THEN 0 ELSE 1 END AS s FROM x WINDOW w AS (PARTITION BY series ORDER BY number)), g AS (SELECT *, sum(s) OVER (PARTITION BY series ORDER BY number) AS run FROM s) SELECT series, CAST(run AS BIGINT) AS run, min(number) AS run_from, max(number) AS run_to, max(number) - min(number) + 1 AS n_numbers FROM g GROUP BY series, run")
def number_runs(spark, sf):
    x = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_orderkey").alias("number")).distinct()
    return sq.number_runs(x, ["series"], "number", "number")


@query()
def phantom_repair(spark, sf):
    p = sequence(spark, sf).select("doc_id", "page_number", F.col("code").cast("string").alias("code"))
    return sq.repair_phantoms(p, lambda a, b: osa(a, b, 2) <= 2)


@query()
def longest_series(spark, sf):
    return sq.longest_series(sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("event_type") == "purchase", F.col("k")).alias("code")))


@query()
def records_by_identity(spark, sf):
    return sq.records_by_identity(sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("event_type") == "purchase", (F.col("k") % 3).cast("string")).alias("identity")))


@query()
def folio_order(spark, sf):
    return sq.folio_order(foliated(spark, sf))


@query()
def smoothed_keys(spark, sf):
    return sq.smooth_keys(sequence(spark, sf).select("doc_id", "page_number", F.when(F.col("event_type") != "error", (F.col("page_number") / 6).cast("int").cast("string")).alias("key")), lambda a, b: osa(a, b, 1) <= 0)
