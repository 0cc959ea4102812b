"""Queries over units, audits and readings of names, codes and dates, on stand-ins from the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import names as nm
from ..operators import units as un
from .pages import PG, sequence
from .registry import query, read

TODAY = date(2026, 1, 1)
_CAND = """c AS (SELECT doc_id, page_number, CASE WHEN k % 3 = 0 THEN NULL ELSE 'c' || (k % 4) END AS prev, i, 'c' || ((k + i * (k % 3)) % 5) AS code, ((k * (7 + 3 * i)) % 100) / 100.0 AS score,
  (k + i) % 3 = 0 AS opens, (k + 2 * i) % 7 = 0 AS annex, (k + i) % 2 = 0 AS arguable FROM pg, (VALUES (0), (1), (2)) t(i) WHERE i < k % 4)"""


def _candidates(p):
    k = F.col("k")
    one = lambda i: F.struct(
        F.concat(F.lit("c"), ((k + i * (k % 3)) % 5).cast("string")).alias("code"),
        (((k * (i * 3 + 7)) % 100) / F.lit(100.0)).alias("score"),
        ((k + i) % 3 == 0).alias("opens"),
        ((k + i * 2) % 7 == 0).alias("annex"),
        ((k + i) % 2 == 0).alias("arguable"),
    )
    every = F.array(*[one(F.lit(i)) for i in range(3)])
    return p.select("doc_id", "page_number", "k", F.slice(every, 1, (k % 4).cast("int")).alias("candidates"), F.when(k % 3 != 0, F.concat(F.lit("c"), (k % 4).cast("string"))).alias("prev"))


@query(f"""WITH {PG}, {_CAND},
a AS (SELECT *, CASE WHEN prev IS NULL THEN opens OR NOT bool_or(opens) OVER (PARTITION BY doc_id, page_number) ELSE code = prev OR (opens AND NOT annex) END AS adm, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, i) AS r FROM c),
b AS (SELECT *, max(CASE WHEN adm THEN score END) OVER (PARTITION BY doc_id, page_number) AS top FROM a),
d AS (SELECT *, CAST(CASE WHEN prev IS NOT NULL AND top < 0.6 AND code = prev THEN score + 0.3 ELSE score END AS DOUBLE) AS adj FROM b),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY adm DESC, adj DESC, r) AS q FROM d),
g AS (SELECT doc_id, page_number, any_value(prev) AS prev, bool_or(adm) AS any_adm, max(CASE WHEN q = 1 THEN code END) AS c1, max(CASE WHEN q = 1 THEN least(adj, CASE WHEN prev IS NOT NULL AND top < 0.6 THEN 1.0 ELSE adj END) END) AS s1,
  max(CASE WHEN q = 2 AND adm THEN code END) AS c2, max(CASE WHEN q = 2 AND adm THEN adj END) AS s2, bool_or(opens AND annex) AS told, max(CASE WHEN r = 1 THEN code END) AS cr, max(CASE WHEN r = 1 THEN CAST(score AS DOUBLE) END) AS sr, bool_or(r = 1 AND arguable) AS ar FROM e GROUP BY ALL)
SELECT doc_id, page_number, CASE WHEN any_adm THEN c1 ELSE prev END AS code, CASE WHEN any_adm THEN round(s1, 4) WHEN told THEN 1.0 ELSE round(greatest(0.0, 1 - sr), 4) END AS confidence,
  CASE WHEN any_adm THEN (s1 < 0.6 AND c1 IS DISTINCT FROM prev) OR coalesce(c2 <> c1 AND s1 - s2 < 0.12, FALSE) ELSE NOT told AND sr >= 0.6 AND ar END AS ambiguous, CASE WHEN any_adm THEN c2 ELSE cr END AS runner_up FROM g""")
def selected_codes(spark, sf):
    return un.select_codes(_candidates(sequence(spark, sf)), previous="prev").select("doc_id", "page_number", "code", "confidence", "ambiguous", "runner_up")


@query()
def resolved_codes(spark, sf):
    return un.resolved_codes(_candidates(sequence(spark, sf)).select("doc_id", "page_number", "candidates", (F.col("k") % 5 == 0).alias("degraded")))


@query(f"""WITH RECURSIVE {PG}, x AS (SELECT doc_id, page_number AS position, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 5 = 0 THEN 1 + k % 3 ELSE page_number + 10 END AS number, CASE WHEN k % 13 = 0 THEN NULL ELSE 2000 + page_number // 12 END AS year FROM pg),
y AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, list({{'number': number, 'year': year}}) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS ahead FROM x),
r AS (SELECT doc_id, position, CAST(1 AS BIGINT) AS session, number AS ln, year AS ly FROM y WHERE position = 1
UNION ALL SELECT y.doc_id, y.position, r.session + CASE WHEN z THEN 0 ELSE 1 END, CASE WHEN z THEN r.ln ELSE y.number END, CASE WHEN z THEN r.ly ELSE y.year END FROM r JOIN y ON y.doc_id = r.doc_id AND y.position = r.position + 1,
  LATERAL (SELECT coalesce(y.n >= 3 AND y.number < r.ln AND (y.year IS NULL OR r.ly IS NULL OR y.year = r.ly) AND len(list_filter(y.ahead, lambda a: a.number = r.ln + 1 AND (a.year IS NULL OR r.ly IS NULL OR a.year = r.ly))) > 0, FALSE) AS z))
SELECT doc_id, position, session FROM r""")
def acts_in_series(spark, sf):
    k, p = F.col("k"), F.col("page_number")
    x = sequence(spark, sf).select("doc_id", p.alias("position"), F.when(k % 11 == 0, None).when(k % 5 == 0, k % 3 + 1).otherwise(p + 10).alias("number"), F.when(k % 13 != 0, F.expr("2000 + page_number div 12")).alias("year"))
    return un.acts_in_series(x)


@query()
def foliation(spark, sf):
    k, p = F.col("k"), F.col("page_number")
    folio = F.when(k % 4 == 0, None).when(k % 9 == 0, F.lit(1)).when(k % 10 == 1, k % 90).otherwise(p % 17 + 1)
    return un.foliation(sequence(spark, sf).select("doc_id", "page_number", folio.alias("folio"), (F.col("event_type") == "signup").alias("opens_alone")))


@query()
def academic_records(spark, sf):
    k = F.col("k")
    kind = F.when(F.col("event_type") == "signup", "old").when(F.col("event_type") == "error", "new").when(F.col("event_type") == "purchase", "certificate")
    return un.academic_records(sequence(spark, sf).select("doc_id", "page_number", kind.alias("kind"), F.when(k % 3 == 0, (k % 4).cast("string")).alias("code"), F.when(k % 2 == 0, (k % 3).cast("string")).alias("person")))


@query()
def payroll_documents(spark, sf):
    k = F.col("k")
    kinds = F.array(*[F.lit(x) for x in ("divider", "index", "certificate", "card", "person", "list", "voucher")])
    x = sequence(spark, sf).select(
        "doc_id", "page_number", F.get(kinds, (k % 9).cast("int")).alias("sheet"), F.when(k % 2 == 0, (k % 3).cast("string")).alias("key"), F.when(k % 5 < 2, k % 2).alias("number"),
        (k % 4 == 0).alias("goes_on"), F.when(k % 3 > 0, (k % 4).cast("string")).alias("person"), (k % 8 == 0).alias("blank"), (k % 4).alias("told_page"),
    )
    return un.payroll_documents(x)


_JOBS = """j AS (SELECT o_custkey AS batch, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS state, o_orderkey % 40 AS pages_total, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 40 ELSE o_orderkey % 40 // 2 END AS pages_done,
  CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderkey % 7 AS n_units, o_orderkey % 3 AS n_reviews FROM orders)"""


@query(f"""WITH {_JOBS} SELECT batch, count(*) AS documents, count(*) FILTER (state = 'done') AS done, CAST(0 AS BIGINT) AS failed, count(*) FILTER (state = 'running') AS running, CAST(0 AS BIGINT) AS paused, CAST(0 AS BIGINT) AS cancelled, count(*) FILTER (state = 'queued') AS queued,
  CAST(sum(pages_total) AS BIGINT) AS pages_total, CAST(sum(pages_done) AS BIGINT) AS pages_done, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(n_units) AS BIGINT) AS n_units, CAST(sum(n_reviews) AS BIGINT) AS n_reviews, CASE WHEN sum(pages_total) > 0 THEN round(100.0::DOUBLE * sum(pages_done) / sum(pages_total), 2) ELSE 0.0::DOUBLE END AS percent FROM j GROUP BY batch""")
def batch_summary(spark, sf):
    k = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    j = read(spark, sf, "orders").select(
        F.col("o_custkey").alias("batch"), F.when(done, "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("state"), (k % 40).alias("pages_total"),
        F.when(done, k % 40).otherwise(F.expr("o_orderkey % 40 div 2")).alias("pages_done"), F.floor("o_totalprice").cast("long").alias("bytes"), (k % 7).alias("n_units"), (k % 3).alias("n_reviews"),
    )
    return un.batch_summary(j)


@query(f"WITH {PG}, x AS (SELECT DISTINCT doc_id, page_number // 3 AS page_number, event_type AS kind FROM pg) SELECT doc_id, kind, count(*) AS n_pages FROM x GROUP BY ALL")
def nucleus_pages(spark, sf):
    return un.pages_with(sequence(spark, sf).select("doc_id", F.expr("page_number div 3").alias("page_number"), F.col("event_type").alias("kind")), ["doc_id"], "kind")


@query("SELECT event_type AS template, count(*) AS n_pages FROM (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) % 50 AS p, event_type FROM events) GROUP BY 1")
def page_templates(spark, sf):
    x = read(spark, sf, "events").select(F.struct("user_id", F.floor("value").cast("long") % 50).alias("page_number"), F.col("event_type").alias("template"))
    return un.pages_with(x, [], "template")


@query('SELECT o_custkey AS name, max(o_orderdate) AS "at", count(*) AS units, CAST(sum(o_orderkey % 9) AS BIGINT) AS pages FROM orders GROUP BY 1')
def groups_by_pages(spark, sf):
    g = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.max("o_orderdate").alias("at"), F.count("*").alias("units"), F.sum(F.col("o_orderkey") % 9).alias("pages"))
    return un.ordered_groups(g, "pages")


@query("""WITH x AS (SELECT user_id AS run, event_id AS "at", CAST(floor(value) AS BIGINT) AS done, value AS speed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT run, max("at") AS "at", arg_max(done, "at") AS done, avg(speed) AS speed FROM x GROUP BY run, CASE WHEN n > 8 THEN i // 2 ELSE i END""")
def thinned_samples(spark, sf):
    x = read(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("at"), F.floor("value").cast("long").alias("done"), F.col("value").alias("speed"))
    return un.thinned(x, ["run"], 8)


@query("SELECT a.l_orderkey AS doc_id, CAST(a.l_linenumber AS BIGINT) AS first_page, a.l_partkey AS unit, b.l_suppkey AS file_name FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag <> 'R') b USING (l_orderkey, l_linenumber)")
def units_with_files(spark, sf):
    x = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("first_page"), F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("file_name"), "l_returnflag")
    return un.with_files(x.select("doc_id", "first_page", "unit"), x.filter("l_returnflag <> 'R'"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM labels) ORDER BY md5('7:' || o_orderkey), 1 LIMIT 100")
def audit_sample(spark, sf):
    return un.random_sample(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", 100, 7, read(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line, coalesce(nullif(concat_ws(' · ', CASE WHEN l_orderkey % 4 = 0 THEN 'Sin fecha' END, CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 3 = 0 THEN 'Sin RE' END, CASE WHEN l_suppkey % 5 = 0 THEN 'RE por confirmar' END,
  CASE WHEN l_returnflag = 'R' THEN 'En Revisión' END), ''), 'OK') AS alert FROM lineitem""")
def delivery_alerts(spark, sf):
    c = F.col
    alert = un.audit_alert(F.when(c("l_orderkey") % 4 != 0, c("l_shipdate")), c("l_linenumber") % 2 == 0, F.when(c("l_partkey") % 3 != 0, c("l_partkey")), c("l_suppkey") % 5 == 0, c("l_returnflag") == "R")
    return read(spark, sf, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").cast("long").alias("line"), alert.alias("alert"))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_orderkey % 3 AS m, lpad(CAST(o_orderkey * 7919 % 10000000000000 AS VARCHAR), 13, '0') AS n, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT id, CASE k WHEN 0 THEN CASE m WHEN 0 THEN [] WHEN 1 THEN ['not in its fragment'] ELSE ['not whole'] END WHEN 1 THEN CASE m WHEN 0 THEN ['no value'] WHEN 1 THEN [] ELSE ['fragment says otherwise'] END
  WHEN 2 THEN CASE m WHEN 0 THEN ['no candidates'] ELSE [] END ELSE CASE m WHEN 0 THEN ['nothing sought'] ELSE [] END END AS objections FROM f""")
def evidence_objections(spark, sf):
    c, d = F.col, F.col("o_orderdate")
    k, m = c("o_orderkey") % 4, c("o_orderkey") % 3
    n = F.lpad((c("o_orderkey") * 7919 % 10000000000000).cast("string"), 13, "0")
    spaced = F.regexp_replace(n, "^(\\d{4})(\\d{5})", "$1 $2.")
    value = F.when(k == 0, F.when(m == 2, F.concat(F.lit("RE"), F.substring(n, 1, 12))).otherwise(F.concat(F.lit("RE"), n))).when(k == 1, F.when(m != 0, F.date_format(d, "yyyy-MM-dd")))
    fragment = F.when(k == 0, F.concat(F.lit("No. RE "), spaced, F.when(m == 1, "9").otherwise(" de"))).when(k == 1, F.concat(F.lit("Bogotá, "), F.date_format(F.when(m == 2, F.date_add(d, 1)).otherwise(d), "dd/MM/yyyy")))
    x = read(spark, sf, "orders").select(
        c("o_orderkey").alias("id"), F.when(k == 1, "date").otherwise("re").alias("parameter"), F.when(k == 2, "to_validate").when(k == 3, "not_found").otherwise("found").alias("state"), value.alias("value"), fragment.alias("fragment"),
        F.lit("ocr").alias("method"), F.when(m == 0, 0).otherwise(2).alias("n_candidates"), F.when(m != 0, "all pages").alias("sought"),
    )
    return x.select("id", un.evidence_objections(TODAY).alias("objections"))


_WORDS = "w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents)"
_THRICE = "|".join(c * 3 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _words(spark, sf):
    return read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).select(F.upper("word").alias("word")).distinct()


@query(f"""WITH {_WORDS} SELECT word, word NOT IN ({", ".join(f"'{x}'" for x in nm.CONNECTORS + nm.SHORT_WORDS)}) AND (len(word) <= 2 OR NOT regexp_matches(word, '[AEIOUY]') OR regexp_matches(word, '{_THRICE}') OR regexp_matches(word, '[^AEIOUY]{{4}}')
  OR (NOT regexp_matches(word, '^.?[AEIOUY]') AND word[1:2] NOT IN ({", ".join(f"'{x}'" for x in nm.BEGINNINGS)})) OR regexp_matches(word, 'J[^AEIOUH]|Q[^U]|Q$')) AS doubtful,
  word IN ({", ".join(f"'{x}'" for x in nm.CONNECTORS)}) OR (len(word) >= 2 AND regexp_matches(word, '[AEIOU]') AND NOT (len(word) >= 7 AND len(list_distinct(string_split(word, ''))) <= 3) AND NOT (len(word) >= 9 AND len(list_distinct(string_split(word, ''))) <= 4)
  AND NOT regexp_matches(word, '{_THRICE}') AND NOT regexp_matches(word, '[^AEIOUY]{{5}}')) AS possible FROM w""")
def words_of_names(spark, sf):
    return _words(spark, sf).select("word", nm.doubtful_name_word("word").alias("doubtful"), nm.possible_name_word("word").alias("possible"))


@query("""SELECT c_custkey AS id, CASE len(c) WHEN 6 THEN 1900 + CAST(c[1:2] AS INT) WHEN 9 THEN CASE WHEN 1900 + CAST(c[3:4] AS INT) >= 1950 THEN 1900 + CAST(c[3:4] AS INT) END WHEN 10 THEN CASE WHEN CAST(c[3:6] AS INT) BETWEEN 1950 AND 2099 THEN CAST(c[3:6] AS INT) END END AS year
FROM (SELECT c_custkey, CAST(c_custkey * 104729 % 10000000 * CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 97 ELSE 613 END AS VARCHAR) AS c FROM customer)""")
def years_of_codes(spark, sf):
    k = F.col("c_custkey")
    code = (k * 104729 % 10000000 * F.when(k % 4 == 0, 1).when(k % 4 == 1, 97).otherwise(613)).cast("string")
    return read(spark, sf, "customer").select(k.alias("id"), nm.code_year(code).alias("year"))


@query("SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, CASE l_linenumber % 4 WHEN 3 THEN NULL ELSE CAST(l_partkey % 200 + 1 AS VARCHAR) END AS folio FROM lineitem")
def folios_of_corners(spark, sf):
    n, p = F.col("l_linenumber").cast("long"), F.col("l_partkey") % 200 + 1
    text = F.when(n % 4 == 0, F.concat_ws("", n.cast("string"), F.lit(" 0"), p.cast("string"), F.lit("/V"))).when(n % 4 == 1, F.concat(F.lit("77"), F.lit(" "), p.cast("string"), F.lit(" | l"))).when(n % 4 == 2, F.concat(F.lit("No "), p.cast("string"))).otherwise("N/A")
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("page"), nm.corner_folio(text, F.when(n % 4 != 2, n + 500)).alias("folio"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d WHEN 3 THEN CAST(d + 3 AS DATE) WHEN 4 THEN NULL ELSE d END AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def page_dates(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    f = lambda x, s: F.date_format(x, s)
    text = (
        F.when(k == 0, F.concat(F.lit("Santa Marta, "), f(d, "d/M/yyyy"), F.lit(" plazo del "), f(F.date_add(d, 40), "dd/MM/yyyy")))
        .when(k == 1, F.concat(F.lit("DÍA | MES | AÑO  | 77 | "), f(d, "dd | MM | yyyy"), F.lit(" hoy 01/01/2025")))
        .when(k == 2, F.concat(F.lit("NIC 1234567 DIA  MES  ANO "), f(d, "d MM yy"), F.lit(" .")))
        .when(k == 3, F.concat(f(d, "dd-MM-yyyy"), F.lit(" y luego "), f(F.date_add(d, 3), "d/M/yyyy")))
        .when(k == 4, F.concat(F.lit("Resolución 5 del "), f(d, "d/M/yyyy"), F.lit(" estatura")))
        .otherwise(F.concat(F.lit("visto el "), f(d, "dd/MM/yyyy"), F.lit(" en Ley 142 de 11/07/1994")))
    )
    # two-figure years are of this century
    day = F.when((k == 2) & (F.year(d) < 2000), F.to_date(d)).otherwise(dt.page_date(text, TODAY))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CAST(o_orderdate AS DATE) + 9 ELSE NULL END AS day FROM orders")
def unit_dates(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    names = F.create_map(*[F.lit(x) for m, v in dt.MONTHS.items() if m != "setiembre" for x in (v, m)])
    words = F.create_map(*[F.lit(x) for w, v in dt.DAY_WORDS.items() if w not in ("UN", "PRIMERO", "VEINTIUN", "TREINTA Y UN") for x in (v, w)])
    closing = F.concat(F.lit("Dada en Cartagena, a los "), F.lower(F.try_element_at(words, F.dayofmonth(d))), F.lit(" días del mes de "), F.try_element_at(names, F.month(d)), F.lit(" de "), F.date_format(d, "yyyy"), F.lit(". Recibida 01/01/2024"))
    late = F.array(F.date_format(d, "d/M/yyyy"), F.date_format(F.date_add(d, 9), "dd-MM-yyyy"), F.lit("según decreto 8 del 1/1/2020"))
    pages = F.when(k == 2, late).otherwise(F.array(F.lit("sin fecha")))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), un.unit_date(F.when(k == 0, d), F.when(k == 1, closing), pages, TODAY).alias("day"))


_BOXES = """r AS (SELECT o_custkey AS box, o_orderkey AS stamp, 'RE2310' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS code, CAST(o_orderdate AS DATE) AS day FROM orders)"""


@query()
def crossed_codes(spark, sf):
    o = read(spark, sf, "orders")
    code = F.concat(F.lit("RE2310"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    printed = o.select(F.col("o_custkey").alias("box"), code.alias("code"), F.to_date("o_orderdate").alias("printed_on"))
    hand = F.concat(F.lit("23D"), F.translate(F.substring(code, 7, 9), "15", "IS"))
    r = o.select(F.col("o_custkey").alias("box"), F.col("o_orderkey").alias("stamp"), F.explode(F.array(hand, F.substring(code, 3, 13))).alias("read"), F.to_date("o_orderdate").alias("stamped"))
    return un.crossed_codes(r, printed)


_PHRASES = "f AS (SELECT DISTINCT upper(p_type) AS phrase FROM part)"


@query(f"""WITH {_PHRASES}, t AS (SELECT p_partkey AS id, string_split('VISTO EL ' || CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN replace(upper(p_type), 'E', 'X') ELSE replace(upper(p_type), 'IN', 'NI') END || ' DE HOY', ' ') AS w FROM part),
s AS (SELECT id, n, i - 1 AS position, array_to_string(w[i:i + n - 1], ' ') AS win FROM t, (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM f), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
d AS (SELECT DISTINCT win, n FROM s), h AS (SELECT win, phrase, damerau_levenshtein(win, phrase) AS distance FROM d JOIN f ON len(string_split(phrase, ' ')) = n AND abs(len(win) - len(phrase)) <= len(phrase) // 8),
b AS (SELECT id, phrase, min(distance) AS distance, arg_min(position, distance * 1000 + position) AS position FROM s JOIN h USING (win) WHERE distance <= len(phrase) // 8 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance = 0 DESC, len(phrase) DESC, position, distance, phrase DESC) AS r FROM b) SELECT id, phrase, CAST(distance AS INT) AS distance FROM o WHERE r = 1""")
def typed_by_phrase(spark, sf):
    p = read(spark, sf, "part")
    t, k = F.upper("p_type"), F.col("p_partkey") % 3
    text = F.concat(F.lit("VISTO EL "), F.when(k == 0, t).when(k == 1, F.replace(t, F.lit("E"), F.lit("X"))).otherwise(F.replace(t, F.lit("IN"), F.lit("NI"))), F.lit(" DE HOY"))
    return un.best_phrase(un.phrase_hits(p.select(F.col("p_partkey").alias("id"), text.alias("text")), p.select(t.alias("phrase")).distinct()))


@query("SELECT doc_id, (source IS NULL) OR (lang <> 'en' AND len(coalesce(text, '')) < 200) AS degraded, len(text) >= 1200 AND NOT starts_with(text, 'A') AND NOT (len(regexp_extract_all(text, '[a-záéíóúüñ][A-ZÁÉÍÓÚÜÑ]')) >= 10 AND len(regexp_extract_all(text, '[a-záéíóúüñ][A-ZÁÉÍÓÚÜÑ]')) * 1000.0 / len(text) >= 11.0) AS dense FROM documents")
def thin_and_dense_pages(spark, sf):
    provenance = F.when(F.col("lang") == "en", "text_layer").otherwise("ocr")
    provenance = F.when(F.col("lang").isNotNull(), provenance)
    return read(spark, sf, "documents").select(
        "doc_id", un.is_degraded(F.col("source").isNull(), provenance, F.length(F.coalesce("text", F.lit("")))).alias("degraded"), un.is_dense_body("text", F.startswith("text", F.lit("A"))).alias("dense")
    )


@query("""WITH x AS (SELECT l_suppkey AS book, l_orderkey * 10 + l_linenumber AS row, CAST(l_partkey % 300 * 997 AS VARCHAR) AS d, CASE WHEN l_partkey % 7 = 0 THEN 'ANA' ELSE l_shipmode END AS n FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
g AS (SELECT book, d, count(*) AS n_rows FROM x WHERE len(d) >= 5 GROUP BY ALL HAVING min(n) <> max(n)) SELECT book, row, d AS number, n_rows FROM x JOIN g USING (book, d)""")
def ids_of_several_names(spark, sf):
    c = F.col
    name = F.when(c("l_partkey") % 7 == 0, "aná").otherwise(F.concat(c("l_returnflag"), c("l_linestatus")))
    number = F.concat_ws(".", F.substring((c("l_partkey") % 300 * 997).cast("string"), 1, 2), F.substring((c("l_partkey") % 300 * 997).cast("string"), 3, 9))
    x = read(spark, sf, "lineitem").select(c("l_suppkey").alias("book"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("row"), number.alias("person_id"), name.alias("name"))
    return un.ids_of_several_names(x)


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN lpad(CAST(n AS VARCHAR), 3, '0') || '-' || y WHEN 1 THEN lpad(CAST(n AS VARCHAR), 3, '0') || '-20' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') WHEN 2 THEN lpad(CAST(n AS VARCHAR), 3, '0') || '-' || y
  WHEN 3 THEN CASE WHEN n < 10 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END WHEN 4 THEN '0' || (1000 + n) ELSE lpad(CAST(n AS VARCHAR), 3, '0') || '-' || y END AS code FROM (SELECT o_orderkey, o_orderkey % 130 AS n, year(o_orderdate) AS y FROM orders)""")
def faculty_codes(spark, sf):
    from ..functions.numbers import faculty_code

    k, n, y = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 130).cast("string"), F.date_format("o_orderdate", "yyyy")
    number = F.when(k == 0, F.concat(n, F.lit("-"), y)).when(k == 1, F.concat(F.lit("N°"), n, F.lit("--"), F.substring(y, 3, 2))).when(k == 4, F.concat(F.lit("0"), (F.col("o_orderkey") % 130 + 1000).cast("string"))).when(k == 5, F.concat(n, F.lit("-"))).otherwise(n)
    following = F.when(k == 2, F.array(F.lit("DE"), F.concat(y, F.lit(",")))).when(k == 5, F.array(y)).otherwise(F.array(F.lit("POR"), y))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), faculty_code(number, following).alias("code"))
