"""Queries over whole texts, codes, letters and readings of numbers, on the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import filenames as fn
from ..functions import letters as lt
from ..functions import names as nm
from ..functions import numbers as nb
from ..functions import text as tx
from ..functions.dates import month_of
from ..operators import candidates as cd
from ..operators import consensus as cs
from ..operators import units as un
from .registry import query, read

TODAY = date(2026, 1, 1)
_NORMAL = "trim(regexp_replace(upper(replace(strip_accents({}), 'ß', 'SS')), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_NORMAL.format('x')}) AS lines FROM documents")
def lines_of_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.normalised_lines(F.coalesce("text", F.lit(""))).alias("lines"))


@query("""SELECT doc_id, len(list_filter(range(1, len(l) - 2), lambda i: l[i] <> '' AND l[i] = l[i + 1] AND l[i] = l[i + 2] AND l[i] = l[i + 3])) > 0 AS loops
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)""")
def looping_lines(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.has_looping_lines(F.coalesce("text", F.lit(""))).alias("loops"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 0 THEN CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '^[\p{P}]*(?:\p{L}{2,}|\d[\d.,/-]*|[A-Z]{1,3}-?\d+|[aeoyAEOY])[\p{P}]*$'))) AS DOUBLE) / len(w) ELSE 0.0 END AS share FROM t""")
def garbage_shares(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.garbage_share(F.coalesce("text", F.lit(""))).alias("share"))


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey = l_suppkey OR l_linenumber % 3 = 0 OR (l_linenumber % 3 = 1 AND contains(',' || l_suppkey || ',', ',' || l_partkey || ',')) AS written FROM lineitem""")
def numbers_in_texts(spark, sf):
    c = F.col
    k = c("l_linenumber") % 3
    n = c("l_partkey").cast("string")
    marked = F.concat(F.regexp_replace(n, "(\\d)(\\d)$", "$1.$2"), F.lit(" pesos"))
    text = F.when(k == 0, F.concat(F.lit("C.C. "), marked)).when(k == 1, F.concat(F.lit("folio "), c("l_suppkey").cast("string"), F.lit(" / x"))).otherwise(F.concat(F.lit("n. 7"), n, F.lit("3 y "), c("l_suppkey").cast("string")))
    return read(spark, sf, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").cast("long").alias("line"), tx.number_in_text(n, text).alias("written"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def months_of_dates(spark, sf):
    return read(spark, sf, "orders").groupBy(month_of("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN 'RE' || lpad(CAST(o_orderkey * 7919 AS VARCHAR), 13, '0') END AS code FROM orders""")
def repaired_codes(spark, sf):
    k, d = F.col("o_orderkey"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 13, "0")
    misread = F.translate(d, "0158", "OISB")
    raw = F.when(k % 4 == 0, F.concat(F.lit("RE"), misread)).when(k % 4 == 1, F.concat(F.lit("B E-"), d)).when(k % 4 == 2, F.concat(F.lit("pe "), F.substring(d, 1, 5), F.lit("."), F.substring(d, 6, 8))).otherwise(F.concat(F.lit("RE"), F.substring(d, 1, 12)))
    return read(spark, sf, "orders").select(k.alias("id"), nb.repair_code(raw).alias("code"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 3 THEN CAST(c_custkey + 1000000 AS VARCHAR) END AS account FROM customer")
def account_numbers(spark, sf):
    k, n = F.col("c_custkey"), (F.col("c_custkey") + 1000000).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("usuario del nic: "), n, F.lit(" de"))).when(k % 4 == 1, F.concat(F.lit("Cuenta interna No. "), n)).when(k % 4 == 2, F.concat(F.lit("clinic 1234567 NIC "), n)).otherwise(F.concat(F.lit("NIC "), n, F.lit("99")))
    return read(spark, sf, "customer").select(k.alias("id"), nb.account_number(text).alias("account"))


@query("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line, coalesce(CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END, CASE WHEN l_linenumber % 2 > 0 THEN l_suppkey END) AS value, l_linenumber % 3 > 0 AND l_linenumber % 2 > 0 AND l_partkey <> l_suppkey AS doubt FROM lineitem""")
def two_readings(spark, sf):
    c = F.col
    value = nb.reconcile_two(F.when(c("l_linenumber") % 3 > 0, c("l_partkey")).cast("string"), F.when(c("l_linenumber") % 2 > 0, c("l_suppkey")).cast("string"))
    return read(spark, sf, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").cast("long").alias("line"), value["value"].cast("long").alias("value"), value["doubt"].alias("doubt"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN 'FV' END AS series, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END AS number FROM orders")
def document_numbers(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.format_string("FV %09d del", k)).when(k % 3 == 1, F.concat(F.lit("  FV-"), k.cast("string"))).otherwise(F.lit("del FV 12"))
    n = nb.document_number(text)
    return read(spark, sf, "orders").select(k.alias("id"), n["series"].alias("series"), n["number"].alias("number"))


@query("""WITH c AS (SELECT l_suppkey AS box, CASE WHEN l_suppkey % 3 > 0 OR l_orderkey % 9 = 0 THEN 20 + l_orderkey % 9 ELSE 23 END AS prefix, l_partkey % 11 > 0 AS long FROM lineitem),
g AS (SELECT box, prefix, count(*) AS n FROM c WHERE long GROUP BY box, prefix), h AS (SELECT *, sum(n) OVER (PARTITION BY box) AS total FROM g)
SELECT box, CAST(prefix AS VARCHAR) AS prefix, n, CAST(total AS BIGINT) AS total FROM h WHERE total >= 5 AND n / total >= 0.8""")
def code_patterns(spark, sf):
    c = F.col
    prefix = F.when((c("l_suppkey") % 3 > 0) | (c("l_orderkey") % 9 == 0), c("l_orderkey") % 9 + 20).otherwise(23).cast("string")
    body = F.when(c("l_partkey") % 11 > 0, F.lpad(c("l_partkey").cast("string"), 9, "0")).otherwise(F.lit("12"))
    return cs.code_pattern(read(spark, sf, "lineitem").select(c("l_suppkey").alias("box"), F.concat(F.lit("RE "), prefix, F.lit("-"), body).alias("code")), "box")


@query("""SELECT l_suppkey AS box, count(DISTINCT CASE WHEN l_returnflag <> 'A' THEN l_partkey END) >= 3 AND count(DISTINCT CASE WHEN l_returnflag <> 'A' THEN l_partkey END) > 2 * count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS is_faculty FROM lineitem GROUP BY 1""")
def faculty_files(spark, sf):
    return cs.faculty_file(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("box"), F.when(F.col("l_returnflag") == "A", "house").otherwise("faculty").alias("kind"), F.col("l_partkey").alias("code")), "box")


# pages with headings of every shape: %1 is a number of five figures, %2 one of at most three, %3 a year
_HEADINGS = (
    "Visto\nRESOLUCIÓN No. %1 del rector",
    "RES0LUClÓN N° %1_____\nPor la cual",
    "la resolución interna N°%2- %3 manda",
    "Artículo\nRESOLUCIÓN\nN* %1\nfin",
    "RESOL No.%1",
    "la resolución de directorio %3",
    "RESOLUCION INTERNA N — %3 y REVOLUCION",
    "solución No. %1 resolusion numero 03-%3 RESOLUCIONES: %1",
    "Modificada por la RESOLUCION No. %1",
    "■ RESOLUCION NO %1 DO 2023",
)


def _headings(spark, sf):
    k = F.col("o_orderkey")
    five, three, year = F.lpad((k % 90000 + 200).cast("string"), 5, "0"), (k % 800 + 10).cast("string"), F.year("o_orderdate").cast("string")
    text = F.get(F.array(*[F.lit(x) for x in _HEADINGS]), (k % len(_HEADINGS)).cast("int"))
    for mark, value in (("%1", five), ("%2", three), ("%3", year)):
        text = F.replace(text, F.lit(mark), value)
    return read(spark, sf, "orders").select(k.alias("id"), text.alias("text"))


_FOUND = """x AS (SELECT o_orderkey AS id, o_orderkey % 10 AS k, lpad(CAST(o_orderkey % 90000 + 200 AS VARCHAR), 5, '0') AS n, lpad(CAST(o_orderkey % 800 + 10 AS VARCHAR), 3, '0') AS m, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
w(k, line, token, term, distance, kind, official, opens, arguable, cited) AS (VALUES (0, 1, 0, 'RESOLUCION', 0, 'n', TRUE, FALSE, TRUE, FALSE), (1, 0, 0, 'RESOLUCION', 1, 'n', TRUE, TRUE, TRUE, FALSE), (2, 0, 1, 'RESOLUCION', 0, 'y', TRUE, FALSE, FALSE, FALSE),
  (3, 1, 0, 'RESOLUCION', 0, 'n', TRUE, TRUE, TRUE, FALSE), (4, 0, 0, 'RESOL', 0, 'n', TRUE, TRUE, TRUE, FALSE), (7, 0, 3, 'RESOLUCION', 1, 'f', TRUE, FALSE, FALSE, FALSE), (7, 0, 6, 'RESOLUCIONES', 0, 'n', FALSE, FALSE, FALSE, FALSE),
  (8, 0, 3, 'RESOLUCION', 0, 'n', TRUE, FALSE, FALSE, TRUE), (9, 0, 1, 'RESOLUCION', 0, 'n', TRUE, TRUE, TRUE, FALSE)),
found AS (SELECT id, line, token, term, distance, CASE kind WHEN 'n' THEN n WHEN 'y' THEN m || '-' || y ELSE '003-' || y END AS code, official, opens, arguable, cited FROM x JOIN w USING (k))"""


@query(f"WITH {_FOUND} SELECT id, line, token, term, distance, code, official FROM found")
def code_candidates(spark, sf):
    return cd.code_candidates(_headings(spark, sf)).select("id", "line", "token", "term", "distance", "code", "official")


@query(f"WITH {_FOUND} SELECT id, code, cited, opens, arguable FROM found")
def opening_codes(spark, sf):
    return cd.scored(cd.code_candidates(_headings(spark, sf))).select("id", "code", "cited", "opens", "arguable")


@query()
def codes_of_texts(spark, sf):
    """From texts to the code that each page belongs to: orders are pages of their customer's file."""
    pages = _headings(spark, sf).join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id")), "id").withColumnRenamed("id", "page_number")
    found = cd.of_pages(cd.scored(cd.code_candidates(pages)), ["doc_id", "page_number"])
    x = pages.select("doc_id", "page_number").join(found, ["doc_id", "page_number"], "left").withColumn("degraded", F.lit(False))
    return un.resolved_codes(x)


# pages that open a letter, go on with one, or do neither: %1 is a date, %2 a phrase of four words at least
_LETTERS = (
    "Cartagena, %1\nSeñores\nAFINIA\nAsunto: Reclamo por %2\nmes de marzo\nCordial saludo",
    "SEÑORA GERENTE\nREF. %2 en la factura\n",
    "Asunto: 03 RECLAMO\n%2",
    "ABOGADO T.P. 123\n2. Que la empresa %2\nAsunto",
    "*\nla empresa no ha dado respuesta a %2",
    "Doctor\nASUNTO\nReferencia Solicitud de %2\notra",
)


def _letters(spark, sf):
    k = F.col("o_orderkey")
    phrase = F.concat(F.lit("alto consumo de "), F.lower(F.translate("o_orderstatus", "FOP", "abc")), F.lit("gua en casa"))
    text = F.get(F.array(*[F.lit(x) for x in _LETTERS]), (k % 6).cast("int"))
    text = F.replace(F.replace(text, F.lit("%1"), F.date_format("o_orderdate", "d/M/yyyy")), F.lit("%2"), phrase)
    return read(spark, sf, "orders").select(k.alias("id"), "o_custkey", text.alias("text")).transform(lambda x: lt.with_letter(x, "text", TODAY))


_PHRASE = "'alto consumo de ' || translate(o_orderstatus, 'FOP', 'abc') || 'gua en casa'"


@query(f"""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, {_PHRASE} AS p, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT id, CASE k WHEN 0 THEN 'Reclamo por ' || p || ' mes de marzo' WHEN 1 THEN p || ' en la factura' WHEN 5 THEN 'Solicitud de ' || p || ' otra' END AS subject, CASE WHEN k = 0 THEN d END AS day, k IN (3, 4) AS goes_on,
  CASE k WHEN 0 THEN 'Reclamo por ' || p WHEN 1 THEN p || ' en la factura' WHEN 2 THEN '03 RECLAMO' END AS line FROM x""")
def letters_of_pages(spark, sf):
    x = _letters(spark, sf)
    return x.select("id", F.col("letter.subject").alias("subject"), F.col("letter.day").alias("day"), lt.continues_letter("text", F.col("letter").isNotNull()).alias("goes_on"), lt.subject_line("text").alias("line"))


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey AS box, o_orderkey % 6 AS k, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 6 IN (0, 1, 5)),
y AS (SELECT *, lag(id) OVER w AS other, lag(k) OVER w AS k2, lag(s) OVER w AS s2, lag(d) OVER w AS d2 FROM x WINDOW w AS (PARTITION BY box ORDER BY s, d, k, id))
SELECT id, other, k = k2 AND CASE WHEN k = 0 THEN d = d2 ELSE s = s2 END AS same FROM y WHERE other IS NOT NULL""")
def copies_of_letters(spark, sf):
    from pyspark.sql import Window

    x = _letters(spark, sf).filter("letter IS NOT NULL").select("id", F.col("o_custkey").alias("box"), "letter", F.col("id") % 6)
    x = x.join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d")), "id")
    w = Window.partitionBy("box").orderBy("s", "d", F.col("id") % 6, "id")
    x = x.withColumns({"other": F.lag("id").over(w), "before": F.lag("letter").over(w)}).filter("other IS NOT NULL")
    return x.select("id", "other", lt.same_letter(F.col("letter"), F.col("before")).alias("same"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Gerencia ' || c_name WHEN 2 THEN 'Ana Pérez ' || c_custkey END AS sender, CASE c_custkey % 4 WHEN 0 THEN upper(replace(c_name, '#', '')) WHEN 1 THEN 'GERENCIA ' || upper(replace(c_name, '#', '')) WHEN 2 THEN 'ANA PEREZ ' || c_custkey END AS key FROM customer""")
def senders(spark, sf):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    text = (
        F.when(k == 0, F.concat(F.lit("Bogotá\nSeñores:\nla oficina\nOficina de Reclamos\n  "), n, F.lit("; E.S.P.\nAtentamente, otro")))
        .when(k == 1, F.concat(F.lit("hola\nDestinatario: x\n"), F.concat(F.lit("Gerencia "), n), F.lit(", Cartagena")))
        .when(k == 2, F.concat(F.lit("texto\ncordialmente,\nAna Pérez "), F.col("c_custkey").cast("string"), F.lit("\nCordialmente suyo\nFirma del funcionario")))
        .otherwise(F.lit("Señores:\nbreve\ntodo en minúsculas"))
    )
    x = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), lt.sender(text).alias("sender"))
    return x.select("id", "sender", lt.sender_key("sender").alias("key"))


@query("""WITH x AS (SELECT p_partkey AS id, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')) AS t, upper(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')) AS k, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) AS n, p_name FROM part)
SELECT id, 'RESOLUCION_' || id || '.pdf' AS resolution, id || '_' || n || '_' || k || '.pdf' AS with_kind, CASE WHEN 30 - len(CAST(id AS VARCHAR)) - 5 >= len(k) THEN id || '_' || k ELSE id || '_' || rtrim(k[1:25 - len(CAST(id AS VARCHAR))], '-') END || '.pdf' AS tight,
  id || '__' || t || '.pdf' AS with_title, p_name || ' 8.2' AS folder, 'Caja ' || id || '__inventario.xlsx' AS sheet FROM x""")
def file_names(spark, sf):
    k = F.col("p_partkey").cast("string")
    kind = F.initcap("p_type")
    folder = fn.folder_name(F.concat(F.lit(" "), F.col("p_name"), F.lit(" : 8.2.pdf")))
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), fn.resolution_name(k).alias("resolution"), fn.kind_name(k, kind, "p_name").alias("with_kind"), fn.kind_name(k, kind, budget=30).alias("tight"),
        fn.title_name(k, "p_type").alias("with_title"), folder.alias("folder"), fn.sheet_name(F.concat(F.lit("a\\b/Caja "), k, F.lit(".pdf")), "__inventario.xlsx").alias("sheet"),
    )


@query("SELECT c_custkey AS id, c_custkey % 5 IN (0, 2) AS written FROM customer")
def names_in_texts(spark, sf):
    k, n = F.col("c_custkey") % 5, F.col("c_name")
    text = (
        F.when(k == 0, F.concat(F.lit("El rector, luisa leonor (doctora) AREVALO TOVAR y "), n))
        .when(k == 1, F.concat(F.lit("LUISA firma el acta número tres con todos los demás miembros presentes; LEONOR Arévalo "), n))
        .when(k == 2, F.concat(n, F.lit(" Luisa Arebalo Tovar")))
        .when(k == 3, F.concat(n, F.lit(" Leonor Arévalo Tovar")))
    )
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), nm.name_in_text(F.lit("Luisa Leonor de Arévalo Tovar"), text).alias("written"))
