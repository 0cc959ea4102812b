"""Cases of names, codes and dates that texts give."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from folioflow.functions import dates as dt
from folioflow.functions import names as nm
from folioflow.operators import units as un

TODAY = date(2026, 1, 1)


def values(spark, kind, xs, f):
    rows = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(xs)], f"i int, {kind}")
    return [r.v for r in rows.select("i", f.alias("v")).orderBy("i").collect()]


def test_own_dates_look_around_from_where_a_date_starts(spark):
    got = values(
        spark,
        "t string",
        [
            "10/10/2015 11/11/2016 FECHA DE NACIMIENTO",
            "Bogotá, 3 de mayo de 2019 y 04-06-2020",
            "Ley 142 del 11 de julio de 1994. Dado el 12 de julio de 2001",
            "31/02/2001 01/01/1980 02/02/2150",
            None,
            "radicado 5. Firmado 01/02/2003" + " x" * 60 + " estatura 1.70 04/05/2006",
            "5 de  Setiembre del año 2011",
        ],
        dt.own_dates("t", TODAY),
    )
    d = date
    assert got == [[], [d(2019, 5, 3), d(2020, 6, 4)], [d(2001, 7, 12)], [], [], [d(2003, 2, 1)], [d(2011, 9, 5)]]


def test_page_dates(spark):
    got = values(
        spark,
        "t string",
        ["Cartagena, 21/12/2021 con plazo del 01/02/2022", "DIA MES AÑO | 9 16 09 08 2022 pago 01/12/2023", "DÍA | MES | ANIO 01 09 22", "nada", "01/02/2020 y 03/04/2019", "ID DE COBROS: 4 1 0 0 8 7 5 2 5 2 DIA MES ANO 17 | O7 | 2021"],
        dt.page_date("t", TODAY),
    )
    assert got == [date(2021, 12, 21), date(2022, 8, 9), date(2022, 9, 1), None, date(2020, 2, 1), date(2021, 7, 17)]


def test_issue_dates(spark):
    got = values(
        spark,
        "t string",
        [
            "Dada en Cartagena a los treinta y un (31) días del mes de diciembre de 2019",
            "RESOLUCIÓN No. 00390 DE 2018 ... Dado en Bogotá, a los veintidos días de Marzo",
            "Expedida en Cali a los 5 dias del mes de DICIEMTMP de 2.021",
            "Dada en Cali a los muchos días de enero de 2020",
            None,
        ],
        dt.issue_date("t", TODAY),
    )
    assert got == [date(2019, 12, 31), date(2018, 3, 22), date(2021, 12, 5), None, None]


def test_words_of_names(spark):
    words = ["MARIA", "RDSA", "EM", "DEL", "VIANJT", "BRAVO", "STELLA", "AAALBA", "MSCSDSS", "NAANNANCANAA", "Z", "JHON", "QX", "ESPRIELLA"]
    assert values(spark, "w string", words, nm.doubtful_name_word("w")) == [False, True, True, False, True, False, False, True, True, False, True, False, True, False]
    assert values(spark, "w string", words, nm.possible_name_word("w")) == [True, True, True, True, True, True, True, False, False, False, False, True, False, True]
    got = values(spark, "w array<string>", [["MARIA", "DEL", "RDSA", "MSCSDSS"], [], ["MARIA", "JOSE"]], nm.name_quality("w", F.array(F.lit("MARIA"), F.lit("JOSE"))))
    assert got == [0.5, 0.0, 4.0]


def test_years_of_codes_and_folios_of_corners(spark):
    assert values(spark, "c string", ["549310044", "5420020056", "840222", "12", "540110044", "5418020056"], nm.code_year("c")) == [1993, 2002, 1984, None, None, None]
    corners = [("135 70/1", 139), ("396 200/V", 397), ("2513/v", 25), ("N/A", 3), (None, 3), ("25 13", 25), ("0044", None), ("0", 2)]
    assert values(spark, "t string, p int", corners, nm.corner_folio("t", "p")) == ["70", "200", "13", None, None, "13", "44", "0"]


def hand(a, b):
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            c = 0 if x == y else 0.5 if not x.isdigit() and x in nm.HAND.get(y, "") else 1
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + c, d[i - 1][j - 2] + 0.5 if x == "D" and b[max(j - 2, 0) : j] == "10" else 9e9)
    return d[-1][-1]


def test_distance_of_a_hand(spark):
    pairs = [("23D20210565", "231020210565"), ("Z3I0", "2310"), ("", "12"), ("12", ""), ("ABC", "188"), ("2310", "2310"), ("D", "10")]
    assert values(spark, "a string, b string", pairs, nm.hand_distance("a", "b")) == [hand(a, b) for a, b in pairs]


@pytest.mark.parametrize(
    ("code", "day", "box", "sure", "want"),
    [
        ("RE2311202302499", date(2023, 8, 28), [], False, ("RE2311202302499", "")),
        ("re9233202203621", date(2023, 1, 25), [], False, ("RE9233202203621", "")),
        ("RE9233202003621", date(2023, 1, 25), [], False, (None, "another year")),
        ("RE2371202302499", None, [], False, ("RE2311202302499", "office corrected")),
        ("RE9238202203621", None, ["9233"], False, ("RE9233202203621", "office corrected")),
        ("RE9238202203621", None, [], False, (None, "no such office")),
        ("RE2810202402908", None, [], True, ("RE2810202402908", "unknown office, read alike")),
        ("RE28", None, [], False, (None, "not whole")),
        (None, None, [], False, (None, "not whole")),
    ],
)
def test_codes_of_a_hand(spark, code, day, box, sure, want):
    df = spark.createDataFrame([(code, day, box, sure)], "c string, d date, o array<string>, s boolean")
    got = df.select(nm.checked_hand_code("c", "d", F.col("o"), F.col("s")).alias("v")).first().v
    assert (got.value, got.reason) == want


# choosing codes, crossings and books


def pages_of(spark, rows, columns, first="page_number"):
    return spark.createDataFrame([("d", i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows, 1)], f"doc_id string, {first} int, {columns}")


def column_of(df, name, order="page_number"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_resolved_codes_follow_the_open_unit(spark):
    c = lambda code, score, opens=True, arguable=False: (code, score, opens, arguable)
    rows = [
        ([c("00100", 0.9), c("002-2023", 0.2, False)], False),  # opens and names an annex
        ([c("002-2023", 0.8)], False),  # the annex it announced
        ([c("00101", 0.7, False, True)], False),  # a header that lost its mark: goes on, arguable
        (None, True),  # not read
        ([c("00100", 0.4)], False),  # the open code, boosted
        ([c("00200", 0.65), c("00300", 0.6)], False),  # a tie
        ([], False),
    ]
    df = pages_of(spark, rows, "candidates array<struct<code:string,score:double,opens:boolean,arguable:boolean>>, degraded boolean")
    got = un.resolved_codes(df).orderBy("page_number").collect()
    assert [(r.code, r.confidence, r.ambiguous) for r in got] == [("00100", 0.9, False), ("00100", 1.0, False), ("00100", 0.3, True), (None, None, True), ("00100", 0.7, False), ("00200", 0.65, True), (None, None, False)]


def test_crossed_codes(spark):
    day = date(2021, 6, 18)
    printed = spark.createDataFrame([(1, "RE2310202105657", day), (1, "RE2310202199999", day), (2, "RE3110202100001", day)], "box int, code string, printed_on date")
    readings = spark.createDataFrame([(1, 7, "23D20210565", day), (1, 7, "23D20210565P", day), (1, 8, "23D20210565", day), (1, 9, "9999999999999", day), (2, 3, "3110202100001", date(2022, 1, 1)), (2, 3, "3110202100001", date(2022, 1, 1))], "box int, stamp int, read string, stamped date")
    got = sorted((r.box, r.stamp, r.code, r.n_readings, r.believed) for r in un.crossed_codes(readings, printed).collect())
    assert got == [(1, 7, "RE2310202105657", 2, True), (1, 8, "RE2310202105657", 1, False), (2, 3, "RE3110202100001", 2, False)]


@pytest.mark.parametrize(
    ("folios", "alone", "goes_on", "opens"),
    [
        ([5, 6, None, 8, 1, 2, None], [7], {2, 3, 4, 6}, {5, 7}),
        ([11, 12, 47, 14], [], {2, 3, 4}, set()),
        ([12, None, 1, 2, 3, 18], [], {2, 3, 4, 5, 6}, set()),
        ([16, 77, 18], [], {2, 3}, set()),
        ([11, 11, 11, 12], [], set(), set()),
        ([3, 1, 13], [], set(), set()),
    ],
)
def test_foliation(spark, folios, alone, goes_on, opens):
    df = pages_of(spark, [(f, i in alone) for i, f in enumerate(folios, 1)], "folio int, opens_alone boolean")
    got = un.foliation(df).collect()
    assert {r.page_number for r in got if r.continues} == goes_on
    assert {r.page_number for r in got if r.opens} == opens


def test_academic_records(spark):
    rows = [(None, None, None), ("old", "1", None), ("new", "1", None), (None, None, None), ("certificate", "1", None), ("certificate", "2", None), ("old", "3", None), ("old", "4", None), (None, None, None)]
    assert column_of(un.academic_records(pages_of(spark, rows, "kind string, code string, person string")), "record") == [1, 2, 2, 2, 2, 3, 4, 4, 4]


def test_payroll_documents(spark):
    none = dict.fromkeys(("key", "number", "goes_on", "person", "blank", "told_page"))
    sheets = [
        {"sheet": None},
        {"sheet": "divider"},
        {"sheet": "list", "key": "a"},
        {"sheet": "list"},
        {"sheet": "voucher"},
        {"sheet": "list", "key": "b", "told_page": 2},  # takes back one unread sheet
        {"sheet": "certificate", "number": 5, "person": "p"},
        {"sheet": "certificate", "number": 5},
        {"sheet": "certificate", "number": 6},
        {"sheet": "card", "person": "q"},
        {"sheet": "card", "blank": True},
        {"sheet": "index"},
        {"sheet": "list", "key": "a"},
    ]
    rows = [tuple({**none, "goes_on": False, "blank": False, **s}[c] for c in ("sheet", "key", "number", "goes_on", "person", "blank", "told_page")) for s in sheets]
    df = pages_of(spark, rows, "sheet string, key string, number int, goes_on boolean, person string, blank boolean, told_page int")
    assert column_of(un.payroll_documents(df), "document") == [1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5, 6]


def test_acts_in_series(spark):
    rows = [(17, 2016), (1, 2016), (2, 2016), (18, 2016), (1, 2017), (None, None), (2, 2017)]
    assert column_of(un.acts_in_series(pages_of(spark, rows, "number int, year int", "position")), "session", "position") == [1, 1, 1, 2, 3, 4, 5]


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "VISTO EL RECURSO DE REPOSICION Y SUBSIDIARIAMENTE EL DE APELACION"), (2, "RECUROS DE REPOSICION"), (3, "ACTA DE VISITA RECURSO DE REPOSICOIN"), (4, "nada"), (5, "")], "id int, text string")
    phrases = spark.createDataFrame([("RECURSO DE REPOSICION",), ("RECURSO DE REPOSICION Y SUBSIDIARIAMENTE EL DE APELACION",), ("ACTA DE VISITA",)], "phrase string")
    got = {r.id: (r.phrase, r.distance) for r in un.best_phrase(un.phrase_hits(texts, phrases)).collect()}
    assert got == {1: ("RECURSO DE REPOSICION Y SUBSIDIARIAMENTE EL DE APELACION", 0), 2: ("RECURSO DE REPOSICION", 1), 3: ("ACTA DE VISITA", 0)}
