from datetime import date

import pytest
from pyspark.sql import functions as F

from folioflow.functions import dates as dt
from folioflow.functions import numbers as nm
from folioflow.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "ceiling", "want"), [("CA", "ABC", None, 3), ("RESOLUCOIN", "RESOLUCION", None, 1), ("abc", "abc", 2, 0), ("abcd", "wxyz", 2, 3), ("", "ab", None, 2), ("ab", "ba", 1, 1)])
def test_edit_distance(a, b, ceiling, want):
    assert tx.osa(a, b, ceiling) == want


def test_prefilter_loses_nothing(spark):
    words = ["casa", "csaa", "caza", "masa", "mesa", "asac", "cas", "casas"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = {(r.a, r.b) for r in pairs.filter(tx.maybe_within(F.col("a"), F.col("b"), 1)).collect()}
    assert {(a, b) for a in words for b in words if tx.osa(a, b) <= 1} <= got


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Bogotá, 08-02-2022", [date(2022, 2, 8)]),
        ("07 octubre del 2022", [date(2022, 10, 7)]),
        ("el 5 de mayo de 2021 y el 31/02/2022", [date(2021, 5, 5)]),
        ("Ley 142 del 11 de julio de 1994", []),
        ("12 meses 2021", []),
        ("19/02/2074", []),
        ("01/01/1985", []),
        ("09/09/1999 fecha de nacimiento", []),
        ("Ley 9. Firmado 03/04/2005", [date(2005, 4, 3)]),
        (None, []),
    ],
)
def test_own_dates(spark, text, want):
    assert one(spark, dt.own_dates(F.lit(text).cast("string"), date(2026, 1, 1))) == want


def test_row_dates(spark):
    read = lambda t: tuple(one(spark, dt.read_row_date(F.lit(t))))
    assert read("17/12/2012") == (date(2012, 12, 17), "day")
    assert read("1986") == (date(1986, 1, 1), "year")
    assert read("31/02/2012")[0] is None
    assert read("N/A")[0] is None


def test_codes(spark):
    assert one(spark, tx.parse_code(F.lit("No. 026-2022."))) == "026-2022"
    assert one(spark, tx.parse_code(F.lit("sin número"))) is None
    assert one(spark, nm.one_digit_apart(F.lit("RE4310202207352"), F.lit("RE4310202207362")))
    assert one(spark, nm.repair_code(F.lit("RE431O202207352"))) == "RE4310202207352"


def test_margin(spark):
    m = lambda e, d, n: one(spark, nm.margin(F.lit(e), F.lit(d), F.lit(n)))["verdict"]
    assert m(0, 0, 100) == "inside"
    assert m(20, 0, 100) == "outside"
    assert m(0, 5, 100) == "uncertain"
    assert m(0, 0, 0) == "uncertain"


def test_search_has_no_wildcards(spark):
    assert not one(spark, tx.search_terms(F.lit("Acta de Bogotá"), "a%ta"))
    assert one(spark, tx.search_terms(F.lit("Acta de Bogotá"), "BOGOTA acta"))
