"""Codes behind headings, and letters, on forms that occur on paper."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from folioflow.functions import filenames as fn
from folioflow.functions import letters as lt
from folioflow.functions import names as nm
from folioflow.functions.text import number_in_text, slug
from folioflow.operators.candidates import code_candidates, of_pages, scored
from folioflow.operators.units import resolved_codes

CODES = [
    ("RESOLUCIÓN No. 00966_____________________________", [("00966", True)]),
    ("RESOLUCIÓN N* 00973", [("00973", True)]),
    ("RESOLUCIÓN N? 00974", [("00974", True)]),
    ("RESOLUCIÓN N°. 00191", [("00191", True)]),
    ("Resolución Interna N°020 de 2011", [("020-2011", True)]),
    ("RESOLUCION No. 011-14", [("011-2014", True)]),
    ("RESOLUCION No. 002--2023", [("002-2023", True)]),
    ("RESOLUCIÓN No. 001 85 del", [("00185", True)]),
    ("RESOLUCIÓN No. 006 2025", [("006", True)]),
    ("RESOLUCION 4321", [("4321", False)]),
    ("Resolución Interna N — 2012", []),
    ("RESOLUCION DE DIRECTORIO 2024", []),
    ("LA SOLUCION No. 00123", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("place", ["alone", "wrapped"])
def test_code_candidates(spark, place):
    rows = [(i, t if place == "alone" or not t else t.replace(" ", "\n", 1), "x") for i, (t, _) in enumerate(CODES)]
    got = {}
    for r in code_candidates(spark.createDataFrame(rows, "id long, text string, line_text string")).collect():
        got.setdefault(r["id"], []).append((r["code"], r["official"]))
    for i, (text, want) in enumerate(CODES):
        if place == "alone" or text is None or " de " not in text:
            assert got.get(i, []) == ([] if place == "wrapped" and text and text.startswith(("LA ", "Resolución Interna N —")) else want), text


def test_no_pages(spark):
    assert code_candidates(spark.createDataFrame([], "id long, text string")).count() == 0


LETTERS = [
    ("Cartagena, 3/4/2020\nAsunto: Reclamo por alto consumo\nde marzo", "Reclamo por alto consumo de marzo", date(2020, 4, 3)),
    ("Señores\nAFINIA\nASUNTO\nSOLICITUD SE REALICE CORRECCION\nde nombre", "SOLICITUD SE REALICE CORRECCION de nombre", None),
    ("Asunto: Reclamo por alto consumo", None, None),
    ("Señores\nAsunto: 03 RECLAMO\ncon letras de sobra", None, None),
    ("Señor\nAsunto: corto", None, None),
    ("", None, None),
    (None, None, None),
]


def test_letters(spark):
    x = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LETTERS)], "id int, text string")
    for r in lt.with_letter(x, "text", date(2026, 1, 1)).collect():
        _, subject, day = LETTERS[r["id"]]
        assert (r["letter"] and r["letter"]["subject"]) == subject, LETTERS[r["id"]]
        assert (r["letter"] and r["letter"]["day"]) == day, LETTERS[r["id"]]


@pytest.mark.parametrize(
    "text, goes_on",
    [
        ("PETICIONES\nprimera", True),
        ("«*\nABOGADO T.P. 10\n2) porque la empresa", True),
        ("la empresa nunca dio respuesta al reclamo", True),
        ("afmia\nRespuesta", False),
        ("Ahora bien, para hacer efectivo el derecho de petición que tengo", True),
        ("Operador de Red: Caribemar de la Costa Atlántica Sucursal Mayor Uno Dos", False),
        ("UNOX\nDOSX\nTRES\nCUATRO\nla empresa nunca dio respuesta", False),
        ("", False),
        (None, False),
    ],
)
def test_continues(spark, text, goes_on):
    x = spark.createDataFrame([(text,)], "text string").select(lt.continues_letter("text", F.lit(False)).alias("g"))
    assert x.first()["g"] is goes_on


def test_same_letter(spark):
    a, b, d, e = "RECLAMOPORALTOCONSUMODEMARZO", "RECLAMOPORALTOCONSUMODEMARZ0", date(2020, 1, 1), date(2020, 1, 2)
    cases = [((a, d), (b, d), True), ((a, d), (b, e), False), ((a, d), (a, e), False), ((a, None), (a, d), True), ((a, None), (b, d), False), (("", d), ("", d), False), ((None, d), (a, d), False)]
    s = "struct<key:string,day:date>"
    x = spark.createDataFrame([(i, p, q) for i, (p, q, _) in enumerate(cases)], f"i int, a {s}, b {s}").select("i", lt.same_letter(F.col("a"), F.col("b")).alias("same"))
    assert [r["same"] for r in x.orderBy("i").collect()] == [c[2] for c in cases]


@pytest.mark.parametrize("number, text, want", [("45466499", "C.C. 45.466.499 de", True), ("45466499", "145.466.499", False), ("12", "1 2", True), ("", "x", False), (None, "1", False), ("1", None, False)])
def test_number_in_text(spark, number, text, want):
    x = spark.createDataFrame([(number, text)], "n string, t string").select(number_in_text("n", "t").alias("w"))
    assert x.first()["w"] is want


def test_codes_from_texts(spark):
    texts = ["RESOLUCIÓN No. 00086\nPor la cual", "sin nada", "VISTO lo dicho, mediante Resolución No. 00072 de 2023 se dijo", "RESOLUCION NO.02809 DE NOVIEMBRE 23 DE 2022, SE EXCLUYE AL SENOR", "____ RESOLUCION NO. 00964 ______"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, page_number int, text string")
    found = of_pages(scored(code_candidates(pages)), ["doc_id", "page_number"])
    got = resolved_codes(pages.join(found, ["doc_id", "page_number"], "left").withColumn("degraded", F.lit(False)))
    assert [r["code"] for r in got.orderBy("page_number").collect()] == ["00086", None, "00086", "00086", "00964"]


def test_geometry(spark):
    pages = spark.createDataFrame([(i, "RESOLUCION NO. 00086", top, centre) for i, (top, centre) in enumerate([(0.1, 0.5), (0.5, 0.5), (0.1, 0.1), (None, None)])], "id int, text string, top double, centre double")
    got = scored(code_candidates(pages), "top", "centre").orderBy("id").collect()
    assert [r["opens"] for r in got] == [True, False, False, True]
    assert all(r["score"] == 1.0 for r in got)


def test_file_names(spark):
    c = F.lit
    cases = [
        (slug(c("Por la cual se autoriza"), 12), "por-la-cual"),
        (slug(c("¡Única!"), 60), "unica"),
        (fn.resolution_name(c("00086")), "RESOLUCION_00086.pdf"),
        (fn.kind_name(c("01"), c("Derecho de petición")), "01_DERECHO-DE-PETICION.pdf"),
        (fn.kind_name(c("1128047041"), c("DOCUMENTO DE IDENTIDAD"), c("Juan Pérez Gómez")), "1128047041_juan-perez-gomez_DOCUMENTO-DE-IDENTIDAD.pdf"),
        (fn.kind_name(c("juan-perez"), c("diploma"), c("Juan Pérez")), "juan-perez_DIPLOMA.pdf"),
        (fn.kind_name(c("01"), c("CAMBIO Y/O ACTUALIZACION"), budget=20), "01_CAMBIO-Y-O-AC.pdf"),
        (fn.kind_name(c("0123456789"), c("QUEJA"), budget=20), "0123456789.pdf"),
        (fn.kind_name(c("01"), c("QUEJA"), c("María del Socorro Pérez"), budget=32), "01_maria-del-socorro_QUEJA.pdf"),
        (fn.title_name(c("00086"), c("por la cual"), budget=20), "00086.pdf"),
        (fn.title_name(c(""), c(None).cast("string")), "sin-codigo.pdf"),
        (fn.folder_name(c('6.3858: "REGISTRO" N°08 . .pdf')), "6.3858 REGISTRO N°08"),
        (fn.folder_name(c("???.pdf")), "documento"),
        (fn.sheet_name(c("00C003269\\1. 3858079.pdf"), "__f.xlsx"), "1. 3858079__f.xlsx"),
        (fn.sheet_name(c("caja de nombre largo.pdf"), "__f.xlsx", 236), "caja de no__f.xlsx"),
    ]
    got = spark.range(1).select(*[x.alias(str(i)) for i, (x, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]


def test_name_in_text(spark):
    cases = [
        ("Raúl Muskus López", "el señor RAUL MUSKUS LOPEZ", True),
        ("Raúl Muskus López", "Helena Muskus López", False),
        ("Raúl Muskus López", "Raul Muscus Perez", True),
        ("Ana Pérez", "Ana", False),
        ("Ana Pérez", "Ana " + "y otros " * 4 + "Pérez", False),
        ("de la", "nada", True),
        (None, "x", True),
        ("Ana Pérez", "", False),
        ("Ana Pérez", None, False),
    ]
    x = spark.createDataFrame([(i, n, t) for i, (n, t, _) in enumerate(cases)], "i int, n string, t string").select("i", nm.name_in_text("n", "t").alias("w"))
    assert [r["w"] for r in x.orderBy("i").collect()] == [w for _, _, w in cases]
