import random

from folioflow.functions.text import osa
from folioflow.operators import matching as mt
from folioflow.operators import seams as sm
from folioflow.operators import sequence as sq


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name):
    return [r[name] for r in df.orderBy("page_number").collect()]


def test_repair_is_sequential(spark):
    pages = frame(spark, [(1, i + 1, c) for i, c in enumerate("ABABA")], "doc_id long, page_number long, code string")
    assert column(sq.repair_phantoms(pages, lambda a, b: osa(a, b, 2) <= 2), "code") == list("AAAAA")


def test_repair_skips_pages_without_code(spark):
    pages = frame(spark, [(1, 1, "0100"), (1, 2, None), (1, 3, "0101"), (1, 4, None), (1, 5, "0100")], "doc_id long, page_number long, code string")
    assert column(sq.repair_phantoms(pages, lambda a, b: osa(a, b, 2) <= 2), "code") == ["0100", None, "0100", None, "0100"]


def test_groups_and_ranges(spark):
    pages = frame(spark, [(1, i + 1, c) for i, c in enumerate([None, "A", None, "B", "A", None])], "doc_id long, page_number long, code string")
    got = {r.code: r.page_ranges for r in sq.groups_by_code(pages).collect()}
    assert got == {"A": "2-3,5-6", "B": "4"}
    assert [r.page_number for r in sq.quarantine(pages).collect()] == [1]


def test_longest_series(spark):
    pages = frame(spark, [(1, i + 1, c) for i, c in enumerate([100, 500, 120, 130, 90, 140])], "doc_id long, page_number long, code long")
    assert sorted(r.code for r in sq.longest_series(pages).collect()) == [100, 120, 130, 140]


def test_records_compare_with_first_identity(spark):
    pages = frame(spark, [(1, i + 1, c) for i, c in enumerate([None, "x", None, "x", "y", None, "x"])], "doc_id long, page_number long, identity string")
    assert column(sq.records_by_identity(pages), "record") == [1, 1, 1, 1, 2, 2, 3]


def test_folio_order_follows_jumps(spark):
    pages = frame(spark, [(1, i + 1, f) for i, f in enumerate([1, 2, 5, 6, 3, 4])], "doc_id long, page_number long, folio long")
    assert column(sq.folio_order(pages), "place") == [1, 2, 5, 6, 3, 4]


def test_missing_seam_cuts_and_undecided_joins(spark):
    pages = frame(spark, [(1, i) for i in range(1, 5)], "doc_id long, page_number long")
    seams = frame(spark, [(1, 2, "UNDECIDED"), (1, 4, "ATTACHMENT")], "doc_id long, right_page long, verdict string")
    got = [(r.first_page, r.last_page, r.n_attachments, r.n_undecided) for r in sm.assemble(pages, seams).orderBy("segment").collect()]
    assert got == [(1, 2, 0, 1), (3, 4, 1, 0)]


def test_empty_pages(spark):
    empty = frame(spark, [], "doc_id long, page_number long, code string")
    assert sq.groups_by_code(empty).count() == 0
    assert sm.decide(empty.drop("code")).count() == 0


def test_reconcile_reuses_first_copy(spark):
    source = frame(spark, [(1, "h"), (2, "h"), (3, "g")], "page long, hash string")
    got = mt.reconcile(source, frame(spark, [("a", 1, "h"), ("a", 2, "h"), ("b", 1, "h"), ("b", 2, None)], "file string, position long, hash string"))
    assert [(r.page, r.reused) for r in got.orderBy("file", "position").collect()] == [(1, False), (2, False), (1, True), (None, False)]


def test_known_code_must_be_alone(spark):
    codes = frame(spark, [("A1203",), ("B9934",)], "code string")
    known = frame(spark, [("A1204",), ("A1205",), ("B9935",)], "code string")
    assert {r.code: r.corrected for r in mt.closest_known(codes, known, 1).collect()} == {"A1203": None, "B9934": "B9935"}


def test_closest_known_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(0, 7)))
    known = sorted({word() for _ in range(40)})
    codes = [*{word() for _ in range(150)}, "acbdef", "áb€x", None]
    known += ["abcdef", "ábx€", "abcd2345"]
    read = frame(spark, [(c,) for c in codes], "code string")
    for k in (0, 1, 2):
        want = {None: None}
        for c in filter(lambda c: c is not None, codes):
            best = min(osa(c, x) for x in known)
            near = [x for x in known if osa(c, x) == best]
            want[c] = near[0] if best <= k and len(near) == 1 else None
        assert {r.code: r.corrected for r in mt.closest_known(read, frame(spark, [(x,) for x in [*known, None]], "code string"), k).collect()} == want


def test_one_edit_makes_no_pairs(spark):
    codes = frame(spark, [(c,) for c in ("a1", "a2")], "code string")
    plan = mt.closest_known(codes, codes, 1)._jdf.queryExecution().toString()
    assert "levenshtein" not in plan and "ArrowEvalPython" not in plan
