"""Seams between neighbouring pages, decided by a cascade, and segments assembled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import DOC, PAGE, pages_order

FIELDS = (
    "folio_mark BOOLEAN, page_index INT, page_total INT, serial STRING, ordinals ARRAY<INT>, identifiers ARRAY<STRUCT<kind: STRING, value: STRING>>, is_annex BOOLEAN, announces_annexes BOOLEAN, "
    "is_support BOOLEAN, person_id STRING, names ARRAY<STRING>, label STRING, opens BOOLEAN, open_section BOOLEAN, account STRING, sender STRING, sheet_w DOUBLE, sheet_h DOUBLE, is_invoice BOOLEAN, "
    "folio INT, runs_on_tail BOOLEAN, runs_on_head BOOLEAN, closes BOOLEAN, letterhead BOOLEAN, place_and_date BOOLEAN, dense BOOLEAN"
)
SHEET_TOLERANCE = 8.0


def fill(pages: DataFrame) -> DataFrame:
    """pages with all fields of a fingerprint; absent ones are null."""
    have = set(pages.columns)
    wanted = pages.sparkSession.createDataFrame([], FIELDS).schema
    return pages.select(DOC, PAGE, *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def ubiquitous(pages: DataFrame, share: float = 0.5, least: int = 4) -> DataFrame:
    """(doc_id, ids): identifiers on more than `share` of the pages that bear their kind, where `least` pages do."""
    x = pages.select(DOC, PAGE, F.explode("identifiers").alias("i")).select(DOC, PAGE, "i", F.col("i.kind").alias("kind")).distinct()
    kinds = x.select(DOC, PAGE, "kind").distinct().groupBy(DOC, "kind").agg(F.count("*").alias("bearing"))
    n = x.groupBy(DOC, "kind", "i").agg(F.count("*").alias("n"))
    hit = n.join(kinds, [DOC, "kind"]).filter((F.col("bearing") >= least) & (F.col("n") > share * F.col("bearing")))
    return hit.groupBy(DOC).agg(F.collect_set("i").alias("ids"))


def decide(pages: DataFrame, alternates: DataFrame | None = None) -> DataFrame:
    """(doc_id, left_page, right_page, verdict, rule) of each seam: the first rule that fires. verdict: STARTS, CONTINUES, ATTACHMENT or UNDECIDED."""
    x = fill(pages).join(ubiquitous(fill(pages)), DOC, "left")
    x = x.join(alternates, DOC, "left") if alternates is not None else x.withColumn("alternates", F.lit(False))
    names = [c for c in x.columns if c not in (DOC, "ids", "alternates")]
    x = x.withColumn("_r", F.lead(F.struct(*names)).over(pages_order())).filter("_r IS NOT NULL")
    l, r = (lambda c: F.col(c)), (lambda c: F.col(f"_r.{c}"))  # noqa: E731, E741
    yes = lambda c: F.coalesce(c, F.lit(False))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    li, ri = F.coalesce(l("identifiers"), none), F.coalesce(r("identifiers"), none)
    shared = F.array_intersect(li, ri)
    proper = F.array_except(shared, F.coalesce(F.col("ids"), none))
    kinds = lambda a: F.array_distinct(F.transform(a, lambda s: s["kind"]))
    opening = yes(r("opens"))
    paged, both_paged = r("page_total").isNotNull(), l("page_total").isNotNull() & r("page_total").isNotNull()
    same_total = yes(l("page_total") == r("page_total"))
    last_of = yes(l("page_index") == l("page_total"))
    serials = l("serial").isNotNull() & r("serial").isNotNull()
    support = yes(r("is_support")) & ~yes(l("is_support"))
    both_ids = l("person_id").isNotNull() & r("person_id").isNotNull()
    invoice = yes(r("is_invoice")) & ~yes(l("is_invoice"))
    rules: list[tuple[int, Column, object]] = [
        (1, yes(F.col("alternates")) & yes(r("folio_mark")), "STARTS"),
        (2, paged & yes(r("page_index") == 1), "STARTS"),
        (3, both_paged & same_total & yes(r("page_index") == l("page_index") + 1), "CONTINUES"),
        (4, both_paged & same_total & yes(r("page_index") > l("page_index")), "CONTINUES"),
        (5, paged, "CONTINUES"),
        (6, last_of & ~(yes(l("announces_annexes")) & ~opening & r("label").isNull()), "STARTS"),
        (7, serials, F.when(l("serial") == r("serial"), "CONTINUES").otherwise("STARTS")),
        (8, yes(F.element_at(r("ordinals"), 1) > F.element_at(l("ordinals"), -1)), "CONTINUES"),
        (9, F.size(proper) > 0, "CONTINUES"),
        (10, (F.size(F.array_intersect(kinds(li), kinds(ri))) > 0) & (F.size(shared) == 0), "STARTS"),
        (11, yes(r("is_annex")) | (yes(l("announces_annexes")) & ~opening), "ATTACHMENT"),
        (12, support, F.when(both_ids & (l("person_id") != r("person_id")), "STARTS").otherwise("ATTACHMENT")),
        (13, r("label").isNotNull() & ~yes(l("label") == r("label")), "STARTS"),
        (14, opening, "STARTS"),
        (15, yes(l("open_section")), "CONTINUES"),
        (16, yes(l("account") == r("account")) & yes(l("sender") == r("sender")), "CONTINUES"),
        (17, yes((F.abs(l("sheet_w") - r("sheet_w")) > SHEET_TOLERANCE) | (F.abs(l("sheet_h") - r("sheet_h")) > SHEET_TOLERANCE)), "STARTS"),
        (18, invoice, F.when(F.size(shared) > 0, "CONTINUES").otherwise("STARTS")),
        (19, yes(r("folio") == l("folio") + 1), "CONTINUES"),
        (20, yes(l("runs_on_tail")) & yes(r("runs_on_head")) & ~opening, "CONTINUES"),
        (21, yes(l("closes")) & (yes(r("letterhead")) | yes(r("place_and_date"))), "STARTS"),
        (22, (yes(l("opens")) | l("label").isNotNull()) & ~opening & r("label").isNull(), "CONTINUES"),
        (23, yes(l("dense")) & yes(r("dense")) & ~yes(l("closes")), "CONTINUES"),
    ]
    verdict = rule = None
    for n, when, what in rules:
        v = F.lit(what) if isinstance(what, str) else what
        verdict = F.when(when, v) if verdict is None else verdict.when(when, v)
        rule = F.when(when, F.lit(n)) if rule is None else rule.when(when, F.lit(n))
    return x.select(DOC, F.col(PAGE).alias("left_page"), r(PAGE).alias("right_page"), verdict.otherwise("UNDECIDED").alias("verdict"), rule.otherwise(F.lit(0)).alias("rule"))


def assemble(pages: DataFrame, seams: DataFrame) -> DataFrame:
    """(doc_id, segment, first_page, last_page, n_pages, n_attachments, n_undecided): a missing seam cuts, an undecided one joins and is counted."""
    x = pages.select(DOC, PAGE).join(seams.select(DOC, F.col("right_page").alias(PAGE), "verdict"), [DOC, PAGE], "left")
    starts = F.when(F.col("verdict").isNull() | (F.col("verdict") == "STARTS"), 1).otherwise(0)
    x = x.withColumn("segment", F.sum(starts).over(Window.partitionBy(DOC).orderBy(PAGE).rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(DOC, "segment").agg(F.min(PAGE).alias("first_page"), F.max(PAGE).alias("last_page"), F.count("*").alias("n_pages"), F.count_if(F.col("verdict") == "ATTACHMENT").alias("n_attachments"), F.count_if(F.col("verdict") == "UNDECIDED").alias("n_undecided"))
