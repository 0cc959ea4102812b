"""Votes, verdicts and counts over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import digits, margin


def type_verdict(hits: DataFrame, sampled: DataFrame, least: float = 0.35, lead: float = 1.6) -> DataFrame:
    """(doc_id, type, score, confidence) from hits (doc_id, page_number, marker, type, weight, type_order) and sampled (doc_id, n_pages).

    Marker weights count once per page and are averaged over all sampled pages; the best must reach `least` and lead the second by `lead`, unless the second is 0.
    """
    once = hits.select("doc_id", "page_number", "marker", "type", "weight", "type_order").distinct()
    s = once.groupBy("doc_id", "type", "type_order").agg(F.sum("weight").alias("w")).join(sampled, "doc_id").withColumn("score", F.col("w") / F.col("n_pages"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "type_order")
    x = s.withColumns({"r": F.row_number().over(w), "second": F.coalesce(F.lead("score").over(w), F.lit(0.0)), "total": F.sum("score").over(Window.partitionBy("doc_id"))}).filter("r = 1")
    sure = (F.col("score") >= least) & ((F.col("second") == 0) | (F.col("score") >= lead * F.col("second")))
    out = sampled.select("doc_id").join(x, "doc_id", "left")
    sure = F.coalesce(sure, F.lit(False))
    return out.select("doc_id", F.when(sure, F.col("type")).otherwise("unknown").alias("type"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(sure, F.col("score") / F.col("total")).otherwise(F.lit(0.0)).alias("confidence"))


def winner_by_share(shares: DataFrame, by: str, least: float = 0.15, lead: float = 1.6) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("share"), "skill")
    x = shares.withColumns({"r": F.row_number().over(w), "second": F.coalesce(F.lead("share").over(w), F.lit(0.0))}).filter("r = 1")
    return x.filter((F.col("share") >= least) & (F.col("share") >= lead * F.col("second"))).select(by, "skill", "share")


def id_consensus(readings: DataFrame, by: str) -> DataFrame:
    """(by, value, confirmed): weighted vote among ids of 6 to 10 digits; nine digits with a leading 1 count as their tail where that was read; ties give null."""
    v = readings.select(by, digits("reading").alias("d"), "weight").filter(F.length("d").between(6, 10)).groupBy(by, "d").agg(F.sum("weight").alias("w"))
    tails = v.select(by, F.col("d").alias("_tail"))
    x = v.withColumn("_tail", F.when(F.col("d").startswith("1") & (F.length("d") == 9), F.substring("d", 2, 20)))
    x = x.join(tails.withColumn("_has", F.lit(True)), [by, "_tail"], "left").withColumn("d", F.when(F.col("_has"), F.col("_tail")).otherwise(F.col("d")))
    s = x.groupBy(by, "d").agg(F.sum("w").alias("w"))
    w = Window.partitionBy(by).orderBy(F.desc("w"), "d")
    top = s.withColumns({"r": F.row_number().over(w), "second": F.lead("w").over(w)}).filter("r = 1")
    tie = F.coalesce(F.col("second") == F.col("w"), F.lit(False))
    return top.select(by, F.when(~tie, F.col("d")).alias("value"), ((F.col("w") >= 2) & ~tie).alias("confirmed"))


def majority_words(readings: DataFrame, by: str) -> DataFrame:
    """(by, name): at each place of a name the word with most weight; ties go to the word read first."""
    words = readings.select(by, "reader", "weight", F.posexplode(F.split(F.trim("name"), "\\s+")).alias("place", "word"))
    v = words.groupBy(by, "place", "word").agg(F.sum("weight").alias("w"), F.min("reader").alias("first"))
    best = v.groupBy(by, "place").agg(F.min(F.struct((-F.col("w")).alias("w"), "first", "word")).alias("b"))
    return best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "b.word"))), lambda s: s["word"]), " ").alias("name"))


def commonest(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value; ties go to the one that came first."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(value).alias("v"))).alias("m")).select(*by, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


def account_of_box(pages: DataFrame, by: str, least: int = 2) -> DataFrame:
    """The account on most sheets, ties to the greater; `least` sheets at least."""
    n = pages.filter("account IS NOT NULL").groupBy(by, "account").agg(F.countDistinct("page_number").alias("n"))
    return n.groupBy(by).agg(F.max(F.struct("n", "account")).alias("m")).filter(F.col("m.n") >= least).select(by, "m.account", "m.n")


def code_pattern(codes: DataFrame, by: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """The two-digit prefix of a box's codes of 9 digits or more, if enough have it."""
    c = codes.select(by, digits("code").alias("d")).filter(F.length("d") >= 9).groupBy(by, F.substring("d", 1, 2).alias("prefix")).agg(F.count("*").alias("n"))
    g = c.groupBy(by).agg(F.max_by("prefix", F.struct("n", F.lit(0) - F.col("prefix").cast("int"))).alias("prefix"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return g.filter((F.col("total") >= least) & (F.col("n") / F.col("total") >= share)).select(by, "prefix", "n", "total")


def years_of_box(rows: DataFrame, by: str, least: int = 8) -> DataFrame:
    """low: the initial year a tenth of the way up; high: the final year nine tenths up; of rows with both, `least` at least."""
    g = rows.filter("first_year IS NOT NULL AND last_year IS NOT NULL").groupBy(by).agg(F.array_sort(F.collect_list("first_year")).alias("a"), F.array_sort(F.collect_list("last_year")).alias("b"))
    at = lambda c, q: F.get(c, F.floor(q * (F.size(c) - 1)).cast("int"))
    return g.filter(F.size("a") >= least).select(by, at("a", 0.1).alias("low"), at("b", 0.9).alias("high"))


def outside_years(rows: DataFrame, years: DataFrame, by: str, slack: int = 3) -> DataFrame:
    return rows.join(years, by).filter((F.col("first_year") < F.col("low") - slack) | (F.col("last_year") > F.col("high") + slack)).drop("low", "high")


def faculty_file(codes: DataFrame, by: str) -> DataFrame:
    g = codes.groupBy(by).agg(F.countDistinct(F.when(F.col("kind") == "faculty", F.col("code"))).alias("faculty"), F.countDistinct(F.when(F.col("kind") == "house", F.col("code"))).alias("house"))
    return g.select(by, ((F.col("faculty") >= 3) & (F.col("faculty") > 2 * F.col("house"))).alias("is_faculty"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts by (parameter, state) and by (parameter, method, state) in one pass; method without its page."""
    x = findings.withColumn("method", F.trim(F.regexp_replace("method", "\\s*\\(?p(?:ag|ágina)?\\.?\\s*\\d+\\)?$", "")))
    return x.groupingSets([["parameter", "state"], ["parameter", "method", "state"]], "parameter", "method", "state").agg(F.count("*").alias("n"), F.grouping("method").alias("over_methods")).select("parameter", "method", "state", F.col("over_methods").cast("int").alias("over_methods"), "n")


def margins(sample: DataFrame, by: list[str], limit: float = 0.05) -> DataFrame:
    """Per group: errors, doubtful, n and the margin's figures."""
    g = sample.groupBy(*by).agg(F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "doubtful").alias("doubtful"), F.count("*").alias("n"))
    return g.withColumn("m", margin(F.col("errors"), F.col("doubtful"), F.col("n"), limit)).select(*by, "errors", "doubtful", "n", "m.low", "m.high", "m.worst", "m.verdict")


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("field").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page_number")).alias("pages"))


def shares(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 3))


def consumption(rows: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Pages, tokens, waits and estimated cost for each provider; rates are per 1000 pages."""
    rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in rates.items() for x in (k, float(v))]), F.col("provider")), F.lit(0.0))
    return rows.groupBy("provider").agg(F.sum("pages").alias("pages"), F.sum("tokens").alias("tokens"), F.sum("wait_s").alias("wait_s")).withColumn("cost", F.col("pages") * rate / 1000)


def consolidate(rows: DataFrame, by: list[str], order: str, fields: list[str]) -> DataFrame:
    """The first non-empty value of each field in order, in one pass."""
    first = lambda f: F.min(F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.struct(order, f)))[f].alias(f)
    return rows.groupBy(*by).agg(*[first(f) for f in fields])


def distinct_in_order(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, values): each once, by first appearance."""
    f = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(order).alias("at"))
    return f.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda s: s[value]).alias("values"))


def repeated_lines(pages: DataFrame, least: int = 3) -> DataFrame:
    """Lines on `least` pages or more of a document."""
    lines = pages.select("doc_id", "page_number", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).filter("line <> ''")
    return lines.groupBy("doc_id", "line").agg(F.countDistinct("page_number").alias("n_pages")).filter(F.col("n_pages") >= least)


def diagnostics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("message").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def duplicate_values(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Rows whose value is also another's, unless all of them have one same name."""
    w = Window.partitionBy(by, value)
    x = rows.filter(F.col(value).isNotNull()).withColumns({"_n": F.count("*").over(w), "_lo": F.min(F.coalesce(name, F.lit(""))).over(w), "_hi": F.max(F.coalesce(name, F.lit(""))).over(w)})
    return x.filter((F.col("_n") > 1) & ~((F.col("_lo") == F.col("_hi")) & (F.col("_lo") != ""))).drop("_n", "_lo", "_hi")


def out_of_alphabet(rows: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """Rows whose name breaks an alphabetical order that their neighbours keep."""
    w = Window.partitionBy(by).orderBy(order)
    x = rows.withColumns({"_a": F.lag(name).over(w), "_b": F.lead(name).over(w)})
    return x.filter((F.col("_a") <= F.col("_b")) & ((F.col(name) < F.col("_a")) | (F.col(name) > F.col("_b")))).drop("_a", "_b")


def gaps(groups: DataFrame, by: str, number: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(number)
    return groups.withColumn("previous", F.lag(number).over(w)).filter(F.col(number) - F.col("previous") != 1)


def flag(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """problems: the names of the rules that a row breaks, in order of name given."""
    return rows.withColumn("problems", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()))
