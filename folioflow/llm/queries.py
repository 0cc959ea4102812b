"""Thin queries over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, minhash, neighbours, packing, repeats, rules, sharding, siteview, tokens
from ._tables import documents


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siteview.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return tokens.suffix_sums(tokens.length_histogram(tokens.encoded_lengths(docs)))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_to_shards(sharding.light_rows(documents(spark, sf_dir)), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (_remainder(5) == 0).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.with_keys(documents(spark, sf_dir)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_policy(rules.ledger(documents(spark, sf_dir)), "v1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (_remainder(4) == 2).alias("held_out"))
    model = neighbours.fit(docs.filter(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return neighbours.classify(docs, model, keep=("doc_id", "held_out"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_token_counts, op3_suffix_array, op4_sharding, op5_language_id, op6_minhash, op7_packing, op8_quality_rules, op9_decontamination, op10_quality_classifier)}

_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS at FROM r, (VALUES (0), (1), (2)) o(k)) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, CAST(0 AS BIGINT){bits} AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {base}) <> 0 AS base_failed, (fail_bits & {v1}) = 0 AS kept, fail_bits FROM b
"""

_MINHASH_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, strlen(h) // 2 AS n FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM b WHERE n >= 50)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM s) WHERE first < doc_id),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM m),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
c AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM k GROUP BY doc_id, run),
a AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM c),
j AS (SELECT a.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS head, max(e) AS e, sum(e - s) AS gone, count(*) AS spans FROM a JOIN b ON a.doc_id = b.doc_id GROUP BY a.doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN j ON j.doc_id = b.doc_id
"""

_LEAKS_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
ix AS (SELECT item_id, len(w) AS n, w, unnest(range(1, len(w) - 3)) AS j FROM i),
ig AS (SELECT item_id, n, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] || ' ' || w[j + 4] AS g FROM ix),
ic AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
dw AS (SELECT doc_id, n, p, g, lead(g, 1) OVER o AS g1, lead(g, 2) OVER o AS g2, lead(g, 3) OVER o AS g3, lead(g, 4) OVER o AS g4 FROM (SELECT doc_id, len(w) AS n, unnest(range(0, len(w))) AS p, unnest(w) AS g FROM d) WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
dg AS MATERIALIZED (SELECT doc_id, n, p, g || ' ' || g1 || ' ' || g2 || ' ' || g3 || ' ' || g4 AS g FROM dw WHERE g4 IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, dg.n AS dn, item_id, ic.n AS inn, p FROM dg JOIN ic USING (g)),
win AS (SELECT DISTINCT doc_id, item_id, inn, s FROM (SELECT doc_id, item_id, inn, dn, unnest(range(greatest(0, p - greatest(inn - 5, 0)), least(p, greatest(dn - inn, 0)) + 1)) AS s FROM hit)),
wc AS (SELECT win.doc_id, item_id, inn, s, g, count(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND p BETWEEN s AND s + inn - 5 GROUP BY ALL),
both_ AS (SELECT wc.doc_id, wc.item_id, wc.inn, wc.s, sum(least(wc.c, coalesce(ic.c, 0))) AS k, sum(wc.c) AS nw FROM wc LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.g = wc.g GROUP BY ALL),
sim AS (SELECT doc_id, item_id, inn, s, k, nw + (inn - 4) - k AS u FROM both_),
ok AS (SELECT *, k / u AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k / u DESC, s) AS r FROM sim WHERE 100 * k >= 80 * u)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start, CAST(inn AS BIGINT) AS n_words, CAST(similarity AS DOUBLE) AS similarity FROM ok WHERE r = 1
"""

ORACLE_SQL = {
    "op9_decontamination": _LEAKS_SQL,
    "op3_suffix_array": _REPEATS_SQL,
    "op6_minhash": _MINHASH_SQL,
    "op8_quality_rules": _RULES_SQL.replace("{bits}", "".join(f" + CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in rules.RULES))
    .replace("{base}", str(rules.mask("base")))
    .replace("{v1}", str(rules.mask("base") | rules.mask("v1"))),
}
