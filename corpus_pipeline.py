"""From raw documents to packed training sequences: quality rules, near duplicates, repeated strings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; stages but the last return the columns of documents. Written as Parquet and
read again, each is the next one's docs.

Defined cases: a null text counts as an empty one and rules reject it; rows without a doc_id are compared with none and stay as they are
in near duplicates and repeated strings; nulls in other columns pass; extra columns are dropped, whatever their names; whole texts are
read, however long; an empty table gives no rows. All rows of a doc_id go where one of them has a benchmark passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, minhash, packing, repeats, rules
from folioflow.llm._tables import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated string that goes: shorter than any passage of over 50 words, longer than a common line.
LEAST_REPEAT = 100


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    entries = rules.ledger(docs.select(F.struct(*COLUMNS).alias("_doc"), "text"), keep=("_doc",))
    # a column that is not deterministic keeps the filter from being pushed below, and so repeating, the measurements
    judged = rules.apply_policy(entries.withColumn("_row", F.monotonically_increasing_id()), "v1")
    return judged.filter("kept AND _row >= 0").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8), once.

    Each row is judged by its own text, so rows that repeat an id stay if their texts are unlike. Of a group's rows with its smallest id,
    those with the least digest of their words are the ones to stay, and of these one, by its other columns; without words, a row stays.
    """
    nameless = docs.filter("doc_id IS NULL").select(*COLUMNS)
    docs = docs.filter("doc_id IS NOT NULL")
    found = minhash.components(docs)
    kept = found.filter("id = component_id AND first").select(F.col("id").alias("doc_id"), F.col("digest").alias("_digest")).distinct()
    rows = docs.select(*COLUMNS, minhash.words_digest("text").alias("_digest")).join(kept, ["doc_id", "_digest"], "left_semi")
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = rows.groupBy("doc_id", "_digest").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", *[F.col("r")[c].alias(c) for c in rest])
    return one.unionByName(nameless)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of LEAST_REPEAT bytes that start in an earlier document, cut between characters; texts that go wholly go."""
    nameless = docs.filter("doc_id IS NULL").select(*COLUMNS)
    found = repeats.remove_repeats(docs.filter("doc_id IS NOT NULL"), least=LEAST_REPEAT, with_text=True, keep=("lang", "source"))
    out = found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"), "n_removed")
    return out.filter("n_removed = 0 OR length(trim(text)) > 0").drop("n_removed").unionByName(nameless)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = materialise(decontaminate.matches(docs, items).select("doc_id").distinct(), "leaked")
    return docs.select(*COLUMNS).join(leaked, "doc_id", "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: doc_id, start, length, shard, bin, offset."""
    return packing.pack(packing.with_keys(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("benchmark leaks", benchmark_leaks),
    ("best-fit packing", best_fit_packing),
]

#: Suffix arrays over bytes and the order of packing are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
