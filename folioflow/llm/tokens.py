"""Exact token length histogram, and what its suffix sums answer.

Defined cases: a null or empty text has length 0; repeated rows count as often as they occur; an empty table has an empty
histogram; clashing columns don't matter, as only the text is read; a text is encoded whole, however long. Sums stand at the lengths
that occur; at_limits answers any other.
"""

from __future__ import annotations

import base64
import threading

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths are dealt to blocks of so many values for the running sums.
BLOCK = 1024

_encoders: dict = {}
_lock = threading.Lock()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    key = (hash(ranks), pattern)
    with _lock:
        if key not in _encoders:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
            _encoders[key] = tiktoken.Encoding("folioflow", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return _encoders[key]


def encoded_lengths(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """Per row: keep and n_tokens (long). The vocabulary file is read on the driver and sent with the tasks; its size is fixed, whatever the corpus."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    pattern = pattern or default_pattern()

    def run(batches):
        encode = _encoder(ranks, pattern).encode_ordinary
        for b in batches:
            n = [0 if t is None else len(encode(t)) for t in (x.as_py() for x in b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", "long")
    return rows.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents for each length: one row for each length and task leaves the map side."""
    return lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per length L: documents and tokens of length L or more and below L, the total if every document is cut at L, and L's rank.

    Blocks of lengths are summed first, so no task sorts more than one block and the short list of blocks. The histogram is written once,
    as both steps read it and texts should be encoded once.
    """
    h = materialise(histogram, "histogram").withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    over = lambda *by_: Window.partitionBy(*by_)
    blocks = h.groupBy(*by, "_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_tokens").alias("_bt"))
    after = over(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select(*by, "_block", zero(F.sum("_bd").over(after)).alias("_ad"), zero(F.sum("_bt").over(after)).alias("_at"), F.sum("_bd").over(over(*by)).alias("_all_d"), F.sum("_bt").over(over(*by)).alias("_all_t"))
    inner = over(*by, "_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.withColumns({"_id": F.sum("n_docs").over(inner), "_it": F.sum("_tokens").over(inner)}).join(blocks, [*by, "_block"])
    ge_d, ge_t = F.col("_id") + F.col("_ad"), F.col("_it") + F.col("_at")
    return out.select(
        *by,
        "n_tokens",
        "n_docs",
        ge_d.alias("docs_at_least"),
        ge_t.alias("tokens_at_least"),
        (F.col("_all_d") - ge_d).alias("docs_below"),
        (F.col("_all_t") - ge_t + F.col("n_tokens") * ge_d).alias("truncated_total"),
        ((F.col("_all_d") - ge_d + F.col("n_docs")) / F.col("_all_d")).alias("rank"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit of the caller's short list: documents of that length or more, and the total if all are cut there. One pass, one row per limit."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = zero(F.max("tokens_at_least"))

    def answer(limit: int) -> Column:
        first = F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))
        over, tokens = zero(F.min(first)["docs_at_least"]), zero(F.min(first)["tokens_at_least"])
        return F.struct(F.lit(int(limit)).cast("long").alias("context"), over.alias("docs_at_least"), (total - tokens + limit * over).alias("truncated_total"))

    return sums.agg(F.array(*[answer(x) for x in limits]).alias("a")).select(F.inline("a"))


def quantile(sums: DataFrame, q: float) -> Column:
    """An aggregate over suffix_sums(): the least length whose rank is at least q."""
    return F.min(F.when(F.col("rank") >= q, F.col("n_tokens")))
