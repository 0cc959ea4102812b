"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. Rows are numbered once and written to the shared folder, so that partitions are fixed (a lost executor can't move a row).
2. The driver draws how many rows each source partition sends to each shard: row i of the matrix is a multivariate hypergeometric
   draw from what the shards still lack. That is the law of a uniform shuffle, and the column sums are the exact shard sizes.
   The matrix has partitions x shards entries, whatever the number of rows.
3. Each partition permutes its rows and cuts them by its row of the matrix.
4. Each shard permutes again. Its rows are dealt to blocks by random keys, so no task sorts a whole shard; block counts give offsets.

Only ids, sizes and checksums travel. Law: `rows` (shard counts at most one apart).

Defined cases: a null text has no bytes (size 1, checksum of nothing, 0); repeated rows are rows of their own; with fewer rows
than shards some shards are empty; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import numbered

#: Rows of a block of the second permutation, on average.
BLOCK_ROWS = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn. Beyond numpy's bound (1e9) by rejection from a table-mountain hat (Stadlober's ratio of uniforms)."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    m, least = min(n, total - n), min(good, bad)
    mean = m * least / total
    sd = math.sqrt((total - m) * m * least / total * (1 - least / total) / (total - 1) + 0.5)
    a, c, h = mean + 0.5, 0.0, 1.7155277699214135 * sd + 0.8989161620588988
    lf = lambda k: math.lgamma(k + 1) + math.lgamma(least - k + 1) + math.lgamma(m - k + 1) + math.lgamma(total - least - m + k + 1)
    mode = (m + 1) * (least + 1) // (total + 2)
    top, end = lf(mode), min(m, least) + 1
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = a + h * (v - 0.5) / u
        if not c <= x < end:
            continue
        k = int(x)
        if 2 * math.log(u) <= top - lf(k):
            break
    k = k if least == good else m - k
    return k if m == n else good - k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """counts[i] rows go out from partition i and sizes[j] come in to shard j; sums agree. Each entry is drawn, none rounded."""
    rng, left = np.random.default_rng(seed), [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(int(x) for x in counts):
        rest = sum(left)
        for j in range(len(left)):
            rest -= left[j]
            k = hypergeometric(rng, left[j], rest, n) if n else 0
            out[i, j] = k
            left[j] -= k
            n -= k
    return out


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def shuffle_to_shards(df: DataFrame, shards: int = 16, seed: int = 0, sizes: list[int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with shard and slot (its place in the shard, from 0). df should hold narrow rows; sizes defaults to counts at most one apart."""
    spark, names = df.sparkSession, df.columns
    rows = numbered(df.select(F.struct(*names).alias("_row")), "rows")
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    parts, total = sorted(counts), sum(counts.values())
    sizes = sizes or even_sizes(total, shards)
    if sum(sizes) != total or len(sizes) != shards:
        raise ValueError("sizes must add up to the number of rows")
    cuts = communication_matrix([counts[p] for p in parts], sizes, seed).cumsum(axis=1)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("_cuts", T.ArrayType(T.LongType()))])
    matrix = spark.createDataFrame([(p, c.tolist()) for p, c in zip(parts, cuts, strict=True)], schema)
    local = Window.partitionBy("part").orderBy(F.xxhash64("rid", F.lit(seed)), "rid")
    sent = rows.withColumn("_rank", F.row_number().over(local) - 1).join(matrix, "part")
    shard = F.aggregate("_cuts", F.lit(0), lambda a, c: a + F.when(c <= F.col("_rank"), 1).otherwise(0))
    blocks = max(1, math.ceil(max(sizes) / block_rows))
    key = F.xxhash64("rid", F.lit(seed + 1))
    dealt = sent.select("_row", "rid", shard.alias("shard"), key.alias("_key")).withColumn("_block", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(blocks)).cast("int"))
    fill = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fill.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = Window.partitionBy("shard", "_block").orderBy("_key", "rid")
    out = dealt.withColumn("_in", F.row_number().over(place) - 1).join(offsets, ["shard", "_block"])
    return out.select(*[F.col("_row")[n].alias(n) for n in names], "shard", (F.col("_offset") + F.col("_in")).cast("long").alias("slot"))


def light_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more) and text_crc32, all that sharding needs of a document."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
