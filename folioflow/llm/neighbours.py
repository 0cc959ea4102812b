"""Quality by nearest-neighbour voting over labelled latent-semantic vectors.

Terms: hashed pairs of bytes (case, marks and blanks included) and words that repeat one of the last two words; a text is the square
roots of its terms' shares, weighted by rarity. A truncated singular value decomposition of the labelled sample gives DIMENSIONS latent
axes. Labelled vectors are broadcast: at most SAMPLE per label, so their size follows from parameters alone.

Every document is compared with every labelled vector, exactly, as blocks of matrix products; the NEIGHBOURS most similar vote with
their similarity as weight.

Defined cases: null and empty texts have no terms and take the share of label 1 among all labels learnt; with no labels every score is
0.5; with one label only, it is everyone's; ties in similarity are settled by the order of the sample (rank, label, id); repeated rows
score alike; an id with both labels teaches nothing; of rows that repeat a labelled id, the one whose terms come first in order is
learnt from; whole texts are read, however long, and other columns are not, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import bounded_batches
from ._words import chunks, words

TERMS = 1 << 12
DIMENSIONS = 48
SAMPLE = 1000
NEIGHBOURS = 25
THRESHOLD = 0.7
#: Ranks are taken within this many parts of a label first.
PARTS = 32
_EXTRA = 8


def terms(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, TERMS) square roots of shares."""
    rows = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(rows, dtype=np.int64), size)
    width = TERMS - _EXTRA
    out = np.zeros((rows, TERMS), np.float32)
    if len(raw) > 1:
        pair = (raw[:-1].astype(np.uint32) << np.uint32(8)) | raw[1:]
        bucket = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(width)
        inside = row[:-1] == row[1:]
        n = np.bincount((row[:-1] * width + bucket)[inside], minlength=rows * width).reshape(rows, width)
        out[:, :width] = np.sqrt(n / np.maximum(size - 1, 1)[:, None])
    h, first = words(raw, at)
    count = np.maximum(np.diff(first), 1)
    word_row = np.repeat(np.arange(rows), np.diff(first))
    for back in (1, 2):
        if len(h) > back:
            same = (h[back:] == h[:-back]) & (word_row[back:] == word_row[:-back])
            out[:, width + back] = np.sqrt(np.bincount(word_row[back:][same], minlength=rows) / count) * 2
    return out


class Model:
    def __init__(self, weight: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, share: float):
        self.weight, self.axes, self.vectors, self.labels, self.share = weight, axes, vectors, labels, share

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weight) @ self.axes
        n = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return np.divide(z, n, out=np.zeros_like(z), where=n > 0)

    def score(self, raw: np.ndarray, at: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        x = terms(raw, at)
        empty = ~x.any(axis=1)
        z, out = self.latent(x), np.empty(len(x))
        k = min(neighbours, len(self.labels))
        for i in range(0, len(z), block):
            sim = z[i : i + block] @ self.vectors.T
            least = np.partition(sim, -k, axis=1)[:, -k, None]
            above, equal = sim > least, sim == least
            chosen = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
            w = np.where(chosen, np.maximum(sim, 0) + 1e-9, 0).astype(np.float64)
            out[i : i + block] = w @ self.labels / w.sum(axis=1)
        out[empty] = self.share
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id: str = "doc_id", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model | None:
    """From docs with a 0/1 label. At most `sample` whole texts of each label are used, those with the least hashes of their ids.

    Ids are joined with labels first; texts are only read for the chosen ids, which are few and broadcast, so no text is shuffled.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.filter(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("y"))
    marked = marked.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).filter("y = _y").drop("_y")
    rows = docs.select(F.col(id).alias("id")).distinct().join(marked, "id")
    share = rows.agg(F.avg(F.col("y").cast("double"))).first()[0]
    if share is None:
        return None
    hashed = rows.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    first = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("y", F.pmod("h", F.lit(PARTS))).orderBy("h", "id"))).filter(F.col("rank") <= sample)
    chosen = first.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))).filter(F.col("rank") <= sample).select("id", "rank", "y")
    picked = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "rank", "text")

    def run(batches):
        for b in batches:
            for i, j, raw, at in chunks(b.column(3)):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), pa.array([r.tobytes() for r in terms(raw, at).astype(np.float16)], pa.binary())], ["id", "y", "rank", "x"])

    got = picked.mapInArrow(run, f"id {dict(docs.dtypes)[id]}, y int, rank int, x binary").groupBy("id", "y", "rank").agg(F.min("x").alias("x")).toPandas()  # 2 x sample rows of TERMS halves
    got = got.sort_values(["rank", "y", "id"], kind="stable")
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    y = got["y"].to_numpy().astype(np.float64)
    weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    a = x * weight
    value, vector = np.linalg.eigh((a @ a.T).astype(np.float64))
    keep = [i for i in np.argsort(-value)[:dimensions] if value[i] > 1e-6]
    axes = (a.T.astype(np.float64) @ (vector[:, keep] / np.sqrt(value[keep]))).astype(np.float32)
    m = Model(weight, axes, np.zeros((0, len(keep)), np.float32), y, float(share))
    m.vectors = m.latent(x)
    return m


def classify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """Per row of df: keep, score, predicted."""
    spark = df.sparkSession
    bounded_batches(spark)
    if model is None:
        return df.select(*keep, F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i, j, raw, at in chunks(b.column(b.num_columns - 1)):
                score = sent.value.score(raw, at)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    schema = df.select(*keep).schema.add("score", "double").add("predicted", "integer")
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
