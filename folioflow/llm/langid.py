"""Language identification by a string kernel.

Kernel: the blended spectrum of 1- to GRAM-byte strings, by presence (a string counts once however often it occurs), normalised by the
numbers of strings that both texts have. Bytes are folded first: A-Z to a-z, and whatever is neither a letter of ASCII nor beyond ASCII
to a blank. Strings are told apart by BUCKETS hash values.

Learning: at most SAMPLE texts of each language, whole, the same ones every time (least hashes of their ids); LANDMARKS of each are the
Nyström landmarks. Kernel ridge regression, one language against the rest, is solved in the space that the landmarks span. The model is
landmarks x BUCKETS bits and landmarks x languages numbers: its size follows from parameters and the number of languages.

Scoring: a block of texts is a 0/1 matrix; two matrix products give all scores of the block.

Defined cases: null, empty and letterless texts are `und` with score 0; ties go to the language first in order; with no learnt
language all texts are `und`; repeated rows are predicted alike; of rows that repeat an id and a language, the one whose strings come
first in order is learnt from; whole texts are read, however long, and other columns are not, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import bounded_batches
from ._words import U, chunks

BUCKETS = 1 << 13
GRAM = 3
SAMPLE = 384
LANDMARKS = 24
RIDGE = 0.05
#: With more languages than this, the sample of each is smaller, as SAMPLE x LANGUAGES texts are learnt from at most.
LANGUAGES = 512
#: Ranks are taken within this many parts of a language first.
PARTS = 32

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def presence(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) of 0 and 1."""
    rows = len(at) - 1
    out = np.zeros(rows * BUCKETS, np.uint8)
    if not len(raw):
        return out.reshape(rows, BUCKETS)
    x = _FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
    base = row * BUCKETS
    code = x.copy()
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in range(1, GRAM + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        if n > 1:
            code = (code[:m] << np.uint32(8)) | x[n - 1 :]
        bucket = (((code + np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
        inside = row[:m] == row[n - 1 :]
        out[(base[:m] + bucket)[inside]] = 1
    return out.reshape(rows, BUCKETS)


def has_letter(text: str | Column) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike("\\p{L}"), F.lit(False))


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    n = np.maximum(x.sum(axis=1, dtype=np.float32), 1)[:, None] * np.maximum(landmarks.sum(axis=1, dtype=np.float32), 1)[None, :]
    return (x.astype(np.float32) @ landmarks.T.astype(np.float32)) / np.sqrt(n)


class Model:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.bits, self.weights = languages, np.packbits(landmarks, axis=1), weights.astype(np.float32)

    def score(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its score from 0 to 1) of each row."""
        f = _kernel(presence(raw, at), np.unpackbits(self.bits, axis=1)) @ self.weights
        best = f.argmax(axis=1)
        return best, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1).astype(np.float64)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """The model of df's rows with a language and a letter; None if there are none."""
    bounded_batches(df.sparkSession)
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(F.col(id).cast("string")).alias("h")).distinct()
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "id"))).filter(F.col("rank") <= sample)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("rank") <= sample)
    chosen = ranked.orderBy("rank", "lang").limit(sample * LANGUAGES)
    picked = df.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen.select("id", "lang", "rank")), ["id", "lang"]).filter(has_letter("text"))

    def bits(batches):
        for b in batches:
            for i, j, raw, at in chunks(b.column(3)):
                p = np.packbits(presence(raw, at), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in p], pa.binary())], ["lang", "rank", "id", "bits"])

    got = picked.select("id", "lang", "rank", "text").mapInArrow(bits, f"lang string, rank int, id {dict(df.dtypes)[id]}, bits binary").groupBy("lang", "rank", "id").agg(F.min("bits").alias("bits")).toPandas()  # sample x languages rows of BUCKETS bits
    if not len(got):
        return None
    got = got.sort_values(["rank", "lang", "id"], kind="stable")
    names = sorted(got["lang"].unique())
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in got["bits"]]), axis=1)
    label = np.searchsorted(names, got["lang"].to_numpy())
    marks = np.sort(np.concatenate([np.flatnonzero(label == c)[:landmarks] for c in range(len(names))]))
    z = _kernel(x, x[marks]).astype(np.float64)
    value, vector = np.linalg.eigh(z[marks])
    root = vector / np.sqrt(np.maximum(value, 1e-3))[None, :]
    z = z @ root
    y = np.where(label[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    weight = 1.0 / np.bincount(label, minlength=len(names))[label]
    weight *= len(label) / weight.sum()
    solved = np.linalg.solve(z.T @ (z * weight[:, None]) + RIDGE * len(label) / len(marks) * np.eye(z.shape[1]), z.T @ (y * weight[:, None]))
    return Model(names, x[marks], root @ solved)


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of df: keep, lang_pred, score."""
    bounded_batches(df.sparkSession)
    rows = df.select(*keep, has_letter(text).alias("_letter"), F.col(text).alias("_text"))
    if model is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        names = np.array([*model.languages, "und"], object)
        for b in batches:
            for i, j, raw, at in chunks(b.column(b.num_columns - 1)):
                best, score = model.score(raw, at)
                letter = b.column(b.num_columns - 2).slice(i, j - i).to_numpy(zero_copy_only=False)
                best = np.where(letter, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-2]), pa.array(names[best], pa.string()), pa.array(np.where(letter, score, 0.0))], [*b.schema.names[:-2], "lang_pred", "score"])

    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
