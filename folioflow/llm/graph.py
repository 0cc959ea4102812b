"""Connected components by alternating large-star and small-star steps, on tables; nothing comes to the driver but a count.

A vertex with many neighbours is never gathered: each step is a least neighbour (pre-aggregated) and a join with it. Up to FEW edges,
which are counted first, one task does all by union-find; the result is the same.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import materialise

FEW = 1_000_000


def _by_union_find(batches):
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(up.setdefault(u, u)), top(up.setdefault(v, v))
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], ["id", "component"])


def connected_components(edges: DataFrame, most_rounds: int = 40, few: int = FEW) -> DataFrame:
    """edges (a, b) -> (id, component) for every vertex of an edge; component is the least id reachable. Self-loops and repeats are fine; no edges give no rows.

    Raises where most_rounds, far more than the logarithm of any diameter, do not do.
    """
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(e)
    if mark[0] <= few:
        kind = dict(e.dtypes)["u"]
        return materialise(e.coalesce(1).mapInArrow(_by_union_find, f"id {kind}, component {kind}"), "components")
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.filter("u <> v").distinct(), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    """A fingerprint of the set of edges: their number and two sums of hashes."""
    h = lambda seed: F.sum((F.xxhash64("u", "v", F.lit(seed)) % 1_000_000_007).cast("decimal(38,0)"))
    return tuple(e.agg(F.count("*"), h(1), h(2)).first())
