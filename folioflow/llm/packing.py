"""Best-fit packing under conflicts: pieces of documents go to bins of fixed capacity; a bin takes no two pieces that share a
source or a duplicate cluster.

Only lengths, sources and cluster keys travel; texts don't. Rows are numbered once and dealt to shards of bounded size by row
number, so neither a hot source nor a hot document fills one task. In a shard, pieces come longest first (best-fit decreasing).

Bins are ordered by what they have left. Each bin carries one bitmap: a bit for each source it holds, and one for each duplicate
cluster it holds that has another piece in the shard. A tree over the residuals keeps, for each range, the bits that *all* bins of
the range have; the search for a successor skips a range whose common bits meet the piece's own, and so goes on from the tightest
fit to the next until the tightest compatible bin is found, or there is none and a bin is opened.

Defined cases: a text longer than the capacity is cut into full pieces and a rest (pieces of one document conflict, as they share
its source); null and empty texts have no piece; a null source conflicts with nothing; ties go to the lower bin number; repeated
rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import numbered

CAPACITY = 8192
#: Length units of a shard, on average; a shard is one task's work.
SHARD_UNITS = 16_000_000


class Bins:
    """The open bins of a shard, by residual capacity."""

    ALL = -1

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.tree = [self.ALL] * (2 * self.size)  # common bits of a range; ALL where it has no bin
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.size)]
        self.next = 0
        self.capacity = capacity

    def _update(self, r: int) -> None:
        common = self.ALL
        for bits in self.at[r]:
            common &= bits
        tree, i = self.tree, r + self.size
        while i and tree[i] != common:
            tree[i] = common
            i >>= 1
            if i:
                common = tree[2 * i] & tree[2 * i + 1]

    def _find(self, need: int, bits: int) -> int:
        """The least residual of at least need with a bin that has none of bits; -1 if none has."""
        tree, size = self.tree, self.size
        i = need + size
        while True:
            common = tree[i]
            if common == self.ALL or common & bits:  # nothing here, or all conflict: the next range to the right
                while i & 1:
                    i >>= 1
                if i == 0:
                    return -1
                i += 1
                if i & (i - 1) == 0:  # past the right edge
                    return -1
            elif i >= size:
                if any(not b & bits for b in self.at[i - size]):
                    return i - size
                tree_i = i
                while tree_i & 1:
                    tree_i >>= 1
                if tree_i == 0:
                    return -1
                i = tree_i + 1
                if i & (i - 1) == 0:
                    return -1
            else:
                i *= 2

    def place(self, need: int, bits: int) -> tuple[int, int]:
        """(bin, offset in the bin) for a piece of length need."""
        r = self._find(need, bits)
        if r < 0:
            b, r, held = self.next, self.capacity, 0
            self.next += 1
        else:
            held, b = min(((k, v[-1]) for k, v in self.at[r].items() if not k & bits), key=lambda x: x[1])
            self.at[r][held].pop()
            if not self.at[r][held]:
                del self.at[r][held]
            self._update(r)
        left = r - need
        if left:
            stack = self.at[left].setdefault(held | bits, [])
            stack.append(b)
            stack.sort(reverse=True)
            self._update(left)
        return b, self.capacity - r


def pack_shard(lengths: np.ndarray, sources: list, clusters: list, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, bin, offset) of each piece, in the order of packing."""
    whole = lengths // capacity
    row = np.repeat(np.arange(len(lengths)), whole + (lengths % capacity > 0))
    first = np.concatenate([[0], np.cumsum(whole + (lengths % capacity > 0))])
    start = (np.arange(len(row)) - first[row]) * capacity
    size = np.minimum(capacity, lengths[row] - start)
    order = np.lexsort((start, row, -size))
    seen: dict = {}
    for c in clusters:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    bit: dict = {}
    masks = []
    for s, c in zip(sources, clusters, strict=True):
        m = 0
        if s is not None:
            m |= 1 << bit.setdefault((0, s), len(bit))
        if c is not None and seen[c] > 1:
            m |= 1 << bit.setdefault((1, c), len(bit))
        masks.append(m)
    bins, n = Bins(capacity), len(row)
    to, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, i in enumerate(order):
        to[k], at[k] = bins.place(int(size[i]), masks[row[i]])
    return row[order], start[order], size[order], to, at


def pack(df: DataFrame, length: str = "n_tokens", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, shard_units: int = SHARD_UNITS) -> DataFrame:
    """df's columns doc_id, length, source, cluster -> a row per piece: doc_id, start, length, shard, bin, offset. (shard, bin) names a sequence."""
    rows = numbered(df.select("doc_id", F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"), F.col(source).cast("string").alias("s"), F.col(cluster).cast("string").alias("c")), "lengths")
    units = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(units / shard_units))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        ids, n = table.column("doc_id").combine_chunks(), np.asarray(table.column("n").combine_chunks())
        row, start, size, to, at = pack_shard(n, table.column("s").to_pylist(), table.column("c").to_pylist(), capacity)
        shard = np.full(len(row), table.column("shard")[0].as_py(), np.int32)
        return pa.table({"doc_id": ids.take(pa.array(row)), "start": start, "length": size, "shard": shard, "bin": to, "offset": at})

    kind = dict(df.dtypes)["doc_id"]
    return rows.filter("n > 0").withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(run, f"doc_id {kind}, start long, length long, shard int, bin long, offset long")


def with_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_tokens (UTF-8 bytes: the vocabulary of single bytes), source and cluster (equal texts) of documents."""
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_tokens"), "source", F.md5(F.col(text).cast("binary")).alias("cluster"))
