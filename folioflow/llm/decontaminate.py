"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle similarity.

Native: DataFrame and SQL functions only.

A window has as many words as an item; its 64-bit SimHash sums the bits of its shingles' hashes, each as often as it occurs. The 64 bits
are cut into RADIUS + 1 blocks: fingerprints within RADIUS bits agree on one block at least, so a join on (length, block, value) finds
every pair within the radius. Pairs are then checked exactly: sum of least counts over sum of greatest counts of the shingles of both.

A window without a shingle of an item of its length has similarity 0 with all of them, so only windows around shingles that items have
are fingerprinted; this loses nothing. The items' shingles are broadcast if their number is within BROADCAST_ROWS, and joined by a
shuffle otherwise. Each hit carries the hashes around it, so texts are read once and never shuffled.

Words are lower-cased runs of characters other than 0x20 and 0x09-0x0D; a shingle is K words (all words of a shorter item).

Defined cases: null and empty texts and items have no words and no hits; a document shorter than an item is one window, itself; repeated
items and repeated rows give a row for each (document id, item id) once; ties in similarity take the first window; no items, no rows;
rows that repeat an id with other texts give the best window of any of them; whole texts are read, however long, and other columns are
not, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialise, small_enough

K = 5
PERCENT = 80
RADIUS = 23
BROADCAST_ROWS = 500_000
BLANKS = " \t\n\x0b\x0c\r"
#: Hashes that a count of 16 bits holds.
_MOST_OF_16 = 65_535


def words(text: str | Column) -> Column:
    bare = F.btrim(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _hashes(w: str, k: int) -> Column:
    """Of each k-word shingle of the array w, by start; of the whole where it is shorter and not empty."""
    at = lambda i, j: F.get(w, i + j if j else i)
    n = F.size(w)
    full = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[at(i, j) for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(F.col(w)))).otherwise(full)


def _spread(bits: Column, lanes: int) -> Column:
    """The low bits of a long, one in each of so many lanes of another."""
    out = F.lit(0).cast("long")
    for b in range(lanes):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(bits, b).bitwiseAND(F.lit(1).cast("long")), 64 // lanes * b))
    return out


def simhash(hashes: str) -> Column:
    """64 bits: bit b is set where more than half of the hashes (with repeats) have it. Sixteen longs count four bits each; for arrays beyond their range, thirty-two count two each."""
    return F.when(F.size(hashes) <= _MOST_OF_16, _counted(hashes, 4)).otherwise(_counted(hashes, 2))


def _counted(hashes: str, lanes: int) -> Column:
    longs, width = 64 // lanes, 64 // lanes
    start = F.array(*[F.lit(0).cast("long")] * longs)
    add = lambda a, h: F.array(*[F.get(a, F.lit(i)) + _spread(F.shiftrightunsigned(h, lanes * i), lanes) for i in range(longs)])
    n = F.size(hashes)

    def finish(a: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(longs):
            for b in range(lanes):
                count = F.shiftrightunsigned(F.get(a, F.lit(i)), width * b).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
                out = out.bitwiseOR(F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("long"), lanes * i + b)).otherwise(F.lit(0).cast("long")))
        return out

    return F.aggregate(hashes, start, add, finish)


def blocks(fp: str, radius: int = RADIUS) -> Column:
    """Array of (block number, its bits): radius + 1 blocks of nearly equal width."""
    m = radius + 1
    width, extra = divmod(64, m)
    out, at = [], 0
    for i in range(m):
        w = width + (i < extra)
        out.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << w) - 1).cast("long")).cast("int").alias("bits")))
        at += w
    return F.array(*out)


def _as_set(h: str) -> Column:
    """Repeats told apart by their number, so that set operations count them. Where a run of equal hashes begins is spread by doubling steps: n log n in all."""
    plain = F.size(F.array_distinct(h)) == F.size(h)
    once = F.transform(h, lambda x: F.xxhash64(x, F.lit(0)))
    s = F.sort_array(h)
    begin = F.transform(s, lambda x, i: F.when((i > 0) & (x == F.get(s, i - 1)), F.lit(0)).otherwise(i))
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(h).cast("long"))))
    first = F.aggregate(steps, begin, lambda r, k: F.transform(r, lambda x, i: F.greatest(x, F.coalesce(F.get(r, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))))
    told = F.transform(F.arrays_zip(s.alias("x"), first.alias("f")), lambda z, i: F.xxhash64(z["x"], i - z["f"]))
    return F.when(plain, once).otherwise(told)


def matches(docs: DataFrame, items: DataFrame, k: int = K, percent: int = PERCENT, radius: int = RADIUS, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, n_words, similarity): for each document and item with a window of similarity percent / 100 or more, the best window."""
    # Tables are written where a filter would otherwise be pushed below, and so repeat, the splitting of texts.
    it = items.select(F.col(item_id).alias("item_id"), words(item_text).alias("w")).withColumn("h", _hashes("w", k))
    it = materialise(it.select("item_id", F.size("w").alias("n_words"), "h", F.least(F.lit(k), F.size("w")).alias("k"), simhash("h").alias("ifp")), "items").filter("n_words > 0")
    keys = materialise(it.select("n_words", "k", F.explode("h").alias("x")).distinct(), "item-shingles")
    few = small_enough(keys, BROADCAST_ROWS)
    d = docs.select(F.col(id).alias("id"), words(text).alias("w")).withColumn("h", _hashes("w", k))
    hits = _hits(d.select("id", F.size("w").alias("n"), "h"), keys.filter(F.col("k") == k), few, k)
    # items shorter than k have shingles of their own length
    hits = hits.unionByName(_short_hits(docs, keys, id, text, k, few)) if not keys.filter(F.col("k") < k).isEmpty() else hits
    order = Window.partitionBy("id", "n_words").orderBy("pos")
    hits = hits.distinct().withColumn("low", F.greatest(F.col("from"), F.coalesce(F.lag("pos").over(order) + 1, F.lit(0))))
    # windows that have this hit as their first
    last = F.least(F.col("pos"), F.greatest(F.col("n") - F.col("n_words"), F.lit(0)))
    win = hits.filter(F.col("low") <= last).select("id", "n_words", "k", "from", "h", F.explode(F.sequence("low", last)).alias("start"))
    win = win.select("id", "n_words", "start", F.slice("h", F.col("start") - F.col("from") + 1, F.greatest(F.col("n_words") - F.col("k") + 1, F.lit(1))).alias("h"))
    win = materialise(win.withColumn("fp", simhash("h")), "windows")
    one = lambda t, fp: t.select("*", F.explode(blocks(fp, radius)).alias("b")).select("*", F.col("b.block").alias("block"), F.col("b.bits").alias("bits")).drop("b")
    index = one(it.select("item_id", "n_words", "ifp"), "ifp")
    index = F.broadcast(index) if few else index
    near = one(win.select("id", "n_words", "start", "fp"), "fp").join(index, ["n_words", "block", "bits"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    near = near.select("id", "n_words", "start", "item_id").distinct()
    ih = it.select("item_id", F.col("h").alias("ih")).dropDuplicates(["item_id"])
    both = near.join(win.select("id", "n_words", "start", "h"), ["id", "n_words", "start"]).join(F.broadcast(ih) if few else ih, "item_id")
    both = both.withColumns({"a": _as_set("h"), "b": _as_set("ih")})
    both = materialise(both.select("id", "item_id", "start", "n_words", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("common")), "pairs")
    union = F.col("na") + F.col("nb") - F.col("common")
    found = both.filter(100 * F.col("common") >= percent * union).select("id", "item_id", "start", "n_words", (F.col("common") / union).alias("similarity"))
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("m"))
    return best.select(F.col("id").alias(id), "item_id", (-F.col("m.s")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity"))


def _hits(d: DataFrame, keys: DataFrame, few: bool, k: int) -> DataFrame:
    """(id, n, n_words, k, pos, from, h): places of item shingles, with the hashes of all windows over each, the first of which starts at from."""
    x = d.select("id", "n", "h", F.posexplode_outer("h").alias("pos", "x"))
    x = x.join(F.broadcast(keys) if few else keys, "x")
    start = F.greatest(F.lit(0), F.col("pos") - F.greatest(F.col("n_words") - k, F.lit(0)))
    return x.select("id", "n", "n_words", "k", "pos", start.alias("from"), F.slice("h", start + 1, F.col("pos") - start + F.greatest(F.col("n_words") - k + 1, F.lit(1))).alias("h"))


def _short_hits(docs: DataFrame, keys: DataFrame, id: str, text: str, k: int, few: bool) -> DataFrame:
    """For items of fewer than k words: their own number of words is the shingle length."""
    out = None
    for m in range(1, k):
        d = docs.select(F.col(id).alias("id"), words(text).alias("w"))
        # an item shorter than k is hashed as one array
        h = F.when(F.size("w") >= m, F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: F.xxhash64(F.slice("w", i + 1, m))))  # noqa: B023
        part = _hits(d.select("id", F.size("w").alias("n"), h.alias("h")), keys.filter(F.col("k") == m), few, m)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that have a match."""
    found = matches(docs, items, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")
