"""Near duplicates by b-bit MinHash.

1. One pass over the texts: shingle sets, minima under K permutations, of which b low bits each are kept, packed into longs; keys of
   bands of r whole minima; a 128-bit digest of the normalised words. Rows of equal digests are one vertex from there on.
2. Candidates share a band. Each band bucket sends its members to one hub (a star), never pair by pair. A candidate passes if its
   similarity, estimated from the number of equal lanes and corrected for chance collisions of b bits, is within five standard
   deviations of the threshold; it is a link if the full sets say so.
3. Buckets that still span components are open. Members outside a bucket's main component meet all members of the bucket, across
   components only, by bit counts, in tiles of bounded size; a tile says which members are candidates by a spanning forest of them, so
   it gives fewer rows than it has members. The components of these forests are clusters: whatever pair is left to decide lies in one.
4. The texts of a cluster's members, once each, go to tiles of bounded weight. A tile counts what each member outside the main
   component has in common with every other, through an inverted index of the full sets, and gives the links that join two components,
   again a forest. No pair of members is ever a row, no bucket is capped and no group is gathered in one task.
5. Links are confirmed on the shingles themselves, not on hashes of them. Components come from graph.connected_components.

r and the number of bands follow from the threshold: a pair at the threshold shares no band with probability MISS at most.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own component; a text of
fewer than k words has its whole sequence as its one shingle; rows that repeat an id share its component, whatever their texts; equal
sets are always linked; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, materialise
from ._words import U, chunks, mix, normalised, real_shingles, row_sets, shingles, words
from .graph import connected_components

ROWS = 6
MISS = 3e-7
BITS = 2
#: Members of a tile, on each side, on average; and shingles of a tile's side that compares full sets.
TILE = 4096
WEIGHT = 2_000_000


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(values: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) least values under n permutations of 32 bits; rows must not be empty."""
    xor, times = _permutations(n)
    x = (values >> U(32)).astype(np.uint32)
    out, y, starts = np.empty((n, len(ends) - 1), np.uint32), np.empty_like(x), ends[:-1]
    for k in range(n):
        np.bitwise_xor(x, xor[k], out=y)
        np.multiply(y, times[k], out=y)
        np.minimum.reduceat(y, starts, out=out[k])
    return out.T


def pack_bits(m: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each minimum, 64 / bits lanes to a long; lanes beyond the last are 0."""
    lanes = 64 // bits
    low = (m & np.uint32((1 << bits) - 1)).astype(U)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % lanes)))
    shifts = (np.arange(lanes, dtype=U) * U(bits))[None, None, :]
    return np.bitwise_or.reduce(low.reshape(len(low), -1, lanes) << shifts, axis=2)


def band_keys(m: np.ndarray, rows: int) -> np.ndarray:
    groups = m.reshape(len(m), -1, rows).astype(U)
    key = np.broadcast_to(np.arange(1, groups.shape[1] + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15), groups.shape[:2]).copy()
    for j in range(rows):
        key = mix(key ^ groups[:, :, j])
    return key


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_digest(text: str | Column) -> Column:
    """MD5 of a text's words, A-Z as a-z, with a blank between."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.md5(F.btrim(F.regexp_replace(F.translate(t, _UPPER, _UPPER.lower()), "[\\x09-\\x0D\\x20]+", " "), F.lit(" ")).cast("binary"))


def _hex() -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("digest_a", "digest_b")])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def signatures(df: DataFrame, id: str, text: str, k: int, bands: int, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """id, n_shingles, digest_a, digest_b (of the normalised words), sig and bands (lists of longs; zeros for empty sets)."""
    bounded_batches(df.sparkSession)
    n = bands * rows

    def run(batches):
        for batch in batches:
            for i, j, raw, at in chunks(batch.column(1)):
                values, ends = row_sets(*shingles(*words(raw, at), k))
                size = np.diff(ends)
                full = np.flatnonzero(size)
                body = raw.tobytes()
                digest = np.frombuffer(b"".join(hashlib.md5(normalised(body[s:e])).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), ">i8").astype(np.int64).reshape(-1, 2)
                sig, keys = np.zeros((len(size), -(-n * bits // 64)), U), np.zeros((len(size), bands), U)
                if len(full):
                    m = minima(values, np.append(ends[:-1][full], ends[-1]), n)
                    sig[full], keys[full] = pack_bits(m, bits), band_keys(m, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(sig), _lists(keys)], ["id", "n_shingles", "digest_a", "digest_b", "sig", "bands"])

    kind = dict(df.dtypes)[id]
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, digest_a long, digest_b long, sig array<long>, bands array<long>")


def _lane_mask(bits: int) -> int:
    return sum(1 << i for i in range(0, 64, bits))


def estimate(a: str, b: str, lanes: int, bits: int = BITS) -> Column:
    """Similarity from two packed signatures: equal lanes by bit counts, corrected for lanes that agree by chance."""
    mask = _lane_mask(bits)
    mask = mask - 2**64 if mask >= 2**63 else mask
    differ = F.lit(0)
    for w in range(-(-lanes * bits // 64)):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        y = x
        for s in range(1, bits):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(y.bitwiseAND(F.lit(mask).cast("long")))
    chance = 2.0**-bits
    return ((1 - differ / lanes) - chance) / (1 - chance)


def least_estimate(percent: int, lanes: int, bits: int = BITS) -> float:
    t, chance = percent / 100, 2.0**-bits
    p = t + (1 - t) * chance
    return t - 5 * math.sqrt(p * (1 - p) / lanes) / (1 - chance)


def most_differing(percent: int, lanes: int, bits: int = BITS) -> int:
    """Lanes that may differ for an estimate of least_estimate or more."""
    chance = 2.0**-bits
    return math.floor(lanes * (1 - (least_estimate(percent, lanes, bits) * (1 - chance) + chance)) + 1e-9)


def _linked(a: bytes, b: bytes, k: int, percent: int) -> bool:
    """The rule itself, on shingles, not on hashes of them."""
    s, t = real_shingles(a, k), real_shingles(b, k)
    common = len(s & t)
    return common > 0 and 100 * common >= percent * (len(s) + len(t) - common)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where groups begin and the end) of batches sorted by their first columns, so that a group is never torn."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        first = tuple(c[0] for c in columns)
        if held and last != first:
            yield _joined(held)
            held = []
        last = tuple(c[-1] for c in columns)
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(b)
            continue
        held.append(b.slice(0, cuts[0]))
        yield _joined(held)
        if len(cuts) > 1:
            yield pa.Table.from_batches([b.slice(cuts[0], cuts[-1] - cuts[0])]).combine_chunks(), cuts - cuts[0]
        held = [b.slice(cuts[-1])]
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    return t, np.array([0, t.num_rows])


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


class _Apart:
    """Which of some things are known to hang together."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def unite(self, x: int, others: np.ndarray) -> np.ndarray:
        """Unites x with others; of each set that is new to x, the first of them."""
        found, first = np.unique(self.label[others], return_index=True)
        first = first[found != self.label[x]]
        if len(first):
            self.label[np.isin(self.label, found)] = self.label[x]
        return others[np.sort(first)]


def _forest(few: np.ndarray, every: np.ndarray, c: np.ndarray, n: np.ndarray, sig: np.ndarray, most: int, percent: int, bits: int) -> list[tuple[int, int]]:
    """Places (x, y) of candidates of different components that tie all candidates of a tile together."""
    apart, out, mask = _Apart(np.arange(len(c))), [], U(_lane_mask(bits))
    for x in few.tolist():
        rest = every[(c[every] != c[x]) & (np.minimum(n[every], n[x]) * 100 >= np.maximum(n[every], n[x]) * percent)]
        step = 256
        while True:
            rest = rest[apart.label[rest] != apart.label[x]]
            if not len(rest):
                break
            some, rest = rest[:step], rest[step:]
            step *= 2
            d = sig[some] ^ sig[x]
            y = d.copy()
            for s in range(1, bits):
                y |= d >> U(s)
            near = some[np.bitwise_count(y & mask).sum(axis=1, dtype=np.int64) <= most]
            if len(near):
                out += [(x, y) for y in apart.unite(x, near).tolist()]
    return out


def _tile_candidates(tiles: DataFrame, percent: int, lanes: int, bits: int) -> DataFrame:
    """(a, b): of each tile of rows (key, i, j, v, c, n, few, every, sig), a spanning forest of candidates."""
    most = most_differing(percent, lanes, bits)

    def run(batches):
        for t, bounds in _whole_groups(batches, 3):
            v, c, n, few, every = (_numbers(t, x) for x in ("v", "c", "n", "few", "every"))
            sig = t.column("sig").combine_chunks().flatten().to_numpy().view(U).reshape(len(v), -1)
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out += [(v[s + x], v[s + y]) for x, y in _forest(np.flatnonzero(few[s:e]), np.flatnonzero(every[s:e]), c[s:e], n[s:e], sig[s:e], most, percent, bits)]
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles.select("key", "i", "j", "v", "c", "n", "few", "every", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


class _Index:
    """What sets have in common with others of a tile, by an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, U)
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        values = values[order]
        self.first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.values = values[self.first]
        self.count = np.diff(np.append(self.first, len(values)))

    def linked(self, s: np.ndarray, open_: np.ndarray, percent: int) -> Iterator[int]:
        """Sets of open_ (flags) that are linked with s, the likeliest first.

        Only the rarest strings of s are looked up for all; sets that have too few of them cannot be linked, the others are compared.
        """
        if not len(self.values):
            return
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        n = len(s)
        missing = n - len(at)
        take = max(0, min(len(at), 2 * (n - (n * percent + 99) // 100) + 1 - missing))
        rare = at[np.argsort(self.count[at], kind="stable")[:take]]
        size = self.count[rare]
        places = np.repeat(self.first[rare] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        hits = np.bincount(self.owner[places], minlength=len(self.size))
        # 100 common >= percent (n + m - common)
        need = -(-percent * (n + self.size) // (100 + percent))
        may = np.flatnonzero(open_ & (hits + len(at) - take >= need) & (np.minimum(n, self.size) * 100 >= np.maximum(n, self.size) * percent))
        for y in may[np.argsort(-hits[may], kind="stable")].tolist():
            if open_[y]:
                common = len(np.intersect1d(s, self.sets[y], assume_unique=True))
                if common and common >= need[y]:
                    yield y


def _tile_links(tiles: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): components that links of each tile join; tiles has (key, i, j, v, c, few, every), texts (v, text) with each vertex once."""

    def run(batches):
        for t, bounds in _whole_groups(batches, 3):
            # rows of another text with the same id are no vertex
            c, few, every = (_numbers(t, x) for x in ("c", "few", "every"))
            column = t.column("text").combine_chunks()
            own = _own(column, _numbers(t, "digest_a"), _numbers(t, "digest_b"))
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                here = s + np.flatnonzero(own[s:e])
                if len(here) < 2:
                    continue
                out += _links(c[here], few[here], every[here], column.take(pa.array(here)), k, percent)
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = tiles.select("key", "i", "j", "v", "c", "few", "every").join(texts, "v").select("key", "i", "j", "v", "c", "few", "every", "digest_a", "digest_b", "text")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _own(column: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether texts have the digests."""
    out = np.zeros(len(column), bool)
    for i, x in enumerate(column):
        if x.is_valid:
            out[i] = hashlib.md5(normalised(x.as_buffer().to_pybytes())).digest() == struct.pack(">qq", a[i], b[i])
    return out


def _links(c: np.ndarray, few: np.ndarray, every: np.ndarray, column: pa.Array, k: int, percent: int) -> list[tuple[int, int]]:
    out = []
    apart = _Apart(np.unique(c, return_inverse=True)[1])
    sets = _sets(column, k)
    all_ = np.flatnonzero(every)
    index = _Index([sets[y] for y in all_])
    body: dict[int, bytes] = {}
    text = lambda i: body.setdefault(i, column[i].as_py().encode())
    for x in np.flatnonzero(few).tolist():
        open_ = apart.label[all_] != apart.label[x]
        if not open_.any():
            continue
        for place in index.linked(sets[x], open_, percent):
            y = all_[place]
            if apart.label[y] != apart.label[x] and _linked(text(x), text(int(y)), k, percent):
                apart.unite(x, np.array([y]))
                out.append((c[x], c[y]))
                open_ &= apart.label[all_] != apart.label[x]
        body.pop(x, None)
    return out


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for _, _, raw, at in chunks(column):
        values, ends = row_sets(*shingles(*words(raw, at), k))
        out += [values[ends[x] : ends[x + 1]] for x in range(len(ends) - 1)]
    return out


def _dealt(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """rows (key, v, c, ...) with the tiles (i, j) that they go to, and whether they are of the few or of everyone there.

    The few are those outside the most frequent component of their key. Either side of a tile weighs `most` on average; rows of a key
    whose sides fit one tile go to that tile alone.
    """
    sizes = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "c", "w")).alias("m"), F.sum("w").alias("w"))
    tiles = lambda w: F.greatest(F.lit(1), F.ceil(w / most)).cast("int")
    main = main.select("key", F.col("m.c").alias("main"), tiles(F.col("w") - F.col("m.w")).alias("g"), tiles(F.col("w")).alias("h"))
    x = rows.join(main, "key").withColumns({"fi": F.pmod(F.xxhash64("v", F.lit(1)), "g").cast("int"), "ej": F.pmod(F.xxhash64("v", F.lit(2)), "h").cast("int")})
    outside = F.col("c") != F.col("main")
    across = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda i: F.struct(i.alias("i"), F.col("ej").alias("j")))
    along = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.struct(F.col("fi").alias("i"), j.alias("j")))
    where = F.when(outside, F.array_union(across, along)).otherwise(across)
    one = x.filter("g = 1 AND h = 1").withColumns({"i": F.lit(0), "j": F.lit(0)})
    several = x.filter("g > 1 OR h > 1").withColumn("t", F.explode(where)).withColumns({"i": F.col("t.i"), "j": F.col("t.j")}).drop("t")
    return one.unionByName(several).withColumns({"few": outside & (F.col("fi") == F.col("i")), "every": F.col("ej") == F.col("j")}).drop("main", "g", "h", "fi", "ej")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """A row per row of df: id, n_shingles, component_id (the least id reachable by links), kept (id is its component)."""
    found = components(df, id, text, k, percent, rows, bits)
    return found.select(F.col("id").alias(id), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def components(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """A row per row of df: id, n_shingles, component_id, digest (words_digest of its text), first (of the texts of its component with the least id, its own has the least digest)."""
    bands = bands_for(percent, rows)
    lanes, cutoff = bands * rows, least_estimate(percent, bands * rows, bits)
    seen = materialise(signatures(df, id, text, k, bands, rows, bits), "signatures")
    best = seen.filter("n_shingles > 0").groupBy("digest_a", "digest_b").agg(F.min(F.struct("id", "n_shingles", "sig", "bands")).alias("r"))
    reps = best.select("digest_a", "digest_b", "r.id", F.col("r.n_shingles").alias("n"), "r.sig", "r.bands", F.monotonically_increasing_id().alias("v"))
    reps = materialise(reps, "vertices")
    texts = df.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(reps.select("id", "v", "digest_a", "digest_b"), "id").select("v", "digest_a", "digest_b", "text")
    member = reps.select("v", F.explode("bands").alias("key"))

    # one star for each bucket; of the hubs that a member is a candidate of, it is compared with the likeliest
    hubs = member.groupBy("key").agg(F.min("v").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    star = member.join(hubs, "key").filter("v <> hub").select("hub", "v").distinct()
    of = lambda name, s: reps.select(F.col("v").alias(name), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))
    star = star.join(of("hub", "a"), "hub").join(of("v", "b"), "v")
    star = star.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).withColumn("e", estimate("sa", "sb", lanes, bits)).filter(F.col("e") >= cutoff)
    star = materialise(star.groupBy("v").agg(F.max(F.struct("e", (-F.col("hub")).alias("hub"), "nb")).alias("m")).select(F.col("v"), (-F.col("m.hub")).alias("key"), F.col("m.nb").alias("n")), "stars")
    weights = star.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / WEIGHT)).cast("int").alias("h"))
    leaf = star.join(weights, "key").select("key", "v", F.pmod(F.xxhash64("v"), "h").cast("int").alias("j"), F.lit(False).alias("few"))
    middle = weights.select("key", F.col("key").alias("v"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("j"), F.lit(True).alias("few"))
    tiles = leaf.unionByName(middle).withColumns({"i": F.lit(0), "c": F.col("v"), "every": ~F.col("few")})
    found = connected_components(materialise(_tile_links(tiles, texts, k, percent), "links"))

    # candidates across components, in buckets that span several
    label = reps.select("v", "n", "sig").join(found.withColumnRenamed("id", "v"), "v", "left").select("v", "n", "sig", F.coalesce("component", "v").alias("c"))
    label = materialise(label, "labels")
    member = member.join(label.select("v", "c"), "v")
    spans = member.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key")
    rest = materialise(member.join(spans, "key"), "open")
    near = materialise(_tile_candidates(_dealt(rest.withColumn("one", F.lit(1)), "one", TILE).join(label.select("v", "n", "sig"), "v"), percent, lanes, bits), "candidates")
    clusters = connected_components(near).select(F.col("id").alias("v"), F.col("component").alias("key"))
    last = _tile_links(_dealt(clusters.join(label.select("v", "n", "c"), "v"), "n", WEIGHT), texts, k, percent)
    last = connected_components(materialise(last, "component-links")).select(F.col("id").alias("c"), F.col("component").alias("to"))
    label = label.select("v", "c").join(last, "c", "left").select("v", F.coalesce("to", "c").alias("c"))

    named = reps.select("v", "id", "digest_a", "digest_b").join(label, "v")
    least = named.groupBy("c").agg(F.min(F.struct("id", "digest_a", "digest_b")).alias("m"))
    named = named.join(least, "c").select("digest_a", "digest_b", F.col("m.id").alias("least"), ((F.col("digest_a") == F.col("m.digest_a")) & (F.col("digest_b") == F.col("m.digest_b"))).alias("first"))
    out = seen.select("id", "n_shingles", "digest_a", "digest_b").join(named, ["digest_a", "digest_b"], "left")
    empty = F.col("n_shingles") == 0
    return out.select("id", "n_shingles", F.when(empty, F.col("id")).otherwise(F.col("least")).alias("component_id"), _hex().alias("digest"), (empty | F.col("first")).alias("first"))
