"""Removal of repeated byte strings, by suffix arrays of shards and a merge across shards.

A byte goes if it lies in a string of `least` bytes that also starts in a document with a smaller id; strings are judged on the input.

1. Texts are cut once into blocks of about BLOCK_BYTES, written as a table bucketed by block: later joins by block move no text.
2. Winnowed anchors (the least 20-byte gram of every 31 neighbours) are the same in every occurrence of a 50-byte string. Only strings
   whose anchor occurs in two documents can repeat, so a merge of anchor fingerprints tells each block the regions that matter. This
   loses nothing; a false alarm costs time only.
3. Regions are cut at anchors that content chooses. Regions of equal bytes shrink to one in their block. A region goes to a shard by the
   anchor that it was cut at, or else its least, so that copies meet; ones whose anchor is in many blocks are spread by block, so a
   common line or a huge group of copies doesn't fill one shard. In a shard, a region whose bytes a smaller document has goes whole.
4. Each shard sorts the suffixes of its regions (Larsson-Sadakane) and takes common prefixes (Kasai). Neighbours with a common prefix of
   `least` bytes are one class; in a class, only the smallest document keeps its string. Of each class one 63-bit fingerprint goes on,
   and the lists of the shards are merged by binary search among those that two shards have; a shard hears which of its classes start in a smaller document.
5. Removed stretches return to the blocks.

Blobs of packed numbers travel, not a row per place, and a block sends only to the buckets and shards that it has something for. No key
is gathered: a class is one entry for each shard that has it.

Regions are taken as equal by their bytes. The class of a string of `least` bytes is known in other shards by its fingerprint, a
polynomial over random odd letters: two given strings of 128 bytes or fewer share it with probability 2**-29 at most for the most regular
ones (Thue-Morse words and their swaps), 2**-60 or so for others. Longer strings are never compared by a fingerprint.

Ids are integers.

Defined cases: null and empty texts have no bytes; texts shorter than `least` are never cut; rows with equal ids don't cut each other,
and each has its own result; ties in a class within the smallest document all stay; an empty table gives no rows; other columns are read
only where `keep` names them, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._grams import Rolling, window_least
from ._tables import bounded_batches, folder
from ._words import U, mix, utf8
from .suffix import MOST, common_prefixes, suffix_array

BLOCK_BYTES = 4_000_000
#: Bytes of a block that are hashed at once, few enough for a core's cache.
_PIECE = 1 << 15
LEAST = 50
#: A region is cut where an anchor is divisible by this, so that equal stretches become equal regions.
_CUT = 24
_ANCHOR_BYTES, _CLASS_BYTES = 4, 7
_BLOCKS_OF_A_SALT = 16
#: Files that blocks are bucketed into, at most; a file then has several blocks.
MOST_FILES = 4096


def _gram(least: int) -> int:
    return max(4, least * 2 // 5)


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(b: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(-1, width)
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, 8 - width)))).view("<u8").ravel()


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 0 or more in as many bytes each as the largest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _steps(ids: np.ndarray) -> bytes:
    """Ascending ids by their differences; the least one may be negative."""
    return int(ids[0]).to_bytes(8, "little", signed=True) + _pack(np.diff(ids))


def _ids(b: bytes) -> np.ndarray:
    return int.from_bytes(b[:8], "little", signed=True) + np.concatenate([[0], np.cumsum(_unpack(b[8:]))])


def _bucket(fp: np.ndarray, n: int) -> np.ndarray:
    """By the high bits, of which the low ones that travel say nothing."""
    return ((fp >> U(40)) * U(n) >> U(24)).astype(np.int64)


def _low(fp: np.ndarray, width: int) -> np.ndarray:
    return fp & U((1 << (8 * width)) - 1)


def _split(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, its places in their order) for each key that occurs."""
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return [(int(k[a]), order[a:z]) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(k)], strict=False)]


def _is_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether numbers are in a sorted table. Only those whose low bits occur there are searched for."""
    out = np.zeros(len(x), bool)
    if not len(table):
        return out
    low = U((1 << min(24, (16 * len(table)).bit_length())) - 1)
    seen = np.zeros(int(low) + 1, bool)
    seen[(table & low).view(np.int64)] = True
    at = np.flatnonzero(seen[(x & low).view(np.int64)])
    x = x[at]
    out[at] = table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of True."""
    d = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


class _Block:
    """A block's bytes, and the anchor of every string of `least` bytes, as runs of equal anchors along each row."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, least: int):
        k = _gram(least)
        self.raw, self.least = raw, least
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.ends = ends.astype(np.int64)
        begins, fps = [], []
        n, first = len(raw), self.starts[self.starts < self.ends]
        for p in range(0, n - least + 1, _PIECE):
            x = window_least(Rolling(raw[p : p + _PIECE + least - 1]).grams(k), least - k + 1)
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            new[first[np.searchsorted(first, p) : np.searchsorted(first, p + len(x))] - p] = True
            at = np.flatnonzero(new)
            begins.append(at + p)
            fps.append(x[at])
        begin, fp = (np.concatenate(begins), np.concatenate(fps)) if begins else (np.zeros(0, np.int64), np.zeros(0, U))
        # what starts in a row's last bytes is no string of it
        row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(begin, np.append(self.starts, n))))
        last = self.ends[row] - least + 1
        stop = np.minimum(np.append(begin[1:], n), last)
        new = begin < last
        # a run goes on where only a piece ended
        new[1:] &= (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
        use = np.flatnonzero(new)
        self.begin, self.row, self.fp = begin[use], row[use], fp[use]
        self.stop = np.maximum.reduceat(np.where(begin < last, stop, 0), use) if len(use) else use


def make_blocks(df: DataFrame, id: str, text: str, files: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(block, ids, ends, data, rest): rows of df in their order, packed; written bucketed by block. rest: the columns of keep, as JSON."""
    spark = df.sparkSession
    bounded_batches(spark)
    kind = dict(df.dtypes)[id]

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held, size = [], 0

        def out():
            nonlocal held, size, number
            ids = pa.concat_arrays([h[0] for h in held])
            data = b"".join(h[1].tobytes() for h in held)
            ends = np.cumsum(np.concatenate([h[2] for h in held]))
            held_now, held, size, number = held, [], 0, number + 1
            rest = pa.concat_arrays([h[3] for h in held_now])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(ends, pa.int64()), rest)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists[0], lists[1], pa.array([data], pa.binary()), lists[2]], ["block", "ids", "ends", "data", "rest"])

        for b in batches:
            raw, at = utf8(b.column(1))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + max(BLOCK_BYTES - size, 1), "right")) - 1)
                held.append((b.column(0).slice(i, j - i), raw[at[i] : at[j]].copy(), np.diff(at[i : j + 1]), b.column(2).slice(i, j - i)))
                size += int(at[j] - at[i])
                i = j
                if size >= BLOCK_BYTES or sum(len(h[2]) for h in held) >= 50_000:
                    yield out()
        if held:
            yield out()

    schema = f"block long, ids array<{kind}>, ends array<long>, data binary, rest array<string>"
    name = f"blocks_{uuid.uuid4().hex}"
    rest = F.to_json(F.struct(*keep)) if keep else F.lit(None).cast("string")
    packed = df.select(F.col(id).alias("id"), F.col(text).alias("text"), rest.alias("rest")).mapInArrow(run, schema)
    packed.write.option("compression", "zstd").option("path", folder(spark, name)).bucketBy(files, "block").saveAsTable(name)
    out = spark.table(name)
    # its files stay; what was read of the catalog is known from here on
    spark.sql(f"DROP TABLE {name}")
    return out


def _block_of(row: dict, least: int) -> _Block:
    return _Block(np.frombuffer(row["data"], np.uint8), np.asarray(row["ends"], np.int64), least)


def _anchors(blocks: DataFrame, least: int, buckets: int) -> DataFrame:
    """(bucket, block, fps): distinct anchor fingerprints of each block."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                x = np.sort(_block_of(row, least).fp)
                x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
                out = [(k, row["block"], _narrow(_low(x[i], _ANCHOR_BYTES), _ANCHOR_BYTES)) for k, i in _split(_bucket(x, buckets))]
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "block", "fps"), o, strict=True)) for o in out], pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("fps", pa.binary())]))

    return blocks.select("block", "ends", "data").mapInArrow(run, "bucket int, block long, fps binary")


def _shared_anchors(anchors: DataFrame) -> DataFrame:
    """(block, bucket, fps, spread): of each block's anchors those that other blocks have too, and log2 of the number of blocks."""

    def run(table: pa.Table) -> pa.Table:
        lists = [_widen(b, _ANCHOR_BYTES) for b in table.column("fps").to_pylist()]
        x = np.sort(np.concatenate(lists))
        head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        n = np.diff(np.append(head, len(x)))
        x, n = x[head][n > 1], n[n > 1]
        spread = np.ceil(np.log2(np.maximum(n, 1))).astype(np.uint8)
        blobs, counts = [], []
        for y in lists:
            y = y[_is_in(y, x)]
            blobs.append(_narrow(y, _ANCHOR_BYTES))
            counts.append(spread[np.searchsorted(x, y)].tobytes() if len(x) else b"")
        out = pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "fps": pa.array(blobs, pa.binary()), "spread": pa.array(counts, pa.binary())})
        return out.filter(pa.array([len(b) > 0 for b in blobs]))

    return anchors.groupBy("bucket").applyInArrow(run, "block long, bucket int, fps binary, spread binary")


_REGION = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])


def _seal(row: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, known: np.ndarray, data: list[bytes]) -> bytes:
    """Regions of one block and shard, compressed together."""
    parts = [len(row).to_bytes(4, "little"), row.astype("<i4").tobytes(), ids.astype("<i8").tobytes(), start.astype("<i8").tobytes(), size.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), *data]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unseal(table: pa.Table) -> pa.Table:
    """Regions of a shard, from what the blocks sealed."""
    out = []
    for block, blob in zip(table.column("block").to_pylist(), table.column("blob").to_pylist(), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at, cols = int.from_bytes(raw[:4], "little"), 4, []
        for kind in ("<i4", "<i8", "<i8", "<i8", "u1"):
            cols.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        row, ids, start, size, known = cols
        data = []
        for k, z in zip(known.tolist(), size.tolist(), strict=True):
            data.append(None if k else raw[at : at + z])
            at += 0 if k else z
        out.append(pa.table({"block": pa.array([block] * n, pa.int64()), "row": row, "id": ids, "start": start, "length": size, "data": pa.array(data, pa.binary())}, _REGION))
    return pa.concat_tables(out) if out else _REGION.empty_table()


def _regions(blocks: DataFrame, shared: DataFrame, least: int, buckets: int, shards: int) -> DataFrame:
    """(shard, block, blob): regions of strings whose anchors repeat, sealed together. Regions that are known to go have no bytes."""
    schema = "shard int, block long, blob binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            got = [_regions_of(row, right, least, buckets, shards)]
            parts += [g for g in got if g is not None]
        return pa.concat_tables(parts) if parts else _SEALED.empty_table()

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, schema)


def _regions_of(row: dict, shared: pa.Table, least: int, buckets: int, shards: int) -> pa.Table | None:
    b = _block_of(row, least)
    if not len(b.fp):
        return None
    ids = np.asarray(row["ids"])
    # anchors that other blocks have, by (bucket, low bytes)
    low, bucket = _low(b.fp, _ANCHOR_BYTES), _bucket(b.fp, buckets)
    key = (bucket.astype(U) << U(8 * _ANCHOR_BYTES)) | low
    table = np.concatenate([np.zeros(0, U), *((U(k) << U(8 * _ANCHOR_BYTES)) | _widen(f, _ANCHOR_BYTES) for k, f in zip(shared.column("bucket").to_pylist(), shared.column("fps").to_pylist(), strict=True))])
    spread = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(s, np.uint8) for s in shared.column("spread").to_pylist())])
    order = np.argsort(table)
    table, spread = table[order], spread[order]
    found = _is_in(key, table)
    wide = np.where(found, spread[np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))] if len(table) else 0, 0)
    # anchors of two documents of this block
    order = np.argsort(b.fp)
    x, d = b.fp[order], ids[b.row[order]]
    head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    differ = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
    two = np.zeros(len(x), bool)
    two[order] = np.repeat(differ, np.diff(np.append(head, len(x))))
    use = np.flatnonzero(found | two)
    if not len(use):
        return None
    # regions: flagged runs that touch, row by row, up to the next cut
    touch = np.concatenate([[False], (b.begin[use][1:] == b.stop[use][:-1]) & (b.row[use][1:] == b.row[use][:-1])])
    cut = touch & (b.fp[use] % U(_CUT) == 0)
    first = np.flatnonzero(~touch | cut)
    begin, end = b.begin[use][first], b.stop[use][np.append(first[1:], len(use)) - 1] + least - 1
    at = b.row[use][first]
    key = np.where(cut[first], b.fp[use][first], np.minimum.reduceat(b.fp[use], first))
    # how far the anchor by which a region goes is spread
    local = np.zeros(len(first), np.int64)
    where = np.flatnonzero(b.fp[use] == np.repeat(key, np.diff(np.append(first, len(use)))))
    local[np.searchsorted(first, where, "right") - 1] = wide[use][where]
    raw = b.raw.tobytes()
    known, owner = np.zeros(len(first), bool), {}
    for i in np.argsort(ids[at], kind="stable").tolist():
        known[i] = ids[at[i]] > owner.setdefault(raw[begin[i] : end[i]], ids[at[i]])
    size = end - begin
    salt = np.maximum(1, (1 << local) // _BLOCKS_OF_A_SALT).astype(U)
    mixed = mix(key ^ ((U(row["block"] % 2**63) % salt) * U(0xD6E8FEB86659FD93)))
    shard = ((mixed >> U(32)) % U(shards)).astype(np.int32)
    start = begin - b.starts[at]
    out = []
    for k, i in _split(shard):
        out.append((k, row["block"], _seal(at[i], ids[at[i]], start[i], size[i], known[i], [raw[begin[j] : end[j]] for j in i if not known[j]])))
    return pa.Table.from_pylist([dict(zip(_SEALED.names, x, strict=True)) for x in out], _SEALED)


_SEALED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])


class _Shard:
    """Regions of a shard as one text, in the order of (id, block, row, start), with a byte that no text has after each."""

    def __init__(self, table: pa.Table, least: int):
        self.table = table.sort_by([("id", "ascending"), ("block", "ascending"), ("row", "ascending"), ("start", "ascending")])
        self.ids = np.asarray(self.table.column("id").combine_chunks())
        data = self.table.column("data").to_pylist()
        self.raw = np.frombuffer(b"".join(x + b"\xff" for x in data), np.uint8)
        self.size = np.asarray(self.table.column("length").combine_chunks())
        self.begin = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1]
        self.least = least

    def parts(self):
        """(first region, end region) of stretches that fit one suffix array."""
        i, ends = 0, self.begin + self.size + 1
        while i < len(self.size):
            j = max(i + 1, int(np.searchsorted(ends, self.begin[i] + MOST, "right")))
            yield i, j
            i = j

    def places(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts of strings, their region), in text order, of regions i..j."""
        n = self.size[i:j] - self.least + 1
        region = np.repeat(np.arange(i, j), n)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        return self.begin[region] + np.arange(len(region)) - np.repeat(first, n), region

    def stretches(self, gone: np.ndarray, place: np.ndarray, region: np.ndarray) -> list[tuple[int, int, int]]:
        """(region, start in its document, length) of what the strings at the flagged places cover."""
        p, r = place[gone], region[gone]
        if not len(p):
            return []
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] > p[:-1] + self.least)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        start = np.asarray(self.table.column("start").combine_chunks())[r[first]] + p[first] - self.begin[r[first]]
        return list(zip(r[first].tolist(), start.tolist(), (p[last] - p[first] + self.least).tolist(), strict=True))

    def intervals(self, found: list[tuple[int, int, int]]) -> pa.Table:
        r = pa.array([f[0] for f in found], pa.int64())
        t = self.table.select(["block", "row"]).take(r)
        return pa.table({"block": t.column("block"), "row": t.column("row"), "start": pa.array([f[1] for f in found], pa.int64()), "length": pa.array([f[2] for f in found], pa.int64())})


def _long_regions(table: pa.Table, least: int) -> pa.Table:
    """Regions longer than a suffix array holds, cut into overlapping pieces."""
    size = np.asarray(table.column("length").combine_chunks())
    if not len(size) or size.max() < MOST:
        return table
    rows, step = [], MOST - 1 - least
    for x in table.to_pylist():
        for p in range(0, max(1, x["length"] - least + 1), step):
            part = x["data"][p : p + step + least - 1]
            rows.append(x | {"start": x["start"] + p, "length": len(part), "data": part})
    return pa.Table.from_pylist(rows, table.schema)


def _goes(table: pa.Table) -> np.ndarray:
    """Which regions of a shard go whole: those known to, and those whose bytes are a region of a smaller document too."""
    ids, data, owner = table.column("id").to_pylist(), table.column("data").to_pylist(), {}
    out = np.zeros(len(ids), bool)
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        out[i] = data[i] is None or owner.setdefault(data[i], ids[i]) < ids[i]
    return out


def _classes(regions: DataFrame, least: int, buckets: int) -> DataFrame:
    """(bucket, shard, part, ids, counts, fps) of each shard's classes; rows with bucket -1 are stretches known to go (fps null)."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        table = _unseal(table)
        table = table.filter(pa.array(~_goes(table)))
        s = _Shard(_long_regions(table, least), least)
        rows, known = [], []
        for part, (i, j) in enumerate(s.parts()):
            low = int(s.begin[i])
            raw = s.raw[low : int(s.begin[j - 1] + s.size[j - 1] + 1)]
            sa, rank = suffix_array(raw, least)
            place, region = s.places(i, j)
            order = np.full(len(raw), -1, np.int32)
            order[place - low] = np.arange(len(place), dtype=np.int32)
            # where no text has the byte after regions, a suffix that starts no string is like none that does
            plain = np.count_nonzero(raw == 0xFF) == j - i
            lcp = common_prefixes(raw, sa, rank, least, wanted=order >= 0 if plain else None)
            seq = order[sa]  # strings in sorted order, -1 where a suffix starts none
            group = np.cumsum(lcp < least)
            group, seq = group[seq >= 0], seq[seq >= 0]
            if not len(seq):
                continue
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            # strings are in order of id, so a class's first place is in its smallest document
            first = np.minimum.reduceat(seq, at)
            doc = s.ids[region]
            gone = np.zeros(len(place), bool)
            gone[seq] = doc[seq] > np.repeat(doc[first], np.diff(np.append(at, len(seq))))
            known += s.stretches(gone, place, region)
            first = np.sort(first)
            fp = Rolling(raw).at(place[first] - low, least)
            low_fp, doc = _low(fp, _CLASS_BYTES), doc[first]
            for k, at in _split(_bucket(fp, buckets)):
                d = doc[at]
                h = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                rows.append((k, number, part, _steps(d[h]), _pack(np.diff(np.append(h, len(d)))), _narrow(low_fp[at], _CLASS_BYTES)))
        out = pa.Table.from_pylist([dict(zip(_CLASS_SCHEMA.names[:6], r, strict=True)) for r in rows], _CLASS_SCHEMA)
        t = s.intervals(known)
        extra = pa.table({"bucket": pa.array([-1 - number] * len(known), pa.int32()), "shard": pa.array([number] * len(known), pa.int32()), "part": pa.nulls(len(known), pa.int32()), "ids": pa.nulls(len(known), pa.binary()), "counts": pa.nulls(len(known), pa.binary()), "fps": pa.nulls(len(known), pa.binary()), **{n: t.column(n) for n in ("block", "row", "start", "length")}})
        return pa.concat_tables([out, extra])

    return regions.groupBy("shard").applyInArrow(run, _CLASS_DDL)


_CLASS_DDL = "bucket int, shard int, part int, ids binary, counts binary, fps binary, block long, row int, start long, length long"
_CLASS_SCHEMA = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("fps", pa.binary()), ("block", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
_ANSWER_DDL = "shard int, bucket int, part int, fps binary, block long, row int, start long, length long"
_ANSWER_SCHEMA = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("fps", pa.binary()), ("block", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])


def _merge_classes(classes: DataFrame) -> DataFrame:
    """(shard, bucket, part, fps) of classes that start in a smaller document elsewhere; known stretches pass."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(_ANSWER_SCHEMA.names).cast(_ANSWER_SCHEMA)
        lists = [_widen(b, _CLASS_BYTES) for b in table.column("fps").to_pylist()]
        docs = [np.repeat(_ids(i), _unpack(c)) for i, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        merged = np.sort(np.concatenate(lists))
        # a list has a class once, so a class of one list only is settled
        merged = merged[1:][merged[1:] == merged[:-1]]
        merged = merged[np.concatenate([[True], merged[1:] != merged[:-1]])] if len(merged) else merged
        smallest = np.full(len(merged), np.iinfo(np.int64).max)
        held = [np.flatnonzero(_is_in(x, merged)) for x in lists]
        places = [np.searchsorted(merged, x[h]) for x, h in zip(lists, held, strict=True)]
        for p, h, d in zip(places, held, docs, strict=True):
            smallest[p] = np.minimum(smallest[p], d[h])
        rows = []
        for k, (x, p, h, d) in enumerate(zip(lists, places, held, docs, strict=True)):
            lost = x[h[smallest[p] < d[h]]]
            if len(lost):
                rows.append({"shard": table.column("shard")[k].as_py(), "bucket": table.column("bucket")[k].as_py(), "part": table.column("part")[k].as_py(), "fps": _narrow(lost, _CLASS_BYTES)})
        return pa.Table.from_pylist(rows, _ANSWER_SCHEMA)

    return classes.groupBy("bucket").applyInArrow(run, _ANSWER_DDL)


def _stretches(regions: DataFrame, answers: DataFrame, least: int, buckets: int) -> DataFrame:
    """(block, row, start, length) of all that goes."""
    schema = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.filter(pa.array([x is None for x in right.column("fps").to_pylist()], pa.bool_())).select(schema.names).cast(schema)
        left = _unseal(left)
        goes = _goes(left)
        known = pa.concat_tables([known, left.filter(pa.array(goes)).select(schema.names).cast(schema)])
        left = left.filter(pa.array(~goes))
        if not left.num_rows:
            return known
        lost = right.filter(pa.array([x is not None for x in right.column("fps").to_pylist()], pa.bool_()))
        if not lost.num_rows:
            return known
        tables: dict[int, list] = {}
        for part, k, f in zip(*(lost.column(c).to_pylist() for c in ("part", "bucket", "fps")), strict=True):
            tables.setdefault(part, []).append((U(k) << U(8 * _CLASS_BYTES)) ^ _widen(f, _CLASS_BYTES))
        s = _Shard(_long_regions(left, least), least)
        found = []
        for part, (i, j) in enumerate(s.parts()):
            if part not in tables:
                continue
            table, low = np.sort(np.concatenate(tables[part])), int(s.begin[i])
            roll = Rolling(s.raw[low : int(s.begin[j - 1] + s.size[j - 1] + 1)])
            place, region = s.places(i, j)
            for a in range(0, len(place), 1 << 18):
                p, r = place[a : a + (1 << 18)], region[a : a + (1 << 18)]
                fp = roll.at(p - low, least)
                key = (_bucket(fp, buckets).astype(U) << U(8 * _CLASS_BYTES)) ^ _low(fp, _CLASS_BYTES)
                found += s.stretches(_is_in(key, table), p, r)
        return pa.concat_tables([known, s.intervals(found).cast(schema)])

    return regions.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, "block long, row int, start long, length long")


def _cut(blocks: DataFrame, gone: DataFrame, kind: str, with_text: bool) -> DataFrame:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "rest"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cuts: dict[int, list] = {}
        for r, s, n in zip(right.column("row").to_pylist(), right.column("start").to_pylist(), right.column("length").to_pylist(), strict=True):
            cuts.setdefault(r, []).append((s, s + n))
        cols: list[list] = [[] for _ in names]
        for x in left.to_pylist():
            begin = 0
            for r, end in enumerate(x["ends"]):
                body = x["data"][begin:end]
                begin = end
                spans = _union(cuts.get(r, ()))
                kept, text = _without(body, spans), None
                if with_text:
                    whole = [(_forward(body, s), _back(body, e)) for s, e in spans]
                    text = _without(body, [(s, e) for s, e in whole if s < e]).decode()
                for c, v in zip(cols, (x["ids"][r], len(body), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), text, x["rest"][r]), strict=True):
                    c.append(v)
        types = (left.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, rest string")


def _without(body: bytes, spans) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(body[at:s])
        at = e
    return b"".join([*out, body[at:]])


def _union(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _forward(body: bytes, at: int) -> int:
    """The first place from `at` on where a character starts."""
    while at < len(body) and body[at] & 0xC0 == 0x80:
        at += 1
    return at


def _back(body: bytes, at: int) -> int:
    """The last place up to `at` where a character starts, or the end."""
    while 0 < at < len(body) and body[at] & 0xC0 == 0x80:
        at -= 1
    return at


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256; kept_text (only whole characters go) if asked for; the columns of keep."""
    if least < 8:
        raise ValueError("strings of 8 bytes at least")
    kind = dict(df.dtypes)[id]
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    blocks = make_blocks(df, id, text, min(n, MOST_FILES), keep)
    buckets, shards = n, n
    shared = _shared_anchors(_anchors(blocks, least, buckets))
    regions = _regions(blocks, shared, least, buckets, shards)
    gone = _stretches(regions, _merge_classes(_classes(regions, least, buckets)), least, buckets)
    out = _cut(blocks, gone, kind, with_text)
    rest = [f"{c} {dict(df.dtypes)[c]}" for c in keep]
    out = out.withColumn("rest", F.from_json("rest", ", ".join(rest))) if keep else out
    names = [F.col("id").alias(id), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []), *(F.col("rest")[c].alias(c) for c in keep)]
    return out.select(*names)
