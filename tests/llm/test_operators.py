"""Small cases and brute force for the operators over corpora."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, langid, minhash, neighbours, packing, repeats, rules, sharding, siteview, suffix, tokens
from folioflow.llm.graph import connected_components

WORDS = "the of and tion ing ere than with for onto blea stre whan".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", "s1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


EDGES = [None, "", "   ", "one", "é", "a b", "x" * 3000, "a b c " * 4000]


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# rules


def test_rules_count_as_written(spark):
    rng = random.Random(1)
    texts = [*EDGES, *(prose(rng, rng.randrange(3, 200)) + "\n" + prose(rng, 5) for _ in range(40)), "same line\nsame line\n\nother", "!! ## $"]
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = word_list(t)
        g = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {p for j, x in enumerate(g) if g.count(x) > 1 for p in (j, j + 1, j + 2)} if len(g) < 3000 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if word_list(x)]
        assert got[i].n_words == len(w)
        assert got[i].word_chars == sum(map(len, w))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
        assert got[i].n_repeat_words == len(covered)
        assert got[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_rule_ablations(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (16,)], "fail_bits long")
    got = {r.rule: (r.failed, r.only_this, r.kept, r.kept_without) for r in rules.ablations(entries, ("few_words", "repeated_words", "symbols")).collect()}
    assert got == {"few_words": (3, 2, 1, 3), "repeated_words": (1, 0, 1, 1), "symbols": (1, 1, 1, 2)}
    assert rules.ablations(entries.limit(0)).filter("kept > 0").count() == 0


# tokens


def test_suffix_sums_are_exact(spark):
    lengths = [0, 3, 3, 5, 1500, 2000, 2000, 70000]
    sums = tokens.suffix_sums(tokens.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")))
    for r in sums.collect():
        assert r.docs_at_least == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.n_tokens)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
    for r in tokens.at_limits(sums, [1, 4, 2000, 10**6]).collect():
        assert r.truncated_total == sum(min(n, r.context) for n in lengths)
    assert sums.agg(tokens.quantile(sums, 0.5).alias("q")).first().q == 5
    assert tokens.suffix_sums(tokens.length_histogram(sums.select("n_tokens").limit(0))).count() == 0


def test_encoded_lengths(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in tokens.encoded_lengths(table(spark, EDGES), keep=("doc_id",)).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(EDGES)}


# suffix arrays and repeats


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 150))
    raw = rng.integers(97, 99 + seed % 3, n).astype(np.uint8)
    if seed % 4 == 0 and n > 40:
        raw[20:] = raw[: n - 20]
    b = raw.tobytes()
    assert list(suffix.suffix_array(raw, 10**6)[0]) == sorted(range(n), key=lambda i: b[i:])
    sa, rank = suffix.suffix_array(raw, 9)
    lcp = suffix.common_prefixes(raw, sa, rank, 9)
    for r in range(1, n):
        x, y = b[sa[r - 1] :], b[sa[r] :]
        assert lcp[r] == next((k for k in range(min(len(x), len(y), 9)) if x[k] != y[k]), min(len(x), len(y), 9))


def brute_repeats(rows, least):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            first.setdefault(b[p : p + least], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [4_000_000, 3_000])
def test_repeats_equal_brute_force(spark, monkeypatch, block):
    rng = random.Random(block)
    passage, line = prose(rng, 60), "a common line of some words that stands in many documents here"
    texts = [*EDGES, passage, prose(rng, 30) + passage + prose(rng, 10), passage[:200], "é" * 60, "xé" + "é" * 60, passage.replace("the", "teh", 1), line, *(prose(rng, 20) + "\n" + line + "\n" + prose(rng, 20) for _ in range(20)), passage, "ab" * 200, "ab" * 100]
    rows = list(enumerate(texts)) + [(3, "one more row of an id " * 5), (3, "one more row of an id " * 5)]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df, with_text=True)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_repeats(rows, 50)
    assert all("�" not in r.kept_text for r in got.collect())


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(table(spark, [])).count() == 0
    assert [r.n_removed for r in repeats.remove_repeats(table(spark, [None, ""])).collect()] == [0, 0]


class Table:
    """Stands for a DataFrame where only the function that it is mapped by matters."""

    def same(self, *_):
        return self

    select = groupBy = cogroup = same

    def mapInArrow(self, run, _):
        return run

    applyInArrow = mapInArrow


def by(t, column):
    return {k: t.filter(pc.equal(t.column(column), k)) for k in pc.unique(t.column(column)).to_pylist()}


def stages_of_repeats(rows, least, rows_of_a_block, n):
    """The stages of remove_repeats one after another, without Spark."""
    blocks = []
    for a in range(0, len(rows), rows_of_a_block):
        data = [(t or "").encode() if not isinstance(t, bytes) else t for _, t in rows[a : a + rows_of_a_block]]
        blocks.append({"block": len(blocks), "ids": [i for i, _ in rows[a : a + rows_of_a_block]], "ends": np.cumsum([len(d) for d in data]).tolist(), "data": b"".join(data), "rest": [None] * len(data)})
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("data", pa.binary()), ("rest", pa.list_(pa.string()))])
    tables, t = [pa.Table.from_pylist([b], schema) for b in blocks], Table()
    anchors = pa.Table.from_batches([x for b in tables for x in repeats._anchors(t, least, n)(b.select(["block", "ends", "data"]).to_batches())], pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("fps", pa.binary())]))
    shared = [repeats._shared_anchors(t)(g) for g in by(anchors, "bucket").values()]
    shared = by(pa.concat_tables(shared), "block") if shared else {}
    none = pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "fps": pa.array([], pa.binary()), "spread": pa.array([], pa.binary())})
    regions = by(pa.concat_tables([repeats._regions(t, t, least, n, n)(b, shared.get(k, none)) for k, b in enumerate(tables)]), "shard")
    classes = [repeats._classes(t, least, n)(r) for r in regions.values()]
    answers = [repeats._merge_classes(t)(g) for g in (by(pa.concat_tables(classes), "bucket").values() if classes else ())]
    answers = pa.concat_tables(answers) if answers else repeats._ANSWER_SCHEMA.empty_table()
    of_shard = by(answers, "shard")
    gone = [repeats._stretches(t, t, least, n)(r, of_shard.get(k, answers.slice(0, 0))) for k, r in regions.items()]
    nothing = pa.table({"block": pa.array([], pa.int64()), "row": pa.array([], pa.int32()), "start": pa.array([], pa.int64()), "length": pa.array([], pa.int64())})
    gone = by(pa.concat_tables([nothing, *gone]), "block")
    out = pa.concat_tables([repeats._cut(t, t, "long", False)(b, gone.get(k, nothing)) for k, b in enumerate(tables)])
    return sorted(zip(*(out.column(c).to_pylist() for c in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")), strict=True))


@pytest.mark.parametrize("seed", range(24))
def test_stages_of_repeats_equal_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(repeats, "_PIECE", rng.choice([5, 64, 1 << 15]))
    letters = rng.choice(["ab", "abcdefgh", "aé\x00 "])
    pool = ["".join(rng.choices(letters, k=rng.randrange(1, 90))) for _ in range(12)]
    texts = ["".join(rng.choices(pool, k=rng.randrange(0, 6))) for _ in range(40)] + [None, "", *pool, *pool]
    rng.shuffle(texts)
    ids = [rng.randrange(30) for _ in texts] if seed % 3 == 0 else rng.sample(range(-20, 1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    least = rng.choice([8, 20, 50])
    assert stages_of_repeats(rows, least, rng.choice([1, 7, 100]), rng.choice([1, 5])) == brute_repeats(rows, least)


def test_equal_regions_of_a_shard_are_sorted_once(monkeypatch):
    rng, sorted_bytes = random.Random(5), []
    passage = prose(rng, 400)
    monkeypatch.setattr(repeats, "suffix_array", lambda raw, depth: (sorted_bytes.append(len(raw)), suffix.suffix_array(raw, depth))[1])
    rows = [(i, passage) for i in range(12)]
    assert stages_of_repeats(rows, 50, 1, 1) == brute_repeats(rows, 50)
    assert sum(sorted_bytes) < 1.5 * len(passage)


@pytest.mark.parametrize("seed", range(8))
def test_prefixes_of_some_suffixes(seed):
    rng = np.random.default_rng(seed)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    raw[200:] = raw[:200]
    wanted = rng.random(400) < 0.6
    sa, rank = suffix.suffix_array(raw, 9)
    whole, some = suffix.common_prefixes(raw, sa, rank, 9), suffix.common_prefixes(raw, sa, rank, 9, chain=40, wanted=wanted)
    assert (whole == some)[wanted[sa]].all()


def test_numbers_in_a_table():
    rng = np.random.default_rng(1)
    x, table = rng.integers(0, 300, 5000).astype(np.uint64) << np.uint64(20), np.unique(rng.integers(0, 300, 90)).astype(np.uint64) << np.uint64(20)
    assert (repeats._is_in(x, table) == np.isin(x, table)).all()
    assert not repeats._is_in(x, table[:0]).any()


# near duplicates


def shingle_set(t, k):
    w = word_list((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_groups(rows, k, percent):
    sets, up = [shingle_set(t, k) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            up[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows = list(enumerate(EDGES))
    for _ in range(6):
        base = prose(rng, 120).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = "edit" + str(rng.random())
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    rows += [(len(rows), "one"), (len(rows) + 1, "A  b")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    assert [(r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0), (0, 1)]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (2, 2), *((i, i + 1) for i in range(100, 140))], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7} | {i: 100 for i in range(100, 141)}


# sharding


def test_shards_are_exact_and_slots_gapless(spark):
    rows = spark.range(0, 1003, 1, 5).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard_name"))
    got = sharding.shuffle_to_shards(rows, shards=7, seed=3, block_rows=40).collect()
    assert sorted(r.doc_id for r in got) == list(range(1003))
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(len([1 for r in got if r.shard == s])))
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shuffle_to_shards(rows.limit(0), shards=3).count() == 0


def test_matrix_sums_and_law():
    m = sharding.communication_matrix([10, 0, 7], [6, 6, 5], 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7]
    assert m.sum(axis=0).tolist() == [6, 6, 5]
    draws = [sharding.communication_matrix([10, 10], [10, 10], s)[0, 0] for s in range(3000)]
    assert abs(np.mean(draws) - 5) < 0.1
    assert abs(np.var(draws) - 10 * 0.5 * 0.5 * 10 / 19) < 0.15
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(400)]
    assert abs(np.mean(big) - 300_000) < 100
    assert 350 < np.std(big) < 570


def test_light_rows(spark):
    got = [(r["size"], r["text_crc32"]) for r in sharding.light_rows(table(spark, [None, "é"])).orderBy("doc_id").collect()]
    assert got == [(1, 0), (3, zlib.crc32("é".encode()))]


# packing


def test_packing_respects_capacity_and_conflicts(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 60), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice(["x", "y", None, None, None])) for i in range(400)] + [(400, 250, "a", "x"), (401, None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    got = packing.pack(df, capacity=100, shard_units=4000).collect()
    by = {}
    for r in got:
        by.setdefault((r.shard, r.bin), []).append(r)
    kind = {r[0]: r for r in rows}
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert sum(p.length for p in pieces) <= 100
        assert all(a.offset + a.length <= b.offset for a, b in zip(pieces, pieces[1:], strict=False))
        for field in (2, 3):
            seen = [kind[p.doc_id][field] for p in pieces if kind[p.doc_id][field] is not None]
            assert len(seen) == len(set(seen))
    for i, n, *_ in rows:
        own = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert sum(x[1] for x in own) == (n or 0)


def test_best_fit_is_the_tightest_compatible():
    rng = random.Random(2)
    n = np.array([rng.randrange(1, 101) for _ in range(300)])
    sources = [rng.choice("abcdef") for _ in n]
    row, start, size, to, at = packing.pack_shard(n, sources, [None] * len(n), 100)
    left, held = [], []
    for r, s, b in zip(row, size, to, strict=True):
        fits = [(left[k], k) for k in range(len(left)) if left[k] >= s and sources[r] not in held[k] and left[k]]
        if fits:
            assert left[b] == min(fits)[0]
        else:
            assert b == len(left)
            left.append(100)
            held.append(set())
        left[b] -= s
        held[b].add(sources[r])


# decontamination


def test_matches_equal_brute_force(spark):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (12, 20, 33, 4, 1)] + [None, ""]
    leak = items[1].split()
    texts = [*EDGES, prose(rng, 40), prose(rng, 10) + " " + items[0].upper() + " " + prose(rng, 9), items[2], " ".join(leak[:-2]), " ".join(leak[:10] + ["zz"] + leak[11:]), prose(rng, 5) + "\n" + items[3] + " " + prose(rng, 8), items[4]]
    docs, it = table(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.matches(docs, it).collect()}
    want = {}
    for d, t in enumerate(texts):
        w = word_list((t or "").lower())
        for i, u in enumerate(items):
            v = word_list((u or "").lower())
            if not v or not w:
                continue
            k = min(5, len(v))
            g = lambda x: [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]  # noqa: B023, E731
            best = 0
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = g(w[s : s + len(v)]), g(v)
                common = sum(min(a.count(x), b.count(x)) for x in set(a))
                best = max(best, common / (len(a) + len(b) - common) if a else 0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    assert got == want
    assert decontaminate.matches(docs, it.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), it).count() == 0


# language and quality


def test_language(spark):
    docs = spark.createDataFrame([(i, ("el la de que los para con " if i % 2 else "the of and to with for from ") * 8, "es" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.identify(table(spark, ["para que los de la", "with the and of from", *EDGES[:3], "123 456"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["es", "en", "und", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(table(spark, ["text"]), langid.fit(docs.limit(0))).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60) if i % 2 else prose(rng, 30).upper().replace(" ", "!! ") for i in range(60)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(50, None)], "doc_id long, quality int")
    got = neighbours.classify(docs, neighbours.fit(docs, labels)).orderBy("doc_id").collect()
    assert [r.predicted for r in got[50:]] == [i % 2 for i in range(50, 60)]
    model = neighbours.fit(docs, labels)
    assert {round(r.score, 6) for r in neighbours.classify(table(spark, [None, ""]), model).collect()} == {0.5}
    assert neighbours.fit(docs, labels.limit(0)) is None
    assert {r.score for r in neighbours.classify(docs, None).collect()} == {0.5}


# pages


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First\n  para <b>bold</b><p>Second&nbsp;one<br>more<form><input>go</form><ul><li>a<li>b</ul></article>"
    "<aside>Side</aside><section id=comments><p>Nice!</p></section><div class=\"ad\">Buy</div><footer>&copy; x</footer></body>"
)


def test_main_text_of_a_page():
    assert siteview.main_text(PAGE, frozenset()) == "Head & line\nFirst para bold\nSecond one more\na\nb"
    assert siteview.main_text("<p>cut &am", frozenset()) == "cut &am"
    assert siteview.main_text(None, frozenset()) == siteview.main_text("", frozenset()) == ""


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">', '<div id="no-ads">', '<div class="with-menu">', '<form id="page">', '<div role="search"><form>'])
def test_a_name_or_form_around_the_article_condemns_nothing(wrapper):
    page = f"<body>{wrapper}<div class=sidebar>Side</div><article><p>Text <span class=ad>Buy</span> goes on</p></article><div class=related><article>Other</article></div></body>"
    assert siteview.main_text(page, frozenset()) == "Text\ngoes on"
    assert siteview.main_text("<body><div class=related><article>Other</article></div><main><p>Text</p></main></body>", frozenset()) == "Text"


def test_counts_overrule_a_name_or_form(spark):
    rng = random.Random(7)
    text = [prose(rng, 30) for _ in range(400)]
    adverts = [prose(rng, 5) for _ in range(40)]
    # a form around each page's text, a named block around it, and adverts of a pool
    rows = [(0, f"<body><form><p>{x}</p><div>Log in</div></form></body>") for x in text[:60]]
    rows += [(1, f"<body><div class=notice><p>{x}</p></div><div class=ad>{rng.choice(adverts)}</div></body>") for x in text[60:]]
    pages = spark.createDataFrame([(i, f"http://h{h}.example/{i}", page) for i, (h, page) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in siteview.extract(pages).collect()}
    assert [got[i] for i in range(400)] == text


def test_style_tree_finds_repeated_branches(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div class=top>Welcome to us</div><div class=main><p>{prose(rng, 30)}</p></div><div class=tail>{rng.choice(['Call now', 'Write us'])}</div></body>") for i in range(80)] + [(80, None, None), (81, "http://h0.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in siteview.extract(pages).collect()}
    assert len(got) == 82
    for i in range(80):
        assert got[i].text == re.search(r"<p>(.*?)</p>", rows[i][2])[1]
        assert got[i].n_chars == len(got[i].text)
    assert got[80].text == got[81].text == ""
    assert siteview.extract(pages.limit(0)).count() == 0


def test_style_tree_drops_a_hosts_own_text_on_a_path_that_is_text_elsewhere(spark):
    rng = random.Random(6)
    # each host repeats a text of its own where other hosts have their articles
    rows = [(h, f"<body><div><p>We are host {h}</p></div><section><p>{prose(rng, 30)}</p></section></body>") for h in range(4) for _ in range(60)]
    rows += [(h, f"<body><div><p>{prose(rng, 30)}</p></div></body>") for h in range(4, 12) for _ in range(60)]
    # copies with other footers are no reason to drop a host's text
    copies = [prose(rng, 30) for _ in range(12)]
    rows += [(12, f"<body><section><p>{copies[i if i < 12 else 0]}</p></section><footer>{i}</footer></body>") for i in range(90)]
    # few pages with the same text show nothing yet
    rows += [(13, "<body><table><tr><td>Rare</td></tr></table><section><p>" + prose(rng, 30) + "</p></section></body>") for _ in range(3)]
    pages = spark.createDataFrame([(i, f"http://h{h}.example/{i}", page) for i, (h, page) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in siteview.extract(pages).collect()}
    for i, (_, page) in enumerate(rows):
        assert got[i] == "\n".join(x for x in re.findall(r"<(?:p|td)>(.*?)</", page) if not x.startswith("We are"))


# hashes, hot groups and repeated ids


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_long_regular_words_stay_apart(spark):
    a, b = thue_morse(4096, "ab"), thue_morse(4096, "ba")
    assert [r.component_id for r in minhash.near_duplicates(table(spark, [a, b, a])).orderBy("doc_id").collect()] == [0, 1, 0]
    rows = [(0, a), (1, b), (2, "x" + a)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_repeats(rows, 50)


def test_a_large_group_near_but_mostly_under_the_threshold(spark, monkeypatch):
    # each text differs from the base in its own 12 of 160 words: some pairs are linked, most are not, all share bands
    rng = random.Random(21)
    base = prose(rng, 160).split()
    texts = []
    for _ in range(300):
        w = list(base)
        for i in rng.sample(range(160), rng.choice((2, 3, 4, 6))):
            w[i] = f"own{rng.random()}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    monkeypatch.setattr(minhash, "TILE", 64)
    monkeypatch.setattr(minhash, "WEIGHT", 8000)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute_groups(rows, 3, 85)


def test_tile_links_equal_brute_force():
    rng = np.random.default_rng(4)
    for percent in (60, 85):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
        index = minhash._Index(sets)
        for x in range(60):
            got = set(index.linked(sets[x], np.ones(60, bool), percent))
            want = {y for y in range(60) if 100 * len(np.intersect1d(sets[x], sets[y])) >= percent * len(np.union1d(sets[x], sets[y]))}
            assert got == want


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    rng = random.Random(8)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, b), (2, a), (3, b.upper()), (3, None), (1, a)]
    got = sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, True, 1), (1, True, 1), (1, True, 1), (2, True, 1), (3, False, 3), (3, True, 1)]


def test_kept_columns_follow_their_rows(spark):
    rows = [(1, "x" * 60, "en", None), (1, "y" * 60, None, "s2"), (2, "x" * 70, 'a"b', "s3")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, block string"), keep=("lang", "block"), with_text=True)
    assert sorted(((r.doc_id, r.kept_text, r.lang, r.block) for r in got.collect()), key=str) == [(1, "x" * 60, "en", None), (1, "y" * 60, None, "s2"), (2, "", 'a"b', "s3")]


def test_many_more_buckets_than_rows_are_no_loop(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3)
    text = prose(random.Random(3), 40_000)
    rows = [(0, text), (1, text[1000:3000])]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(0, 0), (1, 2000)]


def test_clean_deletes_what_was_written(spark):
    from folioflow.llm import _tables

    x = _tables.materialise(spark.range(3), "x")
    assert x.count() == 3
    assert _tables.clean(spark) > 0
    assert _tables._written == []


# brute force of models and of the tree


def test_language_scores_equal_the_kernel_in_plain_python(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, 8) if i % 2 else prose(rng, 8).replace("e", "o"), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    model = langid.fit(docs, landmarks=4)
    texts = [prose(rng, 6), "Zz 99 é", prose(rng, 3).upper()]
    fold = lambda t: bytes(langid._FOLD[b] for b in t.encode())

    def strings(t):
        shift = 32 - langid.BUCKETS.bit_length() + 1
        x = fold(t)
        return {((int.from_bytes(x[i : i + n], "big") + n * 0x01000193) % 2**32 * 0x9E3779B1 % 2**32) >> shift for n in (1, 2, 3) for i in range(len(x) - n + 1)}

    marks = [set(np.flatnonzero(r).tolist()) for r in np.unpackbits(model.bits, axis=1)]
    got = langid.identify(table(spark, texts), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        s = strings(t)
        f = [sum(len(s & m) / (len(s) * len(m)) ** 0.5 * w for m, w in zip(marks, model.weights[:, c], strict=True)) for c in range(2)]
        assert r.lang_pred == model.languages[int(np.argmax(f))]
        assert abs(r.score - min(1, max(0, (max(f) + 1) / 2))) < 1e-4


def test_votes_equal_a_full_sort(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 4)).astype(np.float32)
    vectors[10:40] = vectors[10]  # ties
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = neighbours.Model(np.ones(neighbours.TERMS, np.float32), rng.normal(size=(neighbours.TERMS, 4)).astype(np.float32), vectors, rng.integers(0, 2, 90).astype(float), 0.5)
    texts = [prose(random.Random(i), 12) for i in range(5)] + [""]
    raw, at = (np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    got = model.score(raw, at, neighbours=25)
    z = model.latent(neighbours.terms(raw, at))
    for i in range(5):
        sim = [float(z[i] @ v) for v in vectors]
        top = sorted(range(90), key=lambda j: (-round(sim[j], 5), j))[:25]
        w = [max(sim[j], 0) + 1e-9 for j in top]
        assert abs(got[i] - sum(a * model.labels[j] for a, j in zip(w, top, strict=True)) / sum(w)) < 1e-4
    assert got[5] == 0.5


def test_learning_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(i % 30, prose(rng, 20), "ab"[i % 2]) for i in range(60)]
    labels = [(i, i % 2) for i in range(30)] + [(4, 1)]
    a, b = (spark.createDataFrame(x, "doc_id long, text string, lang string") for x in (rows, rows[::-1]))
    la, lb = (spark.createDataFrame(x, "doc_id long, quality int") for x in (labels, labels[::-1]))
    assert np.array_equal(langid.fit(a).weights, langid.fit(b).weights)
    m, n = neighbours.fit(a, la), neighbours.fit(b, lb)
    assert np.array_equal(m.vectors, n.vectors)
    assert np.array_equal(m.labels, n.labels)
    assert len(m.labels) == 29


def test_importance_equals_entropies_in_plain_python(spark):
    from collections import Counter
    from math import log

    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<body><div class=a>{rng.choice(['x', 'y', 'z'])}{i % 3}</div><div class=b><p>{prose(rng, 5)}</p></div></body>") for i in range(50)]
    got = {(r.host, r.path): r.importance for r in siteview.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    path, back = "/body/div.a/#", siteview.BACKOFF
    texts = [(u.split("/")[2], re.search("class=a>(.*?)<", h)[1]) for _, u, h in rows]
    entropy = lambda xs: 1 - sum(n * log(n) for n in Counter(xs).values()) / len(xs) / log(len(xs))
    everywhere = Counter(t for _, t in texts)
    general = (50 * entropy([t for _, t in texts]) + back) / (50 + back)
    for host in {h for h, _ in texts}:
        own = [t for h, t in texts if h == host]
        mixed = (len(own) * entropy(own) + back * general) / (len(own) + back)
        rare = 1 - sum(log(everywhere[t]) for t in own) / len(own) / log(50)
        assert abs(got[host, path] - min(mixed, (50 * rare + back) / (50 + back))) < 1e-9
        assert got[host, "/body/div.b/p/#"] == 1


@pytest.mark.parametrize("names", [("k1", "k2", "k3"), ("col left", "zq", "xx-4")])
def test_the_tree_alone_finds_boilerplate_whose_names_say_nothing(spark, names):
    rng = random.Random(14)
    adverts = [prose(rng, 6) for _ in range(12)]
    rows, want = [], []
    for host, n in [(f"one{i}", 1) for i in range(40)] + [(f"five{i}", 5) for i in range(12)] + [("fifty", 50)]:
        slogan = f"Welcome to {host} " + prose(rng, 4)
        for _ in range(n):
            text = prose(rng, 30)
            top = f"<div class='{names[0]}'>{slogan}</div>" if n == 50 else ""
            rows.append((host, f"<body>{top}<div class='{names[1]}'>{rng.choice(adverts)}</div><div class='{names[2]}'><p>{text}</p></div></body>"))
            want.append(text)
    pages = spark.createDataFrame([(i, f"http://{h}.example/{i}", x) for i, (h, x) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in siteview.extract(pages).collect()}
    changed = sum(got[i] != siteview.main_text(x, frozenset()) for i, (_, x) in enumerate(rows))
    assert changed == len(rows)
    assert [got[i] for i in range(len(rows))] == want


def test_no_markup_of_cut_or_unclosed_tags():
    for page, text in [('<p>yo <a href="http://x.y/z', "yo"), ('<p class="x>two</p>', "two"), ('<p class="x>two</p><p class="y">three</p>', "two\nthree"), ('<p title="a>b">q</p>', "q")]:
        assert siteview.main_text(page, frozenset()) == text
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert siteview.main_text(deep, frozenset()) == "deep"


def test_long_items_and_repeated_shingles(spark):
    long = " ".join(["same"] * 300 + ["other"] * 20)
    got = spark.createDataFrame([([5] * 65_535,), ([5] * 70_000,)], "h array<long>").select(decontaminate.simhash("h").alias("s")).collect()
    assert [r.s for r in got] == [5, 5]
    x = spark.createDataFrame([([3, 1, 3, 3, 2, 1],), ([],), ([7],)], "h array<long>").select(decontaminate._as_set("h").alias("a")).collect()
    assert [len(set(r.a)) for r in x] == [6, 0, 1]
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = decontaminate.matches(table(spark, ["a b c " + long, "same " * 40]), items).collect()
    assert [(r.doc_id, r.item_id, r.n_words) for r in got] == [(0, 1, 320)]


def test_style_tree_is_no_single_plan(spark):
    rows = [(i, f"http://h{i % 3}.x/{i}", f"<body><div class=a><p>word {i}</p></div><div class=b>menu</div></body>") for i in range(12)]
    tree = siteview.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string"))
    # the driver's memory grows with the joins and shuffles that are planned at once
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1 and plan.count("Aggregate") <= 2
