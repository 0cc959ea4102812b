"""The pipeline on a small corpus, stage by stage."""

import random

import corpus_pipeline as cp

WORDS = "the of and tion ing ere than with for onto blea stre whan kert lomi".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_stages_keep_clean_documents_and_catch_planted_ones(spark, tmp_path):
    rng = random.Random(11)
    clean = [prose(rng, rng.randrange(60, 200)) for _ in range(25)]
    passage, item = prose(rng, 70), prose(rng, 30)
    near = clean[3].split()
    near[20] = "edited"
    planted = {
        "short": "too short",
        "shout": " ".join(w.upper() + "!!" for w in clean[0].split()),
        "copy": clean[1],
        "near": " ".join(near),
        "first": prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 50),
        "again": prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 40),
        "leak": prose(rng, 60) + "\n" + item + "\n" + prose(rng, 60),
        "null": None,
    }
    texts = clean + list(planted.values())
    at = {name: len(clean) + i for i, name in enumerate(planted)}
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert set(docs.columns) == set(cp.COLUMNS), name
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(docs)
    ids = [sorted(r.doc_id for r in d.collect()) for d in seen[:4]]
    everyone = set(range(len(texts)))
    assert set(ids[0]) == everyone - {at["short"], at["shout"], at["null"]}
    assert ids[1] == sorted(set(ids[0]) - {at["copy"], at["near"]})
    assert ids[2] == ids[1]
    cut = {r.doc_id: r for r in seen[2].collect()}
    assert passage in cut[at["first"]].text
    assert passage not in cut[at["again"]].text
    assert all(cut[i].text == texts[i] for i in range(25))
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert set(ids[3]) == set(ids[2]) - {at["leak"]}
    pieces = seen[4].collect()
    assert {r.doc_id for r in pieces} == set(ids[3])
    for i in ids[3]:
        assert sum(r.length for r in pieces if r.doc_id == i) == len(cut[i].text.encode())


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_each_stage_on_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    long, a, b = prose(rng, 160_000), prose(rng, 90), prose(rng, 90)
    rows = [(1, a, "en", "s", 5), (1, b, "en", "s", 5), (1, a, "en", "s", 5), (None, prose(rng, 70), None, None, None), (2, None, None, None, None), (3, "", "en", None, 0), (4, long, "en", "s", 9), (5, b, "fr", "t", 1)]
    names = ("part", "rid", "id", "c", "v", "key", "block", "row", "gone", "n")
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    stages = dict(cp.STAGES)
    kept = sorted((r.doc_id or 0, len(r.text)) for r in stages["quality rules"](spark, docs, str(tmp_path)).collect())
    assert kept == sorted((r[0] or 0, len(r[1])) for r in rows if r[1])
    near = stages["near duplicates"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == sorted([(0, rows[3][1]), (1, a), (1, b), (2, ""), (3, ""), (4, long)])
    cut = stages["repeated strings"](spark, docs, str(tmp_path)).collect()
    assert [r.text for r in cut if r.doc_id is None] == [rows[3][1]]
    assert sorted((r.doc_id, r.lang, len(r.text or "")) for r in cut if r.doc_id in (1, 4)) == sorted([(1, "en", len(a)), (1, "en", len(b)), (1, "en", len(a)), (4, "en", len(long))])
    assert 5 not in {r.doc_id for r in cut}
    assert stages["benchmark leaks"](spark, docs, str(tmp_path)).count() == len(rows)
    pieces = stages["best-fit packing"](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.doc_id == 4) == len(long)
