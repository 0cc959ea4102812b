import json
import time

from pyspark.sql import functions as F

from folioflow.sources import store
from folioflow.streaming import progress


def test_failures_never_fall_and_recovery_clears_reasons():
    s = progress.empty(1)
    for e in ({"kind": "opened", "page_count": 3}, {"kind": "page", "page_number": 1, "failed": True, "detail": "torn"}, {"kind": "page", "page_number": 1, "provenance": "text_layer"}, {"kind": "page", "page_number": 9, "provenance": "text_layer"}, {"kind": "done"}, {"kind": "page", "page_number": 2, "provenance": "text_layer"}):
        s = progress.apply(s, e)
    assert (s["done_pages"], s["failed_pages"], s["marks"], s["reviews"], s["status"]) == (1, 1, {1: "text_layer"}, {}, "done")


def test_stream_ends_like_the_batch(spark, sf, tmp_path):
    events = progress.events_of(spark.read.parquet(f"{sf}/events.parquet")).filter("job_id % 10 = 0")
    want = {r.job_id: (r.done_pages, r.failed_pages, r.marks, r.stage_done) for r in progress.fold(events).collect()}
    for i, part in enumerate((F.col("seq") < 400, F.col("seq") >= 400)):
        events.filter(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if i == 0:
            time.sleep(1.1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(progress.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = progress.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("folded").collect():
        if r.job_id not in last or r.done_pages + r.failed_pages >= last[r.job_id][0] + last[r.job_id][1]:
            last[r.job_id] = (r.done_pages, r.failed_pages, r.marks, r.stage_done)
    assert {k: v[:3] for k, v in last.items()} == {k: v[:3] for k, v in want.items()}


def test_ledger_survives_a_torn_line(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    lines = [json.dumps({"job_id": "a", "file_name": f"{i}.pdf", "page_count": i}) for i in range(3)]
    (path / "l.json").write_text("\n".join([lines[0], '{"job_id": "a", "file', *lines[1:]]) + "\n")
    rows = store.read_ledger(spark, str(path))
    assert sorted(r.file_name for r in rows.collect()) == ["0.pdf", "1.pdf", "2.pdf"]
    assert store.append_ledger(rows.drop("ordinal").limit(1), str(path)) == 1
    assert store.read_ledger(spark, str(path)).count() == 4
    store.rewrite_ledger(store.read_ledger(spark, str(path)).filter("page_count > 0"), str(path))
    assert all(r.page_count > 0 for r in store.read_ledger(spark, str(path)).collect())


def test_csv_has_its_columns(spark, tmp_path):
    rows = spark.createDataFrame([], store.LEDGER)
    store.export_csv(rows.unionByName(spark.createDataFrame([(None,) * 20], rows.schema)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(store.EXPORTED)


def test_paid_readings(spark):
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    cache = spark.createDataFrame([("k1", "x"), ("k2", "")], "key string, answer string")
    got, todo = store.from_cache(asked, cache)
    assert [r.key for r in got.collect()] == ["k1"]
    assert sorted(r.key for r in todo.collect()) == ["k2", "k3"]


def test_ports_default_to_null_and_survive_failures(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "x string")
    assert [r.y for r in store.ask(rows, None, "x", "y").collect()] == [None, None]

    def breaks(_):
        raise RuntimeError

    assert [r.y for r in store.ask(rows, breaks, "x", "y").collect()] == [None, None]


def test_stall_and_watch(spark):
    states = spark.createDataFrame([(1, "running"), (2, "done"), (3, "running")], "job_id long, status string")
    seen = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 95.0)], "job_id long, last_s double")
    assert [r.job_id for r in progress.stalled(states, seen, 100.0, 20.0).collect()] == [1]
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "path string, size long, modified long")
    assert [r.path for r in progress.not_delivered(files, files.filter("path = 'a'")).collect()] == ["b"]
