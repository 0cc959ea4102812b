"""Sources and sinks: the ledger as JSON lines, CSV export, receipts, folders of files, the register of people, paid readings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LEDGER = (
    "recorded_at STRING, source_document STRING, code STRING, title STRING, type STRING, nic STRING, fecha STRING, file_name STRING, page_count LONG, first_page LONG, last_page LONG, pages STRING, "
    "job_id STRING, operator STRING, source_pages LONG, source_bytes LONG, review LONG, kind STRING, origen STRING, origen_ruta STRING"
)
EXPORTED = ("recorded_at", "source_document", "code", "title", "type", "file_name", "page_count", "pages", "job_id", "operator")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the ledger with `ordinal`, greater for later ones; a torn line costs itself only."""
    raw = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"), F.monotonically_increasing_id().alias("line")).alias("ordinal"))
    read = F.from_json("value", LEDGER + ", _torn STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"})
    return raw.filter("trim(value) <> ''").select(read.alias("r"), "ordinal").filter("r._torn IS NULL").select("r.*", "ordinal").drop("_torn")


def append_ledger(rows: DataFrame, path: str) -> int:
    """Add rows; returns how many."""
    n = rows.count()
    rows.write.mode("append").json(path)
    return n


def rewrite_ledger(rows: DataFrame, path: str) -> None:
    """Replace the ledger by rows read from it: written beside it first, then swapped in by renames.

    The old ledger is kept aside until the new one is in its place, and comes back where that fails; a stop in between leaves it at
    path.old, from where recover_ledger() takes it.
    """
    spark, base = rows.sparkSession, path.rstrip("/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (base + ".part", base, base + ".old"))
    rows.drop("ordinal").write.mode("overwrite").json(base + ".part")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, target):
        fs.rename(old, target)
        raise OSError(f"cannot put the new ledger at {path}")
    fs.delete(old, True)


def recover_ledger(spark: SparkSession, path: str) -> bool:
    """Puts a ledger back that a stopped rewrite_ledger() left aside; whether there was one."""
    base = path.rstrip("/")
    target, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (base, base + ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(not fs.exists(target) and fs.exists(old) and fs.rename(old, target))


def export_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = EXPORTED) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def relational(ledger: DataFrame, known_jobs: DataFrame | None = None) -> dict[str, DataFrame]:
    """operador, documento and resolucion tables of a ledger, without jobs already known."""
    rows = ledger.filter("job_id IS NOT NULL AND cast(job_id AS string) <> ''")
    if known_jobs is not None:
        rows = rows.join(known_jobs.select("job_id").distinct(), "job_id", "left_anti")
    docs = rows.groupBy("job_id").agg(F.max("source_document").alias("source_document"), F.max("operator").alias("operator"), F.min("recorded_at").alias("recorded_at"), F.max("source_pages").alias("source_pages"), F.count("*").alias("n_units"))
    units = rows.select("job_id", "code", "title", "type", "file_name", "page_count", "first_page", "last_page", "pages").dropDuplicates(["job_id", "file_name"])
    return {"operador": rows.filter("operator IS NOT NULL").select("operator").distinct(), "documento": docs, "resolucion": units}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those of new whose key it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A relational table in parts by a numeric key; filters and columns are pushed to the server."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def list_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, modified) of files below root, contents not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def in_path_order(files: DataFrame) -> DataFrame:
    return files.withColumn("depth", F.size(F.split("path", "/"))).orderBy("depth", "path")


RECEIPT = "origen STRING, tamano LONG, modificado_ns LONG, estado STRING, archivos ARRAY<STRUCT<ruta: STRING, bytes: LONG>>, proceso STRUCT<paginas: LONG, paginas_pagadas: LONG, duracion: STRING>, indice STRUCT<filas: ARRAY<MAP<STRING, STRING>>>, evidencia MAP<STRING, MAP<STRING, STRUCT<estado: STRING, metodo: STRING, valor: STRING, lectores: ARRAY<STRING>>>>, revision ARRAY<MAP<STRING, STRING>>"


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECEIPT + ", _torn STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_torn").json(path).filter("_torn IS NULL").drop("_torn")


def findings(receipts: DataFrame) -> DataFrame:
    """(origen, sheet, parameter, state, method) of the evidence in receipts."""
    return receipts.select("origen", F.explode("evidencia").alias("sheet", "e")).select("origen", "sheet", F.explode("e").alias("parameter", "f")).select("origen", "sheet", "parameter", F.col("f.estado").alias("state"), F.col("f.metodo").alias("method"))


def add_people(register: DataFrame, people: DataFrame) -> DataFrame:
    return insert_new(register, people, ["person_id", "name"])


def reading_key(*parts: Column) -> Column:
    """The key of a paid reading: a hash of all that was asked."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def from_cache(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, still to ask) by key; empty answers were never kept."""
    kept = cache.filter("answer IS NOT NULL AND answer <> ''").dropDuplicates(["key"])
    return asked.join(kept, "key"), asked.join(kept.select("key"), "key", "left_anti")


def as_json(rows: DataFrame, by: str) -> DataFrame:
    """(by, json): an inventory of each document as one JSON text."""
    others = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*others)))).alias("json"))


def official_row(units: DataFrame, today: Column) -> DataFrame:
    """The official inventory's columns as text, N/A where there is nothing."""
    na = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("N/A"))
    w = Window.partitionBy("job_id").orderBy("first_page")
    return units.select("job_id", F.row_number().over(w).cast("long").alias("numero"), *[na(c).alias(c) for c in ("code", "title", "type", "pages")], F.date_format(today, "dd/MM/yyyy").alias("fecha_de_registro"))


def ask(rows: DataFrame, port: Callable[[list], list] | None, input: str, output: str, batch: int = 12) -> DataFrame:
    """An external reader or judge over one column, so many at a time. Without one every answer is null; a failed call costs its own answers."""
    if port is None:
        return rows.withColumn(output, F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: list = []
            for i in range(0, len(f), batch):
                part = f[input].iloc[i : i + batch].tolist()
                try:
                    answer = list(port(part))
                except Exception:  # noqa: BLE001  an answer that fails is none
                    answer = []
                got += (answer + [None] * len(part))[: len(part)]
            yield f.assign(**{output: got})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(output, StringType())]))
