"""Shared storage and stable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A folder for an intermediate table, known to clean()."""
    path = f"{shared_dir(spark).rstrip('/')}/folioflow/{name}"
    _written.append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this session has written, once no result that reads them is needed any more; their number."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def materialise(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and rows and partition numbers in it no longer change."""
    spark = df.sparkSession
    path = folder(spark, f"{uuid.uuid4().hex}-{name}")
    writer = df.write.option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with part (its source partition) and rid (a row number without meaning), fixed once and for all. Repeated keys get rids of their own, so no key is hot by rid."""
    return materialise(df.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid")), name)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that many."""
    return df.limit(most_rows + 1).count() <= most_rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches hold fewer rows than by default, as rows here are whole texts. Left alone where it was set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
