"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where driver and executors are one process may the session name none; a local one is made then."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(forget, spark, named)
    return named.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a path; a stopped session leaves it to the cluster's clean-up."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored(df: DataFrame, tag: str, group_rows: int | None = None) -> DataFrame:
    """Cuts the lineage: Parquet in the shared folder, read back; it outlives lost executors.

    group_rows: rows of a row group at most, for rows so large that a reader can't hold as many as Parquet puts in a page and a group.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    atexit.register(forget, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables whose last reader has been written; others are left alone."""
    for df in tables:
        path = getattr(df, "_stored", None)
        if path:
            forget(df.sparkSession, path)
