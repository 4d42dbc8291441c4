"""Embedding cache: content hash -> embedding, in Parquet partitioned by the hash's first two digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import shard_prefix
from ..schema import EMBEDDING_CACHE
from .shared import exists


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; empty where none was written. Of rows with one hash any is as good as another, one is returned."""
    rows = spark.read.schema(EMBEDDING_CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], EMBEDDING_CACHE)
    return rows.dropDuplicates(["content_hash"])


def append_cache(new: DataFrame, path: str) -> None:
    """Adds content_hash and embedding; files with equal contents share an entry."""
    once = new.select("content_hash", "embedding").dropDuplicates(["content_hash"])
    once.withColumn("prefix", shard_prefix(F.col("content_hash"))).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
