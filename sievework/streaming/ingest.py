"""New image files as a stream: each micro-batch is hashed, embedded through the cache, and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import EXTENSIONS, content_hash
from ..infer import Embedder, embed_with_cache
from ..sources.images import supported
from ..sources.shared import exists

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, files_per_batch: int = 1000) -> DataFrame:
    """path, content_hash and content of files as they appear."""
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.where(supported(F.col("path"), extensions)).select("path", content_hash(F.col("content")).alias("content_hash"), "content")


def ingest(files: DataFrame, make: Callable[[], Embedder], cache: str, out: str, checkpoint: str, batch_size: int = 16, once: bool = True) -> StreamingQuery:
    """Appends path, embedding and error to `out`; an image that can't be embedded is a row with an error.

    A batch goes to a folder named by its number and replaces what an earlier
    attempt left there, so a batch that runs twice counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        embed_with_cache(batch, make, cache, batch_size).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """path and embedding of all batches so far; a path that came again has its latest embedding, failed ones have none and are left out."""
    if not exists(spark, out):
        return spark.createDataFrame([], "path string, embedding array<float>")
    rows = spark.read.parquet(out).where("embedding IS NOT NULL")
    return rows.groupBy("path").agg(F.max_by("embedding", "batch").alias("embedding"))
