"""Image files: listings, contents, decoding with errors kept as rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, content_hash, hidden, parent, parts, relative, suffix
from ..operators.folders import folder_counts
from ..operators.numbering import number_rows

FAILED = "Failed to load"
#: Tasks that list folders.
MOST_TASKS = 1_000


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length and content of all files below a folder; unused columns are never read.

    The file index leaves out names that begin with `_` or `.`; `list_files` has them.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def supported(path, extensions: tuple[str, ...] = EXTENSIONS):
    return suffix(path).isin(*extensions)


def local_path(path: str) -> str | None:
    """The path in the file system of this machine, None for another store."""
    scheme, _, rest = path.rpartition("://")
    return "/" + rest.lstrip("/") if scheme == "file" else path if not scheme else None


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, hidden: bool = True) -> DataFrame:
    """path and ord of the supported images below a folder, in path order (letter case of suffixes does not matter).

    Folders and files whose names begin with a dot are listed, too, where the folder lies in a file system that all see (a path
    without a scheme, or file:); another store is listed by Spark's file index, which leaves them out. `hidden=False` leaves them out everywhere.
    """
    own = local_path(folder)
    if own is not None and hidden:
        listed = list_files(spark, own).select("path")
    else:
        listed = read_files(spark, folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return number_rows(listed.where(supported(F.col("path"), extensions)), [parts(F.col("path"))], "ord")


def contents(files: DataFrame) -> DataFrame:
    """files (with `path`) and content and error: each file is read by the executors, one at a time, from the file system that all see.

    A file that can't be read has no content and an error.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, content binary, error string"
    names = [*files.columns, "content", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                try:
                    with open(local_path(row.path) or row.path, "rb") as f:
                        content, error = f.read(), None
                except OSError:
                    content, error = None, FAILED
                yield pd.DataFrame([[*row, content, error]], columns=names)

    return files.mapInPandas(run, schema)


def load_images(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, width, height, channels, data (rows of grey, BGR or BGRA bytes) and error of image files, decoded by Spark's image source.

    It reads what the Java runtime decodes (JPEG, PNG, BMP, GIF); a file that isn't an image has an error and no data. The paths of a list
    are a bounded choice, such as the best candidates.
    """
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(paths)
    good = F.col("image.height") > 0
    fields = [F.when(good, F.col(f"image.{k}")).alias(v) for k, v in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))]
    return rows.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), *fields, F.when(~good, F.lit(FAILED)).alias("error"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of all regular files, hidden ones included, in a folder that the driver sees; listed a top folder to a task."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    tops = [folder, *(e.path for e in os.scandir(folder) if e.is_dir())]
    schema = "path string, size bigint"

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for top in pdf["top"]:
                for d, dirs, files in os.walk(top):  # a folder at a time
                    if top == folder:
                        dirs.clear()
                    paths = [p for p in (os.path.join(d, f) for f in files) if os.path.isfile(p)]
                    yield pd.DataFrame([(p, os.path.getsize(p)) for p in paths], columns=["path", "size"])

    return spark.createDataFrame([(t,) for t in tops], "top string").repartition(min(len(tops), MOST_TASKS)).mapInPandas(walk, schema)


def image_folders(files: DataFrame, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """folder, n and rel_path of the folders with images directly in them, hidden ones left out; the root comes first in `ord`."""
    folder = parent(F.col("path"))
    shown = files.where((folder == root) | ~hidden(folder))
    counts = folder_counts(shown, folder, supported(F.col("path"), extensions))
    labelled = counts.withColumn("rel_path", relative(F.col("folder"), F.lit(root)))
    return number_rows(labelled, [F.col("folder") != root, parts(F.col("folder"))], "ord")


def hashes(files: DataFrame) -> DataFrame:
    """path and content_hash."""
    return files.select("path", content_hash(F.col("content")).alias("content_hash"))


def decode(files: DataFrame, decoder: Callable[[bytes], bytes | None]) -> DataFrame:
    """path, image and error: what the decoder makes of each content, row by row so that no folder is held in memory.

    A decoder that raises or returns nothing gives a null image and an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            images, errors = [], []
            for content in pdf["content"]:
                try:
                    image = decoder(content)
                except Exception:  # noqa: BLE001 - a broken file is a row, not a failed task
                    image = None
                images.append(image)
                errors.append(None if image is not None else FAILED)
            yield pdf[["path"]].assign(image=images, error=errors)

    return files.select("path", "content").mapInPandas(run, "path string, image binary, error string")


def split_errors(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that were decoded, and path and error of the others."""
    return decoded.where("error IS NULL").drop("error"), decoded.where("error IS NOT NULL").select("path", "error")
