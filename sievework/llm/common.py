"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Parquet in the folder that driver and executors share, read back: cuts the lineage, and outlives lost executors.
written = stored


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow with a function that turns a batch into a dict of columns; make() runs once in each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made = each(batch.slice(at, SLICE))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in names], schema=names)

    return df.mapInArrow(run, schema)


#: Rows that a task's Python code works on at once: bounds its memory without a session setting.
SLICE = 512
