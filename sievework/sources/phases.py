"""Phase tables: each phase of a run is a committed table, so a run resumes after the last whole one.

A run is named by its inputs and settings; phases of another run are never taken for
its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import exists, forget

ORDER = ("discovered", "embedded", "rooted", "clusters", "scored", "composed", "final", "selected")


class Phases:
    def __init__(self, spark: SparkSession, folder: str, run_id: str, tell: Callable[[str, int], None] | None = None):
        """`tell` gets the name and the rows of each phase when it is written."""
        self.spark, self.root, self.tell = spark, f"{folder.rstrip('/')}/{run_id}", tell

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def complete(self, name: str) -> bool:
        """Whether the phase was committed; a partly written one does not count."""
        return exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def phase(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The phase's table: read where it is complete, else built, written and read back. Nothing is built for a complete phase."""
        if not self.complete(name):
            seen = Observation(name)
            build().observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(self.path(name))
            if self.tell:
                self.tell(name, seen.get["rows"])
        return self.table(name)

    def summary(self, names: tuple[str, ...] = ORDER) -> DataFrame:
        """phase, complete, n."""
        rows = [(n, self.complete(n), self.table(n).count() if self.complete(n) else 0) for n in names]
        return self.spark.createDataFrame(rows, "phase string, complete boolean, n bigint").withColumn("run_at", F.current_timestamp())

    def delete(self) -> None:
        forget(self.spark, self.root)
