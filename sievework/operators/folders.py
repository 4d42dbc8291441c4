"""Folders: counts, quotas and the plan of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.scores import quota


def folder_counts(files: DataFrame, folder: Column, supported: Column | None = None) -> DataFrame:
    """folder and n, its number of supported files; folders without one are left out."""
    n = F.count(F.lit(1)) if supported is None else F.count_if(supported)
    return files.groupBy(folder.alias("folder")).agg(n.alias("n")).where("n > 0")


def ancestor_counts(files: DataFrame, path: Column) -> DataFrame:
    """folder and n_recursive: the files in it and in all folders below."""
    return files.select(F.explode(ancestors(path)).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_recursive"))


def with_targets(counts: DataFrame, ratio: float, least: int, most: int) -> DataFrame:
    """folder, n, target."""
    return counts.withColumn("target", quota(F.col("n"), ratio, least, most))


def with_total(plan: DataFrame) -> DataFrame:
    """The plan and a row TOTAL."""
    total = plan.rollup("folder").agg(F.sum("n").alias("n"), F.sum("target").alias("target"), F.grouping("folder").alias("g"))
    return total.select(F.when(F.col("g") == 1, F.lit("TOTAL")).otherwise(F.col("folder")).alias("folder"), "n", "target")


def outcomes(results: DataFrame, success: str = "success") -> DataFrame:
    """Folders that went well and that failed: ok, failed."""
    return results.agg(F.count_if(F.col(success)).alias("ok"), F.count_if(~F.col(success)).alias("failed"))
