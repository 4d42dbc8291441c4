"""Top lists, ranks, statistics and output names. Ties keep input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .numbering import number_rows


def top(df: DataFrame, n: int, by: Column, tie: Column) -> DataFrame:
    """The n rows with the highest value, the earlier one on ties: a bounded heap in each task, merged."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(by.desc_nulls_last(), tie.asc()).limit(n)


def ranked_top(df: DataFrame, n: int, by: Column, tie: Column) -> DataFrame:
    """The top n with `rank` from 1; the window sees the n chosen rows only."""
    return top(df, n, by, tie).withColumn("rank", F.row_number().over(Window.orderBy(by.desc_nulls_last(), tie.asc())))


def folder_top(df: DataFrame, folder: str, target: Column, most: int, by: Column, tie: Column) -> DataFrame:
    """Of each folder the top rows up to its target, with `rank`.

    `most` bounds every target, so each task keeps that many rows of a folder
    before the shuffle and a hot folder does not meet in one task.
    """
    best = df.withColumn("rank", F.row_number().over(Window.partitionBy(folder).orderBy(by.desc_nulls_last(), tie.asc())))
    return best.where((F.col("rank") <= most)).where(F.col("rank") <= target)


def statistics(df: DataFrame, score: str) -> DataFrame:
    """mean, population std, min, max and interpolated median; nulls for an empty table.

    The median comes from the one or two middle rows of the sorted scores, so no task holds all distinct scores.
    """
    s = F.col(score)
    plain = df.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.count(s).alias("n"))
    placed = number_rows(df.where(s.isNotNull()).select(s.cast("double").alias("s")), [F.col("s")], "at")
    n = placed.count()
    middle = placed.where(F.col("at").isin((n - 1) // 2, n // 2)).agg(F.avg("s").alias("median"), F.lit(n).cast("long").alias("n"))
    return plain.join(F.broadcast(middle), "n").select("mean", "std", "min", "max", "median")


def output_names(ranked: DataFrame, name: Column) -> DataFrame:
    """rank and `output_name`: the rank, padded to the digits of the number of chosen rows, and the file's name."""
    width = F.length(F.count(F.lit(1)).over(Window.partitionBy()).cast("string"))
    return ranked.where("rank IS NOT NULL").withColumn("output_name", paths.rank_name(F.col("rank"), width, name))


def collisions(df: DataFrame, name: Column) -> DataFrame:
    """Names that more than one row would be written to: output_name, n."""
    return df.groupBy(name.alias("output_name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
