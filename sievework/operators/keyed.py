"""Set operations by key: cache hits and misses, merges, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame


def hits(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_semi")


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the new one wins."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def remaining(discovered: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Keys that are neither done nor failed."""
    return discovered.select(key).subtract(done.select(key)).subtract(failed.select(key))
