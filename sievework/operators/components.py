"""Connected components over a table of links, by alternating star contraction.

Each round rewrites the links: every node points its larger neighbours, then
its smaller ones, at the smallest node it knows, so a component shrinks to a
star around its smallest node in a number of rounds that grows with the
logarithm of its size. The minimum of a neighbourhood is combined before the
shuffle. Where a hub's rows could be more than a task should take, the minima are
written first: then the joins read two plain tables, and a skewed partition is split (adaptive skew join), so one giant
component does not land in one task. Each round is written, so a lost executor
costs part of one round, and what a round has replaced is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, stored


#: Links from which minima are written before they are joined: as many rows (two numbers each) fit one task with ease.
HUB_LINKS = 4_000_000


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b, in one task's memory."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def connected_components(links: DataFrame, write: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """`node`, `component` (its smallest node) for each node of the links, whose two columns hold long ids.

    Links to itself, repeated links and either direction are allowed; a link
    with a null end is ignored. Nodes without links are not in the result.
    """
    x, y = (F.col(f"`{c}`").cast("long") for c in links.columns[:2])
    now = write(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"), (x.isNotNull() & y.isNotNull()).alias("ok")).where("ok and u <> v").select("u", "v").distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        held = [write(low, "minima")] if state[0] >= HUB_LINKS else []
        low = held[0] if held else low
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = write(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        held += [write(low, "minima")] if state[0] >= HUB_LINKS else []
        low = held[-1] if held else low
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        old, now = now, write(small, "links")
        release(old, large, *held)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links, with overwhelming probability."""
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
