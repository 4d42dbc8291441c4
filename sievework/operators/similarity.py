"""Cosine similarity join.

`tiles` is exact: rows fall into blocks by a hash of their id, each pair of
blocks is one tile, and a tile is one matrix product. The number of blocks
follows the number of rows, folder by folder, so a tile's memory is bounded, the rows of small folders are copied
once whatever the largest folder is, and tiles of a hot
folder spread over tasks like any others. `expression` is the same join as a
SQL expression, for small inputs and for checks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles

#: Rows of a block; a tile holds two blocks and their product.
BLOCK = 2_048
#: Rows of a table (two numbers each) up to which it is sent to all executors.
BROADCAST_ROWS = 500_000


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _tiles(df: DataFrame, id_col: str, vec_col: str, within: str | None, block: int) -> tuple[DataFrame, list[str]]:
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    folder = F.lit(0).alias("folder") if within is None else F.col(within).alias("folder")
    own = rows.select(folder, F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    if within is None:
        own = own.withColumn("n", F.lit(max(1, math.ceil(rows.count() / block))))
    else:
        # only folders of more than a block take part: there are at most rows / block of them
        own = own.where("folder IS NOT NULL")
        large = own.groupBy("folder").count().where(F.col("count") > block).select("folder", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("n"))
        many = large.count()
        if many:
            own = own.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "folder", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        else:
            own = own.withColumn("n", F.lit(1))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("r"), F.greatest(k, F.col("block")).alias("c")))
    return own.select("folder", "id", "v", "block", F.explode(pairs).alias("t")).select("folder", "id", "v", "block", "t.r", "t.c"), ["folder", "r", "c"]


def _close(pdf: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and similarity of the close pairs of a tile, smaller id first."""
    r, c = pdf["r"].iloc[0], pdf["c"].iloc[0]
    left = pdf[pdf["block"] == r]
    right = left if r == c else pdf[pdf["block"] == c]
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b = _unit(left["v"]), _unit(right["v"])
    sims = a @ b.T
    x, y = np.nonzero(sims >= threshold)
    i, j = left["id"].to_numpy()[x], right["id"].to_numpy()[y]
    keep = i < j if r == c else i != j
    s = sims[x, y][keep]
    i, j = i[keep], j[keep]
    return np.minimum(i, j), np.maximum(i, j), s


def similar_pairs(df: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", within: str | None = None, method: str = "tiles", block: int = BLOCK) -> DataFrame:
    """All pairs i < j with cosine at or over the threshold: i, j, sim, and the column `within` when given (pairs never cross it)."""
    if method == "expression":
        return _by_expression(df, threshold, id_col, vec_col, within)
    if method != "tiles":
        raise ValueError("method must be tiles or expression")
    tiles, key = _tiles(df, id_col, vec_col, within, block)
    kind = tiles.schema["folder"].dataType.simpleString()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, s = _close(pdf, threshold)
        return pd.DataFrame({"folder": pd.Series([pdf["folder"].iloc[0]] * len(i), dtype=pdf["folder"].dtype), "i": i, "j": j, "sim": s})

    out = tiles.groupBy(*key).applyInPandas(join, f"folder {kind}, i long, j long, sim double")
    return out.select("i", "j", "sim") if within is None else out.withColumnRenamed("folder", within)


def similar_links(df: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", within: str | None = None, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect what all close pairs connect; each tile returns a star per group, at most one link for a row.

    For components this replaces the list of pairs, which grows with the square of a group.
    """
    from .components import local_roots

    tiles, key = _tiles(df, id_col, vec_col, within, block)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = _close(pdf, threshold)
        ids, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        root = local_roots(len(ids), at[: len(i)], at[len(i) :])
        linked = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"u": ids[linked], "v": ids[root[linked]]})

    return tiles.groupBy(*key).applyInPandas(join, "u long, v long")


def _by_expression(df: DataFrame, threshold: float, id_col: str, vec_col: str, within: str | None) -> DataFrame:
    def side(name: str) -> DataFrame:
        own = [F.col(id_col).cast("long").alias(name), doubles(F.col(vec_col)).alias(f"{name}_v")]
        return df.select(*own, *([F.col(within).alias(f"{name}_w")] if within else []))

    a, b = side("i"), side("j")
    on = F.col("i") < F.col("j")
    if within:
        on = on & (F.col("i_w") == F.col("j_w"))
    sim = cosine(F.col("i_v"), F.col("j_v"))
    out = a.join(b, on).withColumn("sim", sim).where(F.col("sim") >= threshold)
    return out.select(*([F.col("i_w").alias(within)] if within else []), "i", "j", "sim")
