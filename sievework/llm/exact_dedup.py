"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters (range partitioning) deal the normalised bytes over the
partitions, an external sort places equal texts next to each other, and a
window compares the whole bytes of neighbours. The sort key leads with a short
prefix of the bytes and their hash, so splitters and samples stay small however
long the texts are; the whole text follows in the sort within a partition.

A text that many rows share would fill one partition. Such texts are counted
first (the counts are combined before the shuffle), their rows carry a salt
in the splitters' key, and the runs of a salted text are joined by totals that
were also combined before the shuffle. At most `4 * shuffle partitions` texts
can be that frequent, so the broadcast tables have a proven bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_width

PREFIX_CHARS = 12
#: A text is frequent with so many rows at least, and with a quarter of a partition's even share.
LEAST_FREQUENT = 256


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """All columns of docs in the struct `row`, with the class of every row.

    Adds `keep_id` (the id of the row that stays), `group_size`, `kept` and
    `text_sha256` (of the normalised text). Texts are equal when identical after
    lower-casing A-Z; null counts as the empty text. `keep` is "max" or "min":
    which id of a class stays. A null id stays only where a class has no other;
    of rows that repeat with the same id exactly one stays; rows equal in id and text
    have the same salt. Very long texts are compared whole. An empty table gives
    an empty result. Other columns travel in `row`, so their names cannot clash.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    spark, parts = docs.sparkSession, shuffle_width(docs.sparkSession)
    best = F.max if keep == "max" else F.min
    norm = ascii_lower(F.col(f"row.{text_col}"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = base.select("row", norm.alias("norm")).withColumn("key", F.xxhash64("norm"))

    total = docs.count()
    often = max(LEAST_FREQUENT, total // (4 * parts))
    hot_keys = keyed.groupBy("key").count().where(F.col("count") >= often).select("key", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(f"row.{id_col}", F.lit(7)), F.lit(parts)).cast("int")).otherwise(0)
    tagged = (
        keyed.join(F.broadcast(hot_keys), "key", "left")
        .select("row", F.coalesce("hot", F.lit(False)).alias("hot"), F.substring("norm", 1, PREFIX_CHARS).alias("prefix"), "key", salt.alias("salt"))
    )
    dealt = tagged.repartitionByRange("prefix", "key", "salt")
    # The text is lower-cased anew rather than shuffled twice.
    whole = dealt.withColumn("norm", norm).withColumn("id", F.col(f"row.{id_col}"))
    same = Window.partitionBy("prefix", "key", "salt", "norm")
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    runs = whole.select(
        "row", "hot", "id",
        F.row_number().over(same.orderBy(order)).alias("place"),
        best("id").over(same).alias("run_id"),
        F.count(F.lit(1)).over(same).alias("run_size"),
        F.sha2("norm", 256).alias("text_sha256"),
    )

    totals = (
        keyed.join(F.broadcast(hot_keys), "key", "left_semi")
        .groupBy(F.sha2("norm", 256).alias("text_sha256"))
        .agg(best(f"row.{id_col}").alias("all_id"), F.count(F.lit(1)).alias("all_size"))
    )
    joined = runs.join(F.broadcast(totals), "text_sha256", "left")
    keep_id = F.when(F.col("hot"), F.col("all_id")).otherwise(F.col("run_id"))
    return joined.select(
        "row",
        keep_id.alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256 (see `classify`)."""
    return classify(docs.select(id_col, text_col), id_col, text_col, keep).select(F.col(f"row.{id_col}").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with the columns of docs, whatever their names (see `classify` for nulls and repeats)."""
    return classify(docs, id_col, text_col, keep).where("kept").select("row.*")
