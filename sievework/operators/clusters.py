"""Duplicate clusters: components of the similarity graph, their numbers, members and representatives.

Items have an id that is also their input position; the earliest member is the
root of a component, and ties go to the earlier item. Tables may carry a folder
column (`within`): then nothing crosses folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .numbering import number_rows


def roots(items: DataFrame, links: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """items with `root`: the smallest id of its component (its own where it has no link)."""
    found = connected_components(links)
    return items.join(found, items[id_col] == found.node, "left").select(*[items[c] for c in items.columns], F.coalesce("component", items[id_col].cast("long")).alias("root"))


def clusters(rooted: DataFrame) -> DataFrame:
    """cluster_id, root and size of the clusters of two members or more, numbered from 0 by their earliest member."""
    many = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return number_rows(many, [F.col("root")], "cluster_id").select("cluster_id", "root", "size")


def members(rooted: DataFrame, numbered: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """cluster_id and id of every member."""
    return rooted.join(numbered, "root").select("cluster_id", id_col)


def member_lists(rooted: DataFrame, numbered: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """cluster_id, representative and the ordered list of members, one row a cluster: for reports and files of a run. `members` has a row a member and no such bound."""
    return members(rooted, numbered, id_col).groupBy("cluster_id").agg(F.min(id_col).alias("representative"), F.array_sort(F.collect_list(id_col)).alias("members"))


def first_members(rooted: DataFrame) -> DataFrame:
    """root and its representative: the earliest member."""
    return rooted.select("root").distinct().withColumn("representative", F.col("root"))


def best_members(rooted: DataFrame, scores: DataFrame, id_col: str = "vec_id", score_col: str = "score") -> DataFrame:
    """root and its representative: the highest score (none counts as 0), the earliest on ties.

    One aggregation of (score, position), combined before the shuffle: a giant
    component costs no task more than its distinct partial results.
    """
    scored = rooted.join(scores.select(id_col, F.col(score_col).alias("__score")), id_col, "left")
    best = F.max(F.struct(F.coalesce("__score", F.lit(0.0)).alias("s"), (-F.col(id_col)).alias("p"), F.col(id_col).alias("id")))
    return scored.groupBy("root").agg(best.alias("b")).select("root", F.col("b.id").alias("representative"))


def duplicates(rooted: DataFrame, numbered: DataFrame, representatives: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """cluster_id and id of the members that do not represent their cluster."""
    return rooted.join(numbered, "root").join(representatives, "root").where(F.col(id_col) != F.col("representative")).select("cluster_id", id_col)


def unique_items(representatives: DataFrame) -> DataFrame:
    """The representatives in input order, with their place from 0: id, ord."""
    return number_rows(representatives.select(F.col("representative").alias("id")), [F.col("id")], "ord")


def cluster_of(items: DataFrame, rooted: DataFrame, numbered: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """items with their cluster_id, null where they are in no cluster."""
    return items.join(members(rooted, numbered, id_col), id_col, "left")
