"""The cull: similarity, clusters, representatives, scores, selection; for one set or for all folders at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CullConfig
from ..functions.scores import blend, clip
from ..functions.vectors import affine
from ..operators import clusters as C
from ..operators.folders import with_targets
from ..operators.numbering import number_rows
from ..operators.ranking import folder_top, ranked_top, top
from ..operators.similarity import similar_links
from ..sources.shared import stored


@dataclass(frozen=True)
class CullResult:
    #: id, root of every item
    rooted: DataFrame
    #: cluster_id, root, size
    clusters: DataFrame
    #: id, aesthetic, composition, final, cluster_id of every representative
    scored: DataFrame
    #: the chosen ones, with rank
    selected: DataFrame


def aesthetic(df: DataFrame, weights: list[float], bias: float, vec_col: str = "embedding", name: str = "score") -> DataFrame:
    """df with the clipped score of a linear model over its vectors."""
    return df.withColumn(name, clip(affine(F.col(vec_col), weights, bias)))


def find_duplicates(items: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", within: str | None = None) -> DataFrame:
    """Items (with vectors) and the root of the component of each."""
    kept = items.where(F.col(vec_col).isNotNull())
    return C.roots(kept, similar_links(kept, threshold, id_col, vec_col, within), id_col)


def representatives(rooted: DataFrame, config: CullConfig, score: Callable[[DataFrame], DataFrame], id_col: str = "vec_id", keep: list[str] | None = None) -> DataFrame:
    """The rows of rooted that stand for their components, with `score`, without vectors: id, root, score and the columns `keep`."""
    if config.representative == "best":
        chosen = C.best_members(rooted, score(rooted).select(id_col, "score"), id_col)
        unique = rooted.join(chosen, (rooted["root"] == chosen["root"]) & (F.col(id_col) == F.col("representative")), "left_semi")
    else:
        unique = rooted.where(F.col(id_col) == F.col("root"))
    return score(unique).select(id_col, "root", "score", *(keep or []))


def candidates(scored: DataFrame, config: CullConfig, id_col: str = "vec_id") -> DataFrame:
    """The best representatives, which a costly model sees."""
    return top(scored, config.llm_candidates, F.coalesce("score", F.lit(0.0)), F.col(id_col))


def finals(scored: DataFrame, composed: DataFrame | None, numbered: DataFrame, config: CullConfig, id_col: str = "vec_id") -> DataFrame:
    """scored with `aesthetic` (for score), `composition`, `final` and `cluster_id`; composed has the id and `composition` of some."""
    if composed is None:
        composition = scored.withColumn("composition", F.lit(None).cast("double"))
    else:
        composition = scored.join(composed.select(id_col, "composition"), id_col, "left")
    final = composition.withColumn("final", blend(F.col("score"), F.col("composition"), config.aesthetic_weight, config.composition_weight))
    return final.join(numbered.select("root", "cluster_id"), "root", "left").withColumnRenamed("score", "aesthetic")


def chosen(named: DataFrame, config: CullConfig, id_col: str = "vec_id") -> DataFrame:
    """The best rows of the final table, with rank."""
    return ranked_top(named, config.target, F.col("final"), F.col(id_col))


def cull(items: DataFrame, config: CullConfig, score: Callable[[DataFrame], DataFrame], composition: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> CullResult:
    """Culls one set.

    `score` adds the column `score`; `composition` gets the best candidates and
    returns their id and `composition`. Both see representatives only, so what is
    costly runs on few rows. Ids are input positions.
    """
    rooted = stored(find_duplicates(items, config.similarity_threshold, id_col, vec_col), "rooted")
    numbered = stored(C.clusters(rooted), "clusters")
    scored = representatives(rooted, config, score, id_col, [c for c in items.columns if c not in (id_col, vec_col)])
    composed = None if composition is None else composition(candidates(scored, config, id_col))
    named = stored(finals(scored, composed, numbered, config, id_col), "scored")
    return CullResult(rooted, numbered, named, chosen(named, config, id_col))


@dataclass(frozen=True)
class FoldersResult:
    #: folder, n, target
    plan: DataFrame
    #: folder, id, aesthetic, composition, final, cluster_id, target and rank (null where it is not chosen) of every representative
    scored: DataFrame

    @property
    def selected(self) -> DataFrame:
        return self.scored.where("rank IS NOT NULL")


def cull_folders(items: DataFrame, config: CullConfig, score: Callable[[DataFrame], DataFrame], folder: str, composition: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "vec_id", vec_col: str = "embedding", path_col: str = "path", folders: DataFrame | None = None) -> FoldersResult:
    """Culls every folder in one job.

    Duplicates never cross folders; a folder's quota follows the number of items directly in it. With the scope "recursive" and a
    column of paths, a folder also chooses among the items of all folders below it, as a run of its own on that folder would; then an item can be
    chosen by several folders. Without paths folders are mere groups and nothing lies below. `composition` gets the best candidates of each folder
    (id and folder among the columns) and returns folder, id and `composition`. `folders` (folder, n) names the folders that have a run of their
    own, all with an item if not told otherwise.
    """
    if folders is None:
        folders = items.groupBy(F.col(folder).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    plan = with_targets(folders, config.ratio, config.least, config.most)
    if config.scope == "recursive" and path_col in items.columns:
        seen = in_scope(items, F.col(path_col), plan, "recursive")
        own = items.withColumnRenamed(path_col, "path").join(seen.withColumnRenamed("folder", "__folder"), "path").drop(folder).withColumnRenamed("__folder", folder)
        # an item counts once in each folder that sees it, so it needs a number of its own there, in input order
        own = number_rows(own, [F.col(folder), F.col(id_col)], "__item")
    else:
        own = items.join(plan.select(F.col("folder").alias(folder)), folder, "left_semi").withColumn("__item", F.col(id_col))
    rooted = stored(find_duplicates(own, config.similarity_threshold, "__item", vec_col, folder), "rooted")
    numbered = stored(C.clusters(rooted), "clusters")
    keep = [c for c in own.columns if c not in ("__item", vec_col, folder)]
    scored = representatives(rooted, config, score, "__item", [F.col(folder).alias("folder"), *keep])
    composed = None
    if composition is not None:
        best = folder_top(scored, "folder", F.lit(config.llm_candidates), config.llm_candidates, F.coalesce("score", F.lit(0.0)), F.col("__item"))
        composed = composition(best).join(scored.select("folder", id_col, "__item"), ["folder", id_col]).select("__item", "composition")
    named = finals(scored, composed, numbered, config, "__item").join(plan.select("folder", "target"), "folder")
    named = stored(named, "scored")
    ranks = folder_top(named.select("folder", "__item", "final", "target"), "folder", F.col("target"), config.most, F.col("final"), F.col("__item")).select("__item", "rank")
    return FoldersResult(plan, named.join(ranks, "__item", "left").withColumnRenamed("__item", "item"))


def in_scope(files: DataFrame, path: Column, folders: DataFrame, scope: str) -> DataFrame:
    """folder and path of the files that a folder's run sees: its own (`direct`), or all below (`recursive`)."""
    from ..functions.paths import ancestors, parent

    own = files.select(path.alias("__path"))
    above = F.array(parent(F.col("__path"))) if scope == "direct" else ancestors(F.col("__path"))
    return own.select(F.col("__path").alias("path"), F.explode(above).alias("folder")).join(folders.select("folder"), "folder")
