"""Whole runs from a folder of images to copies and a report, in committed phases.

What a phase needs is built only when the phase is not there yet, so a run that
ended half-way calls no model again for what it has finished. Models are factories that
run on the executors (see `infer`); a run without an embedder takes a table of embeddings.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import infer
from ..config import CullConfig
from ..functions import paths as P
from ..functions.vectors import fold_layers
from ..operators import clusters as C
from ..operators.folders import with_targets, with_total
from ..operators.ranking import output_names
from ..operators.report import copy_ranked, write_folder_reports, write_report_file
from ..sources import images as I
from ..sources.phases import Phases
from ..sources.pixels import has_jpeg, readable
from . import cull as K

#: Candidates up to which their paths are handed to Spark's image source one by one; beyond, it reads the folder.
LISTED = 10_000


@dataclass(frozen=True)
class Models:
    """What a run asks about images; `name` tells apart runs whose models differ."""

    embedder: Callable[[], infer.Embedder] | None = None
    analyzer: Callable[[], infer.Analyzer] | None = None
    #: weights and bias of the linear score of an embedding
    weights: tuple[tuple[float, ...], float] | None = None
    name: str = ""

    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.weights, self.name, self.embedder is None, self.analyzer is None]).encode()).hexdigest()[:16]


def read_weights(path: str) -> tuple[tuple[float, ...], float]:
    """Weights and bias from JSON: either these two, or `layers`, a list of (matrix, bias) of a chain of linear layers."""
    with open(path) as f:
        model = json.load(f)
    weights, bias = fold_layers(model["layers"]) if "layers" in model else (model["weights"], model["bias"])
    return tuple(map(float, weights)), float(bias)


class NoImages(ValueError):
    """There is nothing to choose from."""


class _Run:
    """`cache` is the folder of the embedding cache and the phases, IMAGES/.cache if not told otherwise."""

    def __init__(self, spark: SparkSession, source: str, output: str, config: CullConfig, models: Models, cache: str | None = None, embeddings: str | None = None, resume: bool = False, tell: Callable[[str, int], None] | None = None):
        if models.embedder is None and embeddings is None:
            raise ValueError("a run needs an embedder or a table of embeddings")
        if not os.path.isdir(source):
            raise NotADirectoryError(source)
        self.spark, self.source, self.output = spark, os.path.abspath(source), os.path.abspath(output)
        self.config, self.models, self.embeddings = config, models, embeddings
        # kept between sessions, so that a run resumes in another process; all executors see it as they see the images
        kept = (cache or f"file://{self.source}/.cache").rstrip("/")
        self.cache = f"{kept}/embeddings"
        self.phases = Phases(spark, f"{kept}/phases", config.run_id(type(self).__name__, self.source, str(embeddings), models.key()), tell)
        if not resume:
            self.phases.delete()

    def score(self, df: DataFrame) -> DataFrame:
        if self.models.weights is None:
            return df.withColumn("score", F.lit(None).cast("double"))
        return K.aesthetic(df, *self.models.weights)

    def embedded(self) -> DataFrame:
        """vec_id, path, embedding and error of every image; images without an embedding stay as rows with an error."""
        found = self.phases.phase("discovered", lambda: I.discover(self.spark, self.source, readable(P.EXTENSIONS)))
        if found.isEmpty():
            raise NoImages(f"no images in {self.source}")
        return self.phases.phase("embedded", lambda: self._embed(found))

    def _embed(self, found: DataFrame) -> DataFrame:
        if self.models.embedder is None:
            known = self.spark.read.parquet(self.embeddings).select("path", "embedding")
            rows = found.join(known, "path", "left").withColumn("error", F.when(F.col("embedding").isNull(), F.lit(infer.EMBED_FAILED)))
        else:
            read = I.contents(found.select("path")).withColumn("content_hash", I.content_hash(F.col("content")))
            rows = found.join(infer.embed_with_cache(read, self.models.embedder, self.cache, self.config.batch_size), "path")
        return rows.select(F.col("ord").alias("vec_id"), "path", "embedding", "error")

    def failures(self) -> DataFrame:
        """path and error of the images that could not be read or embedded."""
        return self.embedded().where("error IS NOT NULL").select("path", "error")

    def compose(self, best: DataFrame, bound: int) -> DataFrame:
        """path and composition of candidates, at most `bound` of them; each image is loaded, shrunk, encoded and asked about.

        Images in hidden folders are not seen by Spark's image source; they get the default score, as broken ones do.
        """
        files = best.select("path").distinct()
        if bound <= LISTED:
            # the names of a list are patterns to the file index
            listed = [f"file://{_literal(r.path)}" for r in files.collect()]
            pictures = I.load_images(self.spark, listed) if listed else I.load_images(self.spark, self.source).limit(0)
        else:
            pictures = I.load_images(self.spark, f"file://{self.source}").join(files, "path", "left_semi")
        sent = files.join(infer.encoded(pictures), "path", "left")
        return infer.analyze(sent, self.models.analyzer, self.config.request_concurrency, self.config.request_delay).withColumnRenamed("score", "composition")


def _literal(path: str) -> str:
    return "".join(f"\\{c}" if c in "\\{}[]*?" else c for c in path)


class CullRun(_Run):
    """Culls one folder with all below it."""

    def run(self, use_llm: bool = False, analyze_only: bool = False) -> int:
        """Copies the chosen images under their ranked names and writes report.csv; returns the number of copies that failed."""
        config, phase = self.config, self.phases.phase
        items = self.embedded().where("error IS NULL").drop("error")
        rooted = phase("rooted", lambda: K.find_duplicates(items, config.similarity_threshold))
        clusters = phase("clusters", lambda: C.clusters(rooted))
        scored = phase("scored", lambda: K.representatives(rooted, config, self.score, keep=["path"]))
        composed = None
        if use_llm:

            def build() -> DataFrame:
                best = K.candidates(scored, config).select("vec_id", "path")
                return best.join(self.compose(best, config.llm_candidates), "path").select("vec_id", "path", "composition")

            composed = phase("composed", build)
        final = phase("final", lambda: K.finals(scored, composed, clusters, config))
        chosen = phase("selected", lambda: K.chosen(final, config))
        os.makedirs(self.output, exist_ok=True)
        named = output_names(chosen, P.basename(F.col("path")))
        failed = 0 if analyze_only else copy_ranked(named, self.output).where("error IS NOT NULL").count()
        rows = final.join(chosen.select("vec_id", "rank"), "vec_id", "left")
        write_report_file(_reported(rows), os.path.join(self.output, "report.csv"), [F.col("final_score").desc(), F.col("vec_id")])
        if not failed:
            self.phases.delete()
        return failed


class BatchRun(_Run):
    """Culls every folder that has images directly in it, with a quota of its own, in one job."""

    def plan(self) -> DataFrame:
        """folder, n, rel_path, ord and target of the folders; hidden ones have no run of their own."""
        found = self.phases.phase("discovered", lambda: I.discover(self.spark, self.source, readable(P.EXTENSIONS)))
        folders = I.image_folders(found.select("path"), self.source)
        if folders.isEmpty():
            raise NoImages(f"no folders with images in {self.source}")
        return with_targets(folders, self.config.ratio, self.config.least, self.config.most)

    def printed(self) -> DataFrame:
        """rel_path, n and target in order, and the row TOTAL at the end."""
        plan = self.plan().select("ord", "rel_path", "n", "target")
        total = with_total(plan.select(F.col("rel_path").alias("folder"), "n", "target")).where("folder = 'TOTAL'")
        rows = plan.unionByName(total.select(F.lit(None).cast("long").alias("ord"), F.col("folder").alias("rel_path"), "n", "target"))
        return rows.orderBy(F.col("ord").asc_nulls_last()).drop("ord")

    def run(self, use_llm: bool = False, flat: bool = False) -> DataFrame:
        """folder, chosen, failed and success of every folder; copies and reports are written.

        A folder goes well if all its copies and its report are there.
        """
        config = self.config
        plan = self.plan()
        items = self.embedded().where("error IS NULL").drop("error").withColumn("folder", P.parent(F.col("path")))

        def composition(best: DataFrame) -> DataFrame:
            return best.select("folder", "vec_id", "path").join(self.compose(best, LISTED + 1 if has_jpeg() else config.llm_candidates * plan.count()), "path").select("folder", "vec_id", "composition")

        scored = self.phases.phase("scored", lambda: K.cull_folders(items, config, self.score, "folder", composition if use_llm else None, folders=plan.select("folder", "n")).scored)
        rel = F.when(F.col("folder") == self.source, F.lit("")).otherwise(P.relative(F.col("folder"), F.lit(self.source)))
        placed = scored.withColumn("place", F.lit("") if flat else rel)
        width = F.length(F.col("target").cast("string"))
        named = placed.where("rank IS NOT NULL").withColumn("output_name", F.ltrim(F.concat("place", F.lit("/"), P.rank_name(F.col("rank"), width, P.basename(F.col("path")))), F.lit("/")))
        copied = self.phases.phase("copied", lambda: copy_ranked(named, self.output, keep=["folder"]))
        rows = _reported(placed).withColumn("folder", F.lit(self.source) if flat else F.col("folder"))
        reports = self.phases.phase("reports", lambda: write_folder_reports(rows, "folder", "place", self.output, [F.col("final_score").desc(), F.col("item")]))
        each = copied.groupBy("folder").agg(F.count(F.lit(1)).alias("chosen"), F.count("error").alias("failed"))
        written = reports.where("error IS NULL").select("folder", F.lit(True).alias("written"))
        out = plan.select("ord", "folder", "rel_path").join(each, "folder", "left").join(written, "folder", "left")
        ok = (F.coalesce("failed", F.lit(0)) == 0) & (F.lit(True) if flat else F.coalesce("written", F.lit(False)))
        return out.select("ord", "folder", "rel_path", F.coalesce("chosen", F.lit(0)).alias("chosen"), F.coalesce("failed", F.lit(0)).alias("failed"), ok.alias("success")).orderBy("ord").drop("ord")


def _reported(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("aesthetic").alias("aesthetic_score"), F.col("composition").alias("composition_score"), F.col("final").alias("final_score"), F.col("rank").isNotNull().alias("selected"))
