"""The state of a run as a JSON file, read into tables and written from phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..schema import STATE
from .phases import Phases
from .shared import exists


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The state as one row; None where there is no file or it holds no such object."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(STATE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("source_dir IS NOT NULL")
    return rows if rows.count() == 1 else None


def state_tables(state: DataFrame) -> dict[str, DataFrame]:
    """What a state lists, as tables: discovered, embedded, failed and unique (path, ord), clusters, aesthetic and composition (path, score)."""
    lists = {"discovered": "discovered_images", "embedded": "embeddings_complete", "failed": "embeddings_failed", "unique": "unique_images"}
    out = {name: state.select(F.posexplode(column)).select(F.col("col").alias("path"), F.col("pos").cast("long").alias("ord")) for name, column in lists.items()}
    out["clusters"] = state.select(F.inline("duplicate_clusters"))
    for name in ("aesthetic", "composition"):
        out[name] = state.select(F.explode(f"{name}_scores").alias("path", "score"))
    return out


def write_state(phases: Phases, source: str, output: str, path: str) -> None:
    """The committed phases as one JSON object in the folder `path`. It is a single row with every path, so it suits runs whose lists fit a row; the phase tables have no such bound."""
    spark = phases.spark
    kinds = {f.name: f.dataType for f in _parse_datatype_string(STATE)}
    done = {name: phases.complete(name) for name in ("discovered", "embedded", "rooted", "clusters", "scored", "composed", "selected")}
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    row = spark.range(1).select(F.lit(source).alias("source_dir"), F.lit(output).alias("output_dir"), now.alias("started_at"), now.alias("updated_at"))

    def ordered(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias(name))

    parts = []
    if done["discovered"]:
        parts.append(ordered(phases.table("discovered").withColumnRenamed("ord", "n"), "discovered_images"))
    if done["embedded"]:
        found = phases.table("embedded").withColumnRenamed("vec_id", "n")
        parts += [ordered(found.where("error IS NULL"), "embeddings_complete"), ordered(found.where("error IS NOT NULL"), "embeddings_failed")]
    if done["scored"]:
        best = phases.table("scored").withColumnRenamed("vec_id", "n")
        parts.append(ordered(best, "unique_images"))
        parts.append(best.where("score IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("path", "score"))).alias("aesthetic_scores")))
    if done["clusters"]:
        member = phases.table("rooted").join(phases.table("clusters"), "root").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "path"))).alias("m"))
        parts.append(member.agg(F.array_sort(F.collect_list(F.struct("cluster_id", F.col("m")[0]["path"].alias("representative"), F.transform("m", lambda x: x["path"]).alias("members")))).alias("duplicate_clusters")))
    if done["composed"]:
        parts.append(phases.table("composed").agg(F.map_from_entries(F.collect_list(F.struct("path", "composition"))).alias("composition_scores")))
    for part in parts:
        row = row.unionByName(part, allowMissingColumns=True)
    row = row.agg(*[F.first(c, ignorenulls=True).alias(c) for c in row.columns])
    flags = {"discovery_complete": "discovered", "embeddings_phase_complete": "embedded", "dedup_complete": "clusters", "aesthetic_complete": "scored", "composition_complete": "composed", "selection_complete": "selected"}
    row = row.withColumns({k: F.lit(done[v]) for k, v in flags.items()})
    empty = {k: F.create_map().cast(t) if t.typeName() == "map" else F.array().cast(t) for k, t in kinds.items() if k not in row.columns}
    row.withColumns(empty).select(*[F.col(k).cast(t) for k, t in kinds.items()]).coalesce(1).write.mode("overwrite").json(path)
