"""Registered queries of sources, sinks, model calls and runs over the driver's tables, and the same results in SQL.

Models are stand-ins whose answers SQL can state; everything around them (batches, failures, caches, phases, files) is what a
run uses. `documents` stands for files, `embeddings` for embedded images.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import infer
from ..functions import paths as P
from ..functions import scores as S
from ..operators import clusters as C
from ..operators.folders import folder_counts, outcomes
from ..sources import images as I
from ..sources.cache import append_cache, read_cache
from ..sources.phases import Phases
from ..sources.pixels import HEIC
from ..sources.shared import shared_dir, stored
from ..sources.state import read_state, state_tables, write_state
from . import catalogue as Q
from . import cull as K
from .run import BatchRun, CullRun, Models

SHORT = 200
NESTED = replace(Q.FOLDERS, scope="recursive")


def _own(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _files(spark, d) -> DataFrame:
    """Documents as files: path, content and its hash."""
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return Q._t(spark, d, "documents").select("doc_id", F.format_string("/files/%d.txt", "doc_id").alias("path"), content.alias("content")).withColumn("content_hash", P.content_hash(F.col("content")))


def q38(spark, d):
    r = Q._rooted(spark, d)
    return C.cluster_of(r.select("vec_id"), r, C.clusters(r))


def q39(spark, d):
    return outcomes(Q._t(spark, d, "labels").select((F.col("quality") == 1).alias("success")))


def q40(spark, d):
    return folder_counts(Q._pages(spark, d), F.col("host")).withColumn("total", S.at_most(7, F.col("n")))


def q41(spark, d):
    known, heic = (F.array(*map(F.lit, x)) for x in (Q.EXTENSIONS, HEIC))
    readable = F.array_except(known, heic)
    return Q._pages(spark, d).select("page_id", F.array_contains(readable, P.suffix(F.col("path"))).alias("readable"), F.size(readable).alias("n_readable"))


def q42(spark, d):
    by_host = Q._pages(spark, d).groupBy("host").agg(F.collect_set(P.suffix(F.col("path"))).alias("found"))
    return by_host.select("host", F.array_join(F.array_sort(F.array_union("found", F.array(*map(F.lit, P.EXTENSIONS)))), " ").alias("extensions"))


def q43(spark, d):
    sizes = Q._emb(spark, d).select("vec_id", (50 + F.col("vec_id") * 37 % 4000).cast("int").alias("w"), (80 + F.col("vec_id") * 91 % 3000).cast("int").alias("h"))
    return sizes.select("vec_id", S.shrunk_side(F.col("w"), F.col("h")).alias("width"), S.shrunk_side(F.col("h"), F.col("w")).alias("height"))


def q44(spark, d):
    return Q._t(spark, d, "events").select("event_id", S.iso_time(F.col("ts")).alias("at"))


def q45(spark, d):
    return Q._t(spark, d, "pages").select("page_id", P.base_url(F.col("url")).alias("address"), F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"), S.preview(F.col("html")).alias("quoted"))


def q46(spark, d):
    by_lang = Q._t(spark, d, "documents").groupBy("lang").agg(F.collect_set("source").alias("names"), F.min("source").alias("first"))
    return by_lang.select("lang", S.has_model(F.col("names"), F.concat("first", F.lit(":13b"))).alias("first_there"), S.has_model(F.col("names"), F.lit("none:7b")).alias("none_there"))


def q47(spark, d):
    """Two writes to the cache; what is there already is not added again."""
    files = _files(spark, d).select("content_hash", F.array(F.length("content").cast("float")).alias("embedding"))
    cache = _own(spark, "cache")
    append_cache(files.where("size(embedding) = 1 AND element_at(embedding, 1) > 500"), cache)
    append_cache(files.join(read_cache(spark, cache), "content_hash", "left_anti"), cache)
    return spark.read.parquet(cache).select("content_hash", "prefix", F.element_at("embedding", 1).cast("double").alias("size"))


def q48(spark, d):
    """Phases, the rows told of each when it was written, and a second run that builds none of them again."""
    told: list[tuple[str, int]] = []
    folder, run_id = _own(spark, "phases"), Q.CONFIG.run_id(d)
    builds: dict[str, Callable[[], DataFrame]] = {
        "discovered": lambda: Q._pages(spark, d).select("path"),
        "embedded": lambda: Q._emb(spark, d).select("vec_id"),
        "scored": lambda: Q.score(Q._emb(spark, d)).select("vec_id", "score"),
    }
    for name, build in builds.items():
        Phases(spark, folder, run_id, lambda phase, rows: told.append((phase, rows))).phase(name, build)

    def again() -> DataFrame:
        raise AssertionError("a finished phase was built again")

    phases = Phases(spark, folder, run_id, lambda phase, rows: told.append((phase, rows)))
    for name in builds:
        phases.phase(name, again)
    seen = spark.createDataFrame(told, "phase string, told bigint")
    return phases.summary().join(seen, "phase", "left").select("phase", "complete", "n", "told")


def q49(spark, d):
    """The state of a run as JSON and back: discovered paths in order, and scores."""
    phases = Phases(spark, _own(spark, "phases"), "run")
    phases.phase("discovered", lambda: Q.q02(spark, d).join(Q._t(spark, d, "pages"), "page_id").select(F.col("url").alias("path"), "ord"))
    phases.phase("scored", lambda: Q.score(Q._emb(spark, d)).select("vec_id", F.format_string("img_%d.jpg", "vec_id").alias("path"), "score"))
    where = _own(spark, "state")
    write_state(phases, "/photos", "/best", where)
    tables = state_tables(read_state(spark, where))
    scores = tables["aesthetic"].select("path", F.lit(None).cast("long").alias("ord"), F.round("score", 6).alias("score"))
    return tables["discovered"].select("path", "ord", F.lit(None).cast("double").alias("score")).unionByName(scores)


def q50(spark, d):
    """Files that a decoder refuses are rows with an error."""
    least = SHORT

    def decoder(content: bytes) -> bytes:
        if len(content) < least:
            raise ValueError
        return content[:3]

    return I.decode(_files(spark, d), decoder).select("path", F.length("image").alias("bytes"), "error")


def _embedder():
    """Embeds by the number of bytes; has memory for three images and refuses files with a byte count that ends in 7."""

    def model(batch):
        if len(batch) > 3:
            raise MemoryError
        if any(len(x) % 10 == 7 for x in batch):
            raise ValueError
        return [[float(len(x)), 1000.0] for x in batch]

    return model


def q51(spark, d):
    found = infer.embed(_files(spark, d).dropDuplicates(["content_hash"]), _embedder, 16)
    return found.select("content_hash", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("x"), "error")


def q52(spark, d):
    """The cache holds the hashes of labelled documents with another embedding; only the others are embedded."""
    files, cache = _files(spark, d), _own(spark, "cache")
    known = files.join(Q._t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("content_hash", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("embedding"))
    append_cache(known, cache)
    found = infer.embed_with_cache(files, _embedder, cache)
    return found.select("path", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("x"), "error")


def _analyzer():
    """Scores by the number of bytes; some answers hold no number, some calls fail."""

    def ask(image: bytes) -> str:
        n = len(image)
        if n % 11 == 3:
            raise OSError
        return "no idea" if n % 11 == 5 else f"I give it {n % 11}/10"

    return ask


def q53(spark, d):
    """Answers about the candidates with the best scores only."""
    images = _files(spark, d)
    best = stored(images.orderBy(F.length("content").desc(), "doc_id").limit(Q.CANDIDATES), "best")
    return infer.analyze(best, _analyzer, concurrency=4, delay=0.0)


def _nested(spark, d) -> DataFrame:
    """Embeddings as images in folders: labels below 5 lie below /p/a, the others below /p; each third image of a label in its folder `sub`."""
    folder = F.concat(F.when(F.col("label") < 5, F.lit("/p/a")).otherwise(F.lit("/p")), F.when(F.col("label") % 2 == 0, F.lit("")).otherwise(F.format_string("/l%d", "label")), F.when(F.col("vec_id") % 3 == 0, F.lit("/sub")).otherwise(F.lit("")))
    return Q._emb(spark, d).select("vec_id", "embedding", folder.alias("folder")).withColumn("path", F.concat("folder", F.format_string("/img_%d.jpg", "vec_id")))


def q54(spark, d):
    """A batch whose folders choose among all images below them; quotas count direct ones."""
    out = K.cull_folders(_nested(spark, d), NESTED, Q.score, "folder").selected
    return out.select("folder", F.col("rank").cast("long"), "vec_id", F.col("target").cast("long"))


def q55(spark, d):
    """A batch with a model's answers about the best five candidates of each folder."""
    config = replace(Q.FOLDERS, scope="direct", llm_candidates=5)

    def answers(best: DataFrame) -> DataFrame:
        return best.select("folder", "vec_id", F.when(F.col("vec_id") % 10 > 0, (F.col("vec_id") % 10).cast("double")).otherwise(F.lit(5.0)).alias("composition"))

    out = K.cull_folders(Q._emb(spark, d), config, Q.score, "label", answers).selected
    return out.select(F.col("folder").alias("label"), F.col("rank").cast("long"), "vec_id", F.round("final", 6).alias("final"))


def q56(spark, d):
    """A phase's table is written whole or not at all, and a run's tables go with it: what is there before and after."""
    phases = Phases(spark, _own(spark, "phases"), "run")
    phases.phase("discovered", lambda: Q._pages(spark, d).select("path"))
    before = stored(phases.summary(("discovered", "scored")).select("phase", "complete", "n", F.lit(0).alias("moment")), "before")
    phases.delete()
    return before.unionByName(phases.summary(("discovered", "scored")).select("phase", "complete", "n", F.lit(1).alias("moment")))


def q57(spark, d):
    """The dimensions of the vectors, and where a model of the tasks that read them would run."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(device=infer.device())

    seen = Q._emb(spark, d).select(F.size("embedding").alias("dim")).mapInPandas(run, "dim int, device string")
    return seen.groupBy("dim", "device").agg(F.count(F.lit(1)).alias("n"))


def _folder(spark, files: DataFrame) -> str:
    """A folder with a small file for each `name` (a path in it), written by the executors."""
    folder = I.local_path(_own(spark, "files"))
    if folder is None:
        raise ValueError("these files need a shared folder in a file system that all see")

    def write(frames):
        for pdf in frames:
            for name in pdf["name"]:
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(name.encode())
            yield pdf[["name"]]

    stored(files.select("name").mapInPandas(write, "name string"), "written")
    return folder


def q58(spark, d):
    """Supported files of a folder in path order, those in hidden folders included."""
    kind = F.element_at(F.array(*map(F.lit, ("jpg", "PNG", "txt", "Heic", "jpeg"))), (F.col("page_id") % 5 + 1).cast("int"))
    place = F.when(F.col("page_id") % 7 == 0, F.lit(".hidden/")).otherwise(F.lit(""))
    folder = _folder(spark, Q._pages(spark, d).select(F.concat("host", F.lit("/"), place, F.col("page_id").cast("string"), F.lit("."), kind).alias("name")))
    return I.discover(spark, folder).select(P.relative(F.col("path"), F.lit(folder)).alias("path"), "ord")


def _photos(spark, d, folder: Column) -> tuple[str, str]:
    """A folder of image files for the embeddings, and the table of their vectors."""
    rows = Q._emb(spark, d).select(F.concat(folder, F.format_string("img_%06d.jpg", "vec_id")).alias("name"), "embedding")
    root, table = _folder(spark, rows), _own(spark, "vectors")
    rows.select(F.concat(F.lit(f"{root}/"), "name").alias("path"), "embedding").write.parquet(table)
    return root, table


def q59(spark, d):
    """A run from files to copies and a report: the report as it was written, and whether the copies are there."""
    root, table = _photos(spark, d, F.lit(""))
    out = I.local_path(_own(spark, "best"))
    config = replace(Q.CONFIG, representative="first")
    CullRun(spark, root, out, config, Models(weights=(tuple(Q.WEIGHTS), Q.BIAS)), embeddings=table).run()
    rows = spark.read.option("header", True).option("escape", '"').csv(f"file://{out}/report.csv")
    copies = I.list_files(spark, out).select(F.regexp_replace("path", "^.*/[0-9]+_", "").alias("filename"), F.lit(True).alias("there"))
    kept = rows.join(copies, "filename", "left")
    return kept.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("rank", "filename", "aesthetic_score", "composition_score", "final_score", "cluster_id", "selected")], F.coalesce("there", F.lit(False)).alias("copied"))


def q60(spark, d):
    """A batch from files: what each folder's run came to."""
    root, table = _photos(spark, d, F.format_string("l%d/", "label"))
    run = BatchRun(spark, root, I.local_path(_own(spark, "best")), replace(Q.FOLDERS, scope="direct"), Models(weights=(tuple(Q.WEIGHTS), Q.BIAS)), embeddings=table)
    return run.run().select(F.col("rel_path").alias("folder"), "chosen", "failed", "success")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "q38_cluster_of_image": q38, "q39_outcomes": q39, "q40_at_most": q40, "q41_readable_extensions": q41, "q42_extension_union": q42, "q43_shrunk_size": q43, "q44_iso_times": q44,
        "q45_string_helpers": q45, "q46_model_there": q46, "q47_cache_write": q47, "q48_phases_resume": q48, "q49_state_json": q49, "q50_decode_errors": q50, "q51_embed_batches": q51,
        "q52_embed_with_cache": q52, "q53_analyze": q53, "q54_batch_recursive": q54, "q55_batch_composition": q55, "q56_phase_delete": q56,
        "q57_dimension_and_device": q57, "q58_discover_files": q58, "q59_run_from_files": q59, "q60_batch_from_files": q60,
    }


_HASH = "substr(sha256(coalesce(text, '')), 1, 16)"
_BYTES = "octet_length(encode(coalesce(text, '')))"
_X = f"round(({_BYTES} / sqrt({_BYTES}::DOUBLE * {_BYTES} + 1000000.0::DOUBLE))::FLOAT::DOUBLE, 4)"
_NESTED = """x AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label < 5 THEN '/p/a' ELSE '/p' END || CASE WHEN label % 2 = 0 THEN '' ELSE '/l' || label END || CASE WHEN vec_id % 3 = 0 THEN '/sub' ELSE '' END AS own FROM embeddings),
    n AS (SELECT own AS label, count(*) AS n FROM x GROUP BY own),
    e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n.label, vec_id) AS id, vec_id, v, n.label FROM x JOIN n ON x.own = n.label OR starts_with(x.own, n.label || '/'))"""


def oracle_sql() -> dict[str, str]:
    extensions = ", ".join(f"'{x}'" for x in Q.EXTENSIONS if x not in HEIC)
    side = "CASE WHEN greatest({a}, {b}) <= 1024 THEN {a} ELSE greatest(trunc({a} * (1024.0::DOUBLE / greatest({a}, {b}))), 1) END::INT"
    failed = f"CASE WHEN {_BYTES} % 10 = 7 THEN '{infer.EMBED_FAILED}' END"
    folder_pairs = f"p AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM e a JOIN e b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {Q.TAU_FOLDER})"
    return {
        "q38_cluster_of_image": f"WITH RECURSIVE {Q._PAIRS}{Q._ROOTS}{Q._NUMBERED} SELECT c.id AS vec_id, k.cluster_id FROM c LEFT JOIN k USING (root)",
        "q39_outcomes": "SELECT count(*) FILTER (quality = 1) AS ok, count(*) FILTER (NOT quality = 1) AS failed FROM labels",
        "q40_at_most": f"WITH {Q._PATHS} SELECT host AS folder, count(*) AS n, least(7, count(*)) AS total FROM u GROUP BY host",
        "q41_readable_extensions": f"WITH {Q._PATHS} SELECT page_id, lower(regexp_extract(path, '[^/]([.][^./]+)$', 1)) IN ({extensions}) AS readable, {len([x for x in Q.EXTENSIONS if x not in HEIC])}::INT AS n_readable FROM u",
        "q42_extension_union": f"WITH {Q._PATHS}, s AS (SELECT host, lower(regexp_extract(path, '[^/]([.][^./]+)$', 1)) AS x FROM u UNION SELECT host, unnest([{', '.join(repr(x) for x in P.EXTENSIONS)}]) FROM u) SELECT host, string_agg(x, ' ' ORDER BY x) AS extensions FROM s GROUP BY host",
        "q43_shrunk_size": f"WITH s AS (SELECT vec_id, 50 + vec_id * 37 % 4000 AS w, 80 + vec_id * 91 % 3000 AS h FROM embeddings) SELECT vec_id, {side.format(a='w', b='h')} AS width, {side.format(a='h', b='w')} AS height FROM s",
        "q44_iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events",
        "q45_string_helpers": "SELECT page_id, rtrim(url, '/') AS address, split_part(url, ':', 1) AS scheme, substr(html, 1, 100) AS quoted FROM pages",
        "q46_model_there": "SELECT lang, true AS first_there, bool_or(contains(source, 'none')) AS none_there FROM documents GROUP BY lang",
        "q47_cache_write": f"SELECT DISTINCT {_HASH} AS content_hash, substr({_HASH}, 1, 2) AS prefix, {_BYTES}::DOUBLE AS size FROM documents",
        "q48_phases_resume": "SELECT phase, n IS NOT NULL AS complete, coalesce(n, 0) AS n, n AS told FROM (SELECT 'discovered' AS phase, count(*) AS n FROM pages UNION ALL SELECT 'embedded', count(*) FROM embeddings UNION ALL SELECT 'scored', count(*) FROM embeddings UNION ALL SELECT unnest(['rooted', 'clusters', 'composed', 'final', 'selected']), NULL)",
        "q49_state_json": f"WITH {Q._E}{Q._SCORE} SELECT url AS path, row_number() OVER (ORDER BY string_split(url, '/'), page_id) - 1 AS ord, NULL::DOUBLE AS score FROM pages UNION ALL SELECT 'img_' || id || '.jpg', NULL, round(score, 6) FROM s",
        "q50_decode_errors": f"SELECT '/files/' || doc_id || '.txt' AS path, CASE WHEN {_BYTES} >= {SHORT} THEN 3::INT END AS bytes, CASE WHEN {_BYTES} < {SHORT} THEN '{I.FAILED}' END AS error FROM documents",
        "q51_embed_batches": f"SELECT DISTINCT {_HASH} AS content_hash, CASE WHEN {_BYTES} % 10 <> 7 THEN {_X} END AS x, {failed} AS error FROM documents",
        "q52_embed_with_cache": f"WITH k AS (SELECT DISTINCT {_HASH} AS h FROM documents SEMI JOIN labels USING (doc_id)) SELECT '/files/' || doc_id || '.txt' AS path, CASE WHEN h IS NOT NULL THEN 0.0::DOUBLE WHEN {_BYTES} % 10 <> 7 THEN {_X} END AS x, CASE WHEN h IS NULL THEN {failed} END AS error FROM documents LEFT JOIN k ON h = {_HASH}",
        "q53_analyze": f"WITH b AS (SELECT doc_id, {_BYTES} % 11 AS r FROM documents ORDER BY {_BYTES} DESC, doc_id LIMIT {Q.CANDIDATES}) SELECT '/files/' || doc_id || '.txt' AS path, CASE WHEN r IN (3, 5) THEN 5.0::DOUBLE WHEN r = 0 THEN 10.0::DOUBLE ELSE r::DOUBLE END AS score FROM b",
        "q54_batch_recursive": f"""WITH RECURSIVE {_NESTED}, {folder_pairs}{Q._ROOTS}, s AS MATERIALIZED (SELECT id, vec_id, label, greatest(1.0::DOUBLE, least(10.0::DOUBLE, {Q._RAW})) AS score FROM e),
            q AS (SELECT label, {Q._quota('n', '0.1', 3, 7)} AS target FROM n),
            r AS (SELECT s.label, row_number() OVER (PARTITION BY s.label ORDER BY score DESC, s.id) AS rank, s.vec_id FROM s JOIN c ON c.id = s.id WHERE c.root = c.id)
            SELECT label AS folder, rank, vec_id, target::BIGINT AS target FROM r JOIN q USING (label) WHERE rank <= target""",
        "q55_batch_composition": f"""WITH RECURSIVE {Q._FOLDER_PAIRS}{Q._ROOTS}{Q._SCORE}, q AS (SELECT label, {Q._quota('count(*)', '0.1', 3, 7)} AS target FROM e GROUP BY label),
            r AS (SELECT s.label, s.id, s.score, row_number() OVER (PARTITION BY s.label ORDER BY score DESC, s.id) AS place FROM s JOIN c ON c.id = s.id WHERE c.root = c.id),
            f AS (SELECT label, id, CASE WHEN place <= 5 THEN 0.6::DOUBLE * score + 0.4::DOUBLE * CASE WHEN id % 10 > 0 THEN (id % 10)::DOUBLE ELSE 5.0::DOUBLE END ELSE score END AS final FROM r),
            o AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY final DESC, id) AS rank, id, final FROM f)
            SELECT label, rank, id AS vec_id, round(final, 6) AS final FROM o JOIN q USING (label) WHERE rank <= target""",
        "q57_dimension_and_device": "SELECT len(embedding)::INT AS dim, 'cpu' AS device, count(*) AS n FROM embeddings GROUP BY 1",
        "q58_discover_files": f"WITH {Q._PATHS}, f AS (SELECT host || '/' || CASE WHEN page_id % 7 = 0 THEN '.hidden/' ELSE '' END || page_id || '.' || ['jpg', 'PNG', 'txt', 'Heic', 'jpeg'][page_id % 5 + 1] AS path FROM u WHERE page_id % 5 <> 2) SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS ord FROM f",
        "q59_run_from_files": f"""WITH RECURSIVE {Q._PAIRS}{Q._ROOTS}{Q._NUMBERED}{Q._SCORE},
            o AS (SELECT s.id, s.score, k.cluster_id, row_number() OVER (ORDER BY s.score DESC, s.id) AS pos FROM s JOIN c ON c.id = s.id LEFT JOIN k ON k.root = s.id WHERE c.root = c.id)
            SELECT CASE WHEN pos <= {Q.TOP} THEN pos::VARCHAR ELSE '' END AS rank, 'img_' || lpad(id::VARCHAR, 6, '0') || '.jpg' AS filename, printf('%.2f', score) AS aesthetic_score, '' AS composition_score,
                   printf('%.2f', score) AS final_score, coalesce(cluster_id::VARCHAR, '') AS cluster_id, CASE WHEN pos <= {Q.TOP} THEN 'yes' ELSE 'no' END AS selected, pos <= {Q.TOP} AS copied FROM o""",
        "q60_batch_from_files": f"""WITH RECURSIVE {Q._FOLDER_PAIRS}{Q._ROOTS}, n AS (SELECT e.label, count(*) AS n, count(*) FILTER (c.root = c.id) AS kept FROM e JOIN c USING (id) GROUP BY e.label)
            SELECT 'l' || label AS folder, least(kept, {Q._quota('n', '0.1', 3, 7)})::BIGINT AS chosen, 0::BIGINT AS failed, true AS success FROM n""",
        "q56_phase_delete": "SELECT phase, complete, n, moment::INT AS moment FROM (SELECT 'discovered' AS phase, true AS complete, count(*) AS n, 0 AS moment FROM pages UNION ALL SELECT 'scored', false, 0, 0 UNION ALL SELECT 'discovered', false, 0, 1 UNION ALL SELECT 'scored', false, 0, 1)",
    }
