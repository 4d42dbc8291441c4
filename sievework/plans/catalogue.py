"""The registered queries over the driver's tables, and the same results in SQL.

`embeddings` stands for embedded images (vec_id is the input position, label the
folder), `pages.url` for paths (host is the folder), `documents` for files and
for answers of a model, `labels` for what is already cached.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CullConfig
from ..functions import paths as P
from ..functions.scores import blend, parse
from ..functions.vectors import norm
from ..operators import clusters as C
from ..operators import keyed, ranking
from ..operators.folders import ancestor_counts, folder_counts, with_targets, with_total
from ..operators.numbering import number_rows
from ..operators.report import report
from ..operators.similarity import similar_pairs
from ..sources.shared import stored
from . import cull as K

TAU, TAU_FOLDER = 0.4, 0.3
TOP, CANDIDATES = 20, 80
EXTENSIONS = (*P.EXTENSIONS, ".html")
WEIGHTS = [2.5 * (((37 * i) % 101) - 50) / 50.0 for i in range(64)]
BIAS = 5.5
CONFIG = CullConfig(similarity_threshold=TAU, target=TOP, llm_candidates=CANDIDATES)
FOLDERS = CullConfig(similarity_threshold=TAU_FOLDER, ratio=0.1, least=3, most=7)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _emb(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings")


def _pages(spark, d) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", P.without_query(F.col("url")).alias("path"), P.host(F.col("url")).alias("host"))


def score(df: DataFrame) -> DataFrame:
    return K.aesthetic(df, WEIGHTS, BIAS)


def _composition(df: DataFrame) -> DataFrame:
    """Stands for the model's answers: the label where it is a score, else the default."""
    return df.withColumn("composition", F.when(F.col("label").between(1, 10), F.col("label").cast("double")).otherwise(F.lit(5.0)))


def _rooted(spark, d) -> DataFrame:
    return stored(K.find_duplicates(_emb(spark, d), TAU).select("vec_id", "embedding", "label", "root"), "rooted")


def _cull(spark, d) -> K.CullResult:
    return K.cull(_emb(spark, d), CONFIG, score, _composition)


def _scores6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def q02(spark, d):
    return number_rows(_t(spark, d, "pages").select("page_id", "url"), [P.parts(F.col("url")), F.col("page_id")], "ord").select("page_id", "ord")


def q04(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", P.content_hash(F.col("text").cast("binary")).alias("hash16"))
    return rows.groupBy("hash16").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("min_doc_id")).where("n > 1")


def q07(spark, d):
    new = _t(spark, d, "labels").select("doc_id", F.lit("new").alias("origin"))
    return keyed.merged(_t(spark, d, "documents").select("doc_id", F.lit("old").alias("origin")), new, "doc_id")


def q09(spark, d):
    return _scores6(similar_pairs(_emb(spark, d), TAU), "sim")


def q10(spark, d):
    return similar_pairs(_emb(spark, d), TAU_FOLDER, within="label").groupBy("label").agg(F.count(F.lit(1)).alias("pairs"))


def q12(spark, d):
    return C.clusters(_rooted(spark, d))


def q13(spark, d):
    r = _rooted(spark, d)
    return C.members(r, C.clusters(r))


def q15(spark, d):
    r = _rooted(spark, d)
    return C.best_members(r, score(r))


def q16(spark, d):
    r = _rooted(spark, d)
    return C.duplicates(r, C.clusters(r), C.first_members(r))


def q17(spark, d):
    return C.unique_items(C.first_members(_rooted(spark, d))).select(F.col("id").alias("vec_id"), "ord")


def q19(spark, d):
    return _scores6(ranking.statistics(score(_emb(spark, d)), "score"), "mean", "std", "min", "max", "median")


def _candidates(spark, d):
    return ranking.top(score(_emb(spark, d)).select("vec_id", "label", "score"), CANDIDATES, F.coalesce("score", F.lit(0.0)), F.col("vec_id"))


def q22(spark, d):
    scored = score(_emb(spark, d)).select("vec_id", "score")
    composed = _composition(_candidates(spark, d)).select("vec_id", "composition")
    out = scored.join(composed, "vec_id", "left").withColumn("final", blend(F.col("score"), F.col("composition")))
    return _scores6(out.withColumnRenamed("score", "aesthetic"), "aesthetic", "final")


def q23(spark, d):
    chosen = ranking.ranked_top(q22(spark, d), TOP, F.col("final"), F.col("vec_id"))
    return chosen.select(F.col("rank").cast("long"), "vec_id", "final")


def q24(spark, d):
    named = ranking.output_names(q23(spark, d), F.format_string("img_%d.jpg", "vec_id"))
    return named.select("rank", "output_name")


def q25(spark, d):
    r = _cull(spark, d)
    chosen = r.selected.select("vec_id", "rank")
    path = F.format_string("/photos/label%d/img_%d.jpg", "label", "vec_id")
    rows = r.scored.join(chosen, "vec_id", "left").select("vec_id", path.alias("path"), F.col("aesthetic").alias("aesthetic_score"), F.col("composition").alias("composition_score"), F.col("final").alias("final_score"), "cluster_id", F.col("rank").isNotNull().alias("selected"), "rank")
    return report(rows)


def q28(spark, d):
    extra = spark.createDataFrame([("literal", 100)], "folder string, n bigint")
    return with_targets(folder_counts(_pages(spark, d), F.col("host")).unionByName(extra), 0.29, 3, 1000)


def q30(spark, d):
    plan = with_targets(_emb(spark, d).groupBy(F.col("label").alias("folder")).agg(F.count(F.lit(1)).alias("n")), 0.1, 3, 7)
    rows = score(_emb(spark, d)).select(F.col("label").alias("folder"), "vec_id", "score").join(plan, "folder")
    best = ranking.folder_top(rows, "folder", F.col("target"), 7, F.round("score", 6), F.col("vec_id"))
    return best.select(F.col("folder").alias("label"), F.col("rank").cast("long"), "vec_id")


def q33(spark, d):
    out = _cull(spark, d).selected
    return _scores6(out.select(F.col("rank").cast("long"), "vec_id", "final", "cluster_id"), "final")


def q34(spark, d):
    labels = _t(spark, d, "labels")
    return keyed.remaining(_t(spark, d, "documents"), labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id")


def q35(spark, d):
    r = _cull(spark, d)
    counts = [
        r.rooted.agg(F.count(F.lit(1)).alias("n")).select(F.lit("embedded").alias("phase"), "n"),
        r.clusters.agg(F.count(F.lit(1)).alias("n")).select(F.lit("clusters").alias("phase"), "n"),
        r.scored.agg(F.count(F.lit(1)).alias("n")).select(F.lit("scored").alias("phase"), "n"),
        r.scored.agg(F.count("composition").alias("n")).select(F.lit("composed").alias("phase"), "n"),
        r.selected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("selected").alias("phase"), "n"),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


HIDDEN_PATHS = ("/photos/a", "/photos/.cache/a", "/.photos", "photos/b.c", "/photos/..", "/a/b/.hidden/c")


def q36(spark, d):
    """Paths below hidden folders, over the pages' folders and some special forms."""
    special = spark.createDataFrame([(p,) for p in HIDDEN_PATHS], "path string")
    folder = F.when(F.col("page_id") % 3 == 0, F.lit("/.cache/")).otherwise(F.lit("/"))
    return special.unionByName(_pages(spark, d).select(F.concat(F.lit("/photos/"), "host", folder, "page_id").alias("path"))).select("path", P.hidden(F.col("path")).alias("hidden"))


def q37(spark, d):
    out = K.cull_folders(_emb(spark, d), FOLDERS, score, "label").selected
    return out.select(F.col("folder").alias("label"), F.col("rank").cast("long"), "vec_id", F.col("target").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "q01_discover_ext": lambda s, d: _pages(s, d).select("page_id", P.suffix(F.col("path")).alias("suffix"), P.suffix(F.col("path")).isin(*EXTENSIONS).alias("supported")),
        "q02_path_order": q02,
        "q03_content_hash": lambda s, d: _t(s, d, "documents").select("doc_id", P.content_hash(F.col("text").cast("binary")).alias("hash16")).withColumn("shard2", P.shard_prefix(F.col("hash16"))),
        "q04_exact_dup_groups": q04,
        "q05_cache_hits": lambda s, d: keyed.hits(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels"), "doc_id"),
        "q06_cache_misses": lambda s, d: keyed.misses(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels"), "doc_id"),
        "q07_cache_merge": q07,
        "q08_norms": lambda s, d: _emb(s, d).select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm")),
        "q09_similar_pairs": q09,
        "q10_pair_count_by_label": q10,
        "q11_components": lambda s, d: _rooted(s, d).select("vec_id", "root"),
        "q12_cluster_ids": q12,
        "q13_cluster_members": q13,
        "q14_rep_first": lambda s, d: C.first_members(_rooted(s, d)),
        "q15_rep_best": q15,
        "q16_duplicates": q16,
        "q17_unique_images": q17,
        "q18_aesthetic": lambda s, d: _scores6(score(_emb(s, d)).select("vec_id", "score"), "score"),
        "q19_score_stats": q19,
        "q20_llm_candidates": lambda s, d: _scores6(_candidates(s, d).select("vec_id", "score"), "score"),
        "q21_parse_score": lambda s, d: _t(s, d, "documents").select("doc_id", parse(F.col("text")).alias("score")),
        "q22_final_score": q22,
        "q23_top_n": q23,
        "q24_output_names": q24,
        "q25_report": q25,
        "q26_folder_counts": lambda s, d: folder_counts(_pages(s, d), F.col("host")),
        "q27_ancestor_counts": lambda s, d: ancestor_counts(_pages(s, d), F.col("path")),
        "q28_folder_targets": q28,
        "q29_plan_with_total": lambda s, d: with_total(with_targets(folder_counts(_pages(s, d), F.col("host")), 0.1, 3, 7)).withColumn("target", F.col("target").cast("long")),
        "q30_folder_top_n": q30,
        "q31_folder_dedup": lambda s, d: K.find_duplicates(_emb(s, d), TAU_FOLDER, within="label").select("label", "vec_id", "root"),
        "q32_flat_collisions": lambda s, d: ranking.collisions(_pages(s, d), P.basename(F.col("path"))),
        "q33_cull_end_to_end": q33,
        "q34_needing_embeddings": q34,
        "q35_phase_summary": q35,
        "q36_hidden_filter": q36,
        "q37_batch_cull": q37,
    }


_E = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_PAIRS = f"{_E}, p AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {TAU})"
_FOLDER_PAIRS = f"{_E}, p AS MATERIALIZED (SELECT a.label, a.id AS i, b.id AS j FROM e a JOIN e b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {TAU_FOLDER})"
_ROOTS = """, g AS MATERIALIZED (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
    reach(id, r) AS (SELECT id, id FROM e UNION SELECT g.j, reach.r FROM reach JOIN g ON g.i = reach.id),
    c AS MATERIALIZED (SELECT id, min(r) AS root FROM reach GROUP BY id)"""
_NUMBERED = ", k AS (SELECT row_number() OVER (ORDER BY root) - 1 AS cluster_id, root, count(*) AS size FROM c GROUP BY root HAVING count(*) > 1)"
_RAW = "5.5::DOUBLE + 2.5::DOUBLE * list_sum([x * ((((i - 1) * 37) % 101 - 50) / 50.0::DOUBLE) for x, i in v])"
_SCORE = f", s AS MATERIALIZED (SELECT id, label, greatest(1.0::DOUBLE, least(10.0::DOUBLE, {_RAW})) AS score FROM e)"
_COMPOSITION = "CASE WHEN label BETWEEN 1 AND 10 THEN label::DOUBLE ELSE 5.0::DOUBLE END"
_BLENDED = f""", cand AS (SELECT id, {_COMPOSITION} AS composition FROM s ORDER BY score DESC, id LIMIT {CANDIDATES}),
    f AS MATERIALIZED (SELECT s.id, s.label, s.score, cand.composition, CASE WHEN cand.composition IS NULL THEN s.score ELSE 0.6::DOUBLE * s.score + 0.4::DOUBLE * cand.composition END AS final FROM s LEFT JOIN cand USING (id))"""
_CULL = f""", s AS MATERIALIZED (SELECT e.id, e.label, greatest(1.0::DOUBLE, least(10.0::DOUBLE, {_RAW})) AS score FROM e JOIN c ON c.id = e.id WHERE c.root = c.id){_BLENDED},
    o AS MATERIALIZED (SELECT f.*, k.cluster_id, row_number() OVER (ORDER BY final DESC, f.id) AS pos FROM f LEFT JOIN k ON k.root = f.id)"""
_PATHS = "u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, split_part(url, '/', 3) AS host FROM pages)"


def _quota(n: str, ratio: str, least: int, most: int) -> str:
    return f"least(greatest(trunc({n} * {ratio}::DOUBLE)::INT, {least}), {most}, {n}::INT)"


def oracle_sql() -> dict[str, str]:
    extensions = ", ".join(f"'{x}'" for x in EXTENSIONS)
    suffix = "lower(regexp_extract(path, '[^/]([.][^./]+)$', 1))"
    blended = f"WITH {_E}{_SCORE}{_BLENDED}"
    rounded = f"{blended}, h AS (SELECT id, round(final, 6) AS final FROM f), t AS (SELECT row_number() OVER (ORDER BY final DESC, id) AS rank, id, final FROM h QUALIFY rank <= {TOP})"
    return {
        "q01_discover_ext": f"WITH {_PATHS} SELECT page_id, {suffix} AS suffix, {suffix} IN ({extensions}) AS supported FROM u",
        "q02_path_order": "SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) - 1 AS ord FROM pages",
        "q03_content_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS hash16, substr(sha256(text), 1, 2) AS shard2 FROM documents",
        "q04_exact_dup_groups": "SELECT substr(sha256(text), 1, 16) AS hash16, count(*) AS n, min(doc_id) AS min_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "q05_cache_hits": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "q06_cache_misses": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "q07_cache_merge": "SELECT doc_id, 'new' AS origin FROM labels UNION ALL SELECT doc_id, 'old' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "q08_norms": f"WITH {_E} SELECT id AS vec_id, round(sqrt(list_sum([x * x for x in v])), 6) AS norm FROM e",
        "q09_similar_pairs": f"WITH {_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM p",
        "q10_pair_count_by_label": f"WITH {_FOLDER_PAIRS} SELECT label, count(*) AS pairs FROM p GROUP BY label",
        "q11_components": f"WITH RECURSIVE {_PAIRS}{_ROOTS} SELECT id AS vec_id, root FROM c",
        "q12_cluster_ids": f"WITH RECURSIVE {_PAIRS}{_ROOTS}{_NUMBERED} SELECT cluster_id, root, size FROM k",
        "q13_cluster_members": f"WITH RECURSIVE {_PAIRS}{_ROOTS}{_NUMBERED} SELECT cluster_id, id AS vec_id FROM c JOIN k USING (root)",
        "q14_rep_first": f"WITH RECURSIVE {_PAIRS}{_ROOTS} SELECT root, min(id) AS representative FROM c GROUP BY root",
        "q15_rep_best": f"WITH RECURSIVE {_PAIRS}{_ROOTS}{_SCORE} SELECT root, id AS representative FROM c JOIN s USING (id) QUALIFY row_number() OVER (PARTITION BY root ORDER BY score DESC, id) = 1",
        "q16_duplicates": f"WITH RECURSIVE {_PAIRS}{_ROOTS}{_NUMBERED} SELECT cluster_id, id AS vec_id FROM c JOIN k USING (root) WHERE id <> root",
        "q17_unique_images": f"WITH RECURSIVE {_PAIRS}{_ROOTS} SELECT root AS vec_id, row_number() OVER (ORDER BY root) - 1 AS ord FROM (SELECT DISTINCT root FROM c)",
        "q18_aesthetic": f"WITH {_E}{_SCORE} SELECT id AS vec_id, round(score, 6) AS score FROM s",
        "q19_score_stats": f"WITH {_E}{_SCORE} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max, round(median(score), 6) AS median FROM s",
        "q20_llm_candidates": f"WITH {_E}{_SCORE} SELECT id AS vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {CANDIDATES}",
        "q21_parse_score": r"SELECT doc_id, coalesce(list_filter([TRY_CAST(x AS DOUBLE) for x in regexp_extract_all(coalesce(text, ''), '\b(\d+(?:\.\d+)?)\b', 1)], lambda x: x BETWEEN 1 AND 10)[1], 5.0::DOUBLE) AS score FROM documents",
        "q22_final_score": f"{blended} SELECT id AS vec_id, round(score, 6) AS aesthetic, composition, round(final, 6) AS final FROM f",
        "q23_top_n": f"{rounded} SELECT rank, id AS vec_id, final FROM t",
        "q24_output_names": f"{rounded} SELECT rank, lpad(rank::VARCHAR, length((SELECT count(*) FROM t)::VARCHAR)::INT, '0') || '_img_' || id || '.jpg' AS output_name FROM t",
        "q25_report": f"""WITH RECURSIVE {_PAIRS}{_ROOTS}{_NUMBERED}{_CULL}
            SELECT CASE WHEN pos <= {TOP} THEN pos::VARCHAR ELSE '' END AS rank, 'img_' || id || '.jpg' AS filename, '/photos/label' || label || '/img_' || id || '.jpg' AS path,
                   printf('%.2f', score) AS aesthetic_score, CASE WHEN composition IS NULL OR composition = 0 THEN '' ELSE printf('%.2f', composition) END AS composition_score,
                   printf('%.2f', final) AS final_score, coalesce(cluster_id::VARCHAR, '') AS cluster_id, CASE WHEN pos <= {TOP} THEN 'yes' ELSE 'no' END AS selected FROM o""",
        "q26_folder_counts": f"WITH {_PATHS} SELECT host AS folder, count(*) AS n FROM u GROUP BY host",
        "q27_ancestor_counts": f"WITH {_PATHS}, a AS (SELECT unnest([array_to_string(string_split(path, '/')[1:k], '/') for k in range(1, len(string_split(path, '/')))]) AS folder FROM u) SELECT folder, count(*) AS n_recursive FROM a GROUP BY folder",
        "q28_folder_targets": f"WITH {_PATHS}, n AS (SELECT host AS folder, count(*) AS n FROM u GROUP BY host UNION ALL SELECT 'literal', 100) SELECT folder, n, {_quota('n', '0.29', 3, 1000)} AS target FROM n",
        "q29_plan_with_total": f"WITH {_PATHS}, n AS (SELECT host AS folder, count(*) AS n FROM u GROUP BY host), q AS (SELECT folder, n, {_quota('n', '0.1', 3, 7)} AS target FROM n) SELECT CASE WHEN grouping(folder) = 1 THEN 'TOTAL' ELSE folder END AS folder, sum(n)::BIGINT AS n, sum(target)::BIGINT AS target FROM q GROUP BY ROLLUP (folder)",
        "q30_folder_top_n": f"WITH {_E}{_SCORE}, q AS (SELECT label, {_quota('count(*)', '0.1', 3, 7)} AS target FROM s GROUP BY label), r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, id) AS rank, id FROM s) SELECT label, rank, id AS vec_id FROM r JOIN q USING (label) WHERE rank <= target",
        "q31_folder_dedup": f"WITH RECURSIVE {_FOLDER_PAIRS}{_ROOTS} SELECT label, id AS vec_id, root FROM c JOIN e USING (id)",
        "q32_flat_collisions": f"WITH {_PATHS} SELECT string_split(path, '/')[-1] AS output_name, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1",
        "q33_cull_end_to_end": f"WITH RECURSIVE {_PAIRS}{_ROOTS}{_NUMBERED}{_CULL} SELECT pos AS rank, id AS vec_id, round(final, 6) AS final, cluster_id FROM o WHERE pos <= {TOP}",
        "q34_needing_embeddings": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1",
        "q35_phase_summary": f"""WITH RECURSIVE {_PAIRS}{_ROOTS}{_NUMBERED}{_CULL}
            SELECT 'embedded' AS phase, count(*) AS n FROM e UNION ALL SELECT 'clusters', count(*) FROM k UNION ALL SELECT 'scored', count(*) FROM o
            UNION ALL SELECT 'composed', count(composition) FROM o UNION ALL SELECT 'selected', count(*) FROM o WHERE pos <= {TOP}""",
        "q36_hidden_filter": "SELECT path, len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) > 0 AS hidden FROM (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in HIDDEN_PATHS) + f") t(path) UNION ALL (WITH {_PATHS} SELECT '/photos/' || host || CASE WHEN page_id % 3 = 0 THEN '/.cache/' ELSE '/' END || page_id FROM u))",
        "q37_batch_cull": f"""WITH RECURSIVE {_FOLDER_PAIRS}{_ROOTS}{_SCORE},
            q AS (SELECT label, {_quota('count(*)', '0.1', 3, 7)} AS target FROM e GROUP BY label),
            r AS (SELECT s.label, row_number() OVER (PARTITION BY s.label ORDER BY score DESC, s.id) AS rank, s.id FROM s JOIN c ON c.id = s.id WHERE c.root = c.id)
            SELECT label, rank, id AS vec_id, target::BIGINT AS target FROM r JOIN q USING (label) WHERE rank <= target""",
    }
