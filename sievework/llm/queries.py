"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, packing, quality, secrets, sharding, simhash, token_counts, token_file
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_bpe_round_trip": _over("documents", bpe.bpe_round_trip),
        "op2_secret_scan": _over("documents", secrets.scan_secrets),
        "op3_pack_sequences": _over("documents", packing.pack_documents),
        "op4_shard_documents": _over("documents", sharding.shard),
        "op5_quality_rules": _over("documents", quality.quality),
        "op6_html_main_text": _over("pages", html_extract.extract_main_text),
        "op7_token_file": _over("documents", token_file.token_file_round_trip),
        "op8_exact_dedup": _over("documents", exact_dedup.exact_dedup),
        "op9_token_counts": _over("documents", token_counts.token_counts),
        "op10_simhash_components": _over("documents", simhash.simhash_components),
    }


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t)
        """,
    }
