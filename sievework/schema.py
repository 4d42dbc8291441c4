"""Explicit schemas of what is kept between runs."""

from __future__ import annotations

EMBEDDING_CACHE = "content_hash string, embedding array<float>, prefix string"
#: The state of a run as one JSON object; fixed values, so that files of either kind can be read.
STATE = (
    "source_dir string, output_dir string, started_at string, updated_at string, discovered_images array<string>, discovery_complete boolean, "
    "embeddings_complete array<string>, embeddings_failed array<string>, embeddings_phase_complete boolean, unique_images array<string>, "
    "duplicate_clusters array<struct<cluster_id: bigint, representative: string, members: array<string>>>, dedup_complete boolean, "
    "aesthetic_scores map<string, double>, aesthetic_complete boolean, composition_scores map<string, double>, composition_complete boolean, selection_complete boolean"
)
