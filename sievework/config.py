"""Settings of a cull, in one immutable record."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class CullConfig:
    """Thresholds, weights and limits; the defaults are the documented ones of the command line."""

    similarity_threshold: float = 0.92
    target: int = 400
    aesthetic_weight: float = 0.6
    composition_weight: float = 0.4
    llm_candidates: int = 800
    batch_size: int = 16
    request_delay: float = 0.5
    request_timeout: float = 60.0
    #: calls to the model server at the same time
    request_concurrency: int = 8
    #: "first": the earliest member stands for a cluster; "best": the one with the highest score
    representative: str = "first"
    #: quota of a folder in a batch
    ratio: float = 0.1
    least: int = 10
    most: int = 1000
    #: "recursive": a folder's run sees the images below it, too; "direct": only its own
    scope: str = "recursive"

    def __post_init__(self) -> None:
        if not -1 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must lie in [-1, 1]")
        if self.batch_size < 1 or self.request_concurrency < 1:
            raise ValueError("batch_size and request_concurrency must be at least 1")
        if self.target < 0 or self.llm_candidates < 0 or self.least < 0 or self.most < 0:
            raise ValueError("counts must not be negative")
        if self.representative not in ("first", "best") or self.scope not in ("recursive", "direct"):
            raise ValueError("unknown representative or scope")

    def run_id(self, *inputs: str) -> str:
        """Names a run by its inputs and settings, so phases of another run are never reused."""
        return hashlib.sha256(json.dumps([asdict(self), inputs], sort_keys=True).encode()).hexdigest()[:16]
