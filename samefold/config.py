"""What a deployment may set."""

from __future__ import annotations

from dataclasses import dataclass, field

KINDS = ("pim_product", "atlas_source_product")
MATCH, REVIEW, NO_MATCH = "match", "review", "no_match"


@dataclass(frozen=True)
class EngineConfig:
    match_threshold: int = 75
    review_threshold: int = 45
    trigram_limit: int = 50
    word_limit: int = 50
    candidate_limit: int = 100
    image_top_k: int = 20
    phash_max_distance: int = 10
    default_limit: int = 10
    max_limit: int = 20
    image_enabled: bool = True
    embedding: dict = field(default_factory=lambda: {"provider": "none"})

    @property
    def dim(self) -> int:
        """Numbers in a vector."""
        return int(self.embedding.get("dim", 1152))

    @property
    def model_id(self) -> str:
        return self.embedding.get("model") or self.embedding.get("provider", "none")
