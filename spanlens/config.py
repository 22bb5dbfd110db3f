"""Every knob of retrieval with its default."""

from __future__ import annotations

from dataclasses import dataclass, field

from spanlens.operators.chunk import ChunkConfig


@dataclass(frozen=True)
class RetrieverConfig:
    k_candidates: int = 24
    per_file: int = 3
    rrf_k: int = 60
    max_terms: int = 24
    df_budget: int = 20_000_000
    max_tf: int = 2
    weight: float = 0.5
    threshold: float = 0.5
    min_keep: int = 3
    top_n: int = 10
    line_budget: int = 400
    gap: int = 3
    max_span: int = 50
    related: int = 8
    chunks: ChunkConfig = field(default_factory=ChunkConfig)

    def clamped(self) -> RetrieverConfig:
        """Within the limits that a request may ask for: at most 20 spans."""
        from dataclasses import replace

        return replace(self, top_n=min(self.top_n, 20), threshold=min(max(self.threshold, 0.0), 1.0), weight=min(max(self.weight, 0.0), 1.0))
