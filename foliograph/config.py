"""Settings: typed, frozen, unknown names refused."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    dense_top_k: int = 50
    sparse_top_k: int = 50
    rrf_top_k: int = 20
    rerank_top_n: int = 6
    rrf_k: int = 60
    max_chunk_chars: int = 8000
    embed_dims: int = 64
    reranker: str = "overlap"
    prefix_version: str = "1"

    @classmethod
    def of(cls, **given) -> Settings:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    @property
    def rrf_miss(self) -> int:
        return max(self.dense_top_k, self.sparse_top_k) + 1
