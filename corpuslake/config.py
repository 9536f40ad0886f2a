"""Defaults of the engine; every one can be set by an environment variable CORPUSLAKE_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 512
    chunk_overlap: int = 128
    top_k: int = 5
    similarity_threshold: float = 0.35
    max_context_tokens: int = 4096
    temperature: float = 0.1
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    keyword_weight: float = 0.3
    vector_weight: float = 0.7
    hamming_threshold: int = 3
    cosine_duplicate: float = 0.98
    upload_limit_bytes: int = 50 * 1024 * 1024

    @staticmethod
    def from_env() -> EngineConfig:
        found = {f.name: type(f.default)(os.environ[k]) for f in fields(EngineConfig) if (k := f"CORPUSLAKE_{f.name.upper()}") in os.environ}
        return EngineConfig(**found)

    @property
    def context_chars(self) -> int:
        return self.max_context_tokens * 2 // 3

    def pool(self, top_k: int) -> int:
        """Candidates that each ranked list gives to fusion."""
        return max(6 * top_k, 20)
