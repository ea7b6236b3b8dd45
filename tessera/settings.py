"""Settings of the engine, with the checks that keep them consistent."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Immutable; from_env() reads TESSERA_<NAME> for each field."""

    default_top_k: int = 8
    max_top_k: int = 32
    candidate_k: int = 120
    rrf_k: int = 60
    dense_weight: float = 0.50
    fts_weight: float = 0.38
    symbol_weight: float = 0.82
    path_weight: float = 0.55
    symbol_bonus: float = 0.0005
    snippet_chars: int = 700
    fetch_chars: int = 16_000
    reference_limit: int = 80
    map_limit: int = 240
    chunk_tokens: int = 384
    chunk_overlap: int = 32
    min_chunk_chars: int = 80
    file_summaries: bool = False
    pdf_chunk_tokens: int = 512
    pdf_chunk_overlap: int = 48
    pdf_max_pages: int = 2000
    pdf_max_chars: int = 20_000_000
    pdf_dense_multiplier: int = 8
    max_file_bytes: int = 750_000
    max_pdf_bytes: int = 200_000_000
    max_files: int = 250_000
    max_targeted_paths: int = 256
    embedding_dim: int = 384
    exact_symbol_fast_path: bool = True
    strict_prefix: bool = False
    read_only: bool = True
    allow_reindex: bool = False

    def __post_init__(self) -> None:
        zero_ok = {"chunk_overlap", "pdf_chunk_overlap"}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool):
                continue
            if isinstance(v, int) and (v < 0 or v == 0 and f.name not in zero_ok):
                raise ValueError(f"{f.name} must be {'at least 0' if f.name in zero_ok else 'positive'}")
        if self.max_top_k < self.default_top_k:
            raise ValueError("max_top_k must be at least default_top_k")
        if self.candidate_k < self.max_top_k:
            raise ValueError("candidate_k must be at least max_top_k")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            if (raw := env.get(f"TESSERA_{f.name.upper()}")) is not None:
                kind = type(f.default)
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**found)

    def top_k(self, k: int | None) -> int:
        return max(1, min(k or self.default_top_k, self.max_top_k))

    def fingerprint(self) -> str:
        """Changes when what an index holds would: the settings that chunks and embeddings depend on."""
        held = {k: v for k, v in asdict(self).items() if k.startswith(("chunk_", "min_chunk", "file_sum", "pdf_", "embedding_"))}
        return hashlib.blake2b(json.dumps(held, sort_keys=True, separators=(",", ":")).encode(), digest_size=20).hexdigest()
