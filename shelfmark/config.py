"""Settings read once from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    warehouse: str = "spark-warehouse/shelfmark"
    index: str = "amazon_products"
    vector_index: str = "amazon_products_embeddings"
    alias: str = "products"
    vector_alias: str = "products_embeddings"
    replicas: int = 0
    backend: str = "lexical"
    backend_url: str = "http://localhost:8080"
    workers: int = 4
    embed_batch: int = 128
    document_prefix: str = ""
    query_prefix: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Values of SHELFMARK_<NAME>; unset ones keep their default, the backend's name is trimmed and lower-cased."""
        env = os.environ if env is None else env
        held = {}
        for name, field in cls.__dataclass_fields__.items():
            raw = env.get(f"SHELFMARK_{name.upper()}")
            if raw is not None:
                held[name] = int(raw) if field.type == "int" else raw
        if "backend" in held:
            held["backend"] = held["backend"].strip().lower()
        if "backend_url" in held:
            held["backend_url"] = held["backend_url"].rstrip("/")
        return cls(**held)
