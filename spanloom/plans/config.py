"""Configurations of retrieval runs, their identity, and the gate's policy."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import yaml

from spanloom.functions.identity import content_hash

#: Vector sizes of the models that configurations may name.
DIMENSIONS = {"BAAI/bge-small-en-v1.5": 384, "BAAI/bge-base-en-v1.5": 768, "BAAI/bge-large-en-v1.5": 1024}


class ConfigError(ValueError):
    """A configuration that cannot mean a run."""


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ConfigError(why)


@dataclass(frozen=True)
class Chunking:
    strategy: str = "fixed_token_window"
    chunk_size: int = 512
    chunk_overlap: int = 50
    tokenizer_id: str = "lexical"

    def __post_init__(self) -> None:
        _need(self.strategy == "fixed_token_window", f"unknown strategy {self.strategy}")
        _need(64 <= self.chunk_size <= 2048, "chunk_size is 64 to 2048")
        _need(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap is at least 0 and below chunk_size")

    @property
    def hash(self) -> str:
        return content_hash(asdict(self))


@dataclass(frozen=True)
class Embedding:
    model_id: str
    revision: str
    dimension: int
    normalize: bool = True
    query_prefix: str = ""

    def __post_init__(self) -> None:
        _need(self.dimension > 0, "dimension is above 0")
        _need(DIMENSIONS.get(self.model_id, self.dimension) == self.dimension, f"{self.model_id} has other vectors")


@dataclass(frozen=True)
class Lexical:
    backend: str
    top_n: int
    language: str = "english"
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        _need(self.backend in ("bm25", "pg_fts"), f"unknown backend {self.backend}")
        _need(self.top_n > 0 and self.k1 > 0 and 0 <= self.b <= 1, "top_n and k1 are above 0, b is 0 to 1")


@dataclass(frozen=True)
class Fusion:
    method: str = "rrf"
    k: int = 60

    def __post_init__(self) -> None:
        _need(self.method == "rrf" and self.k > 0, "fusion is rrf with k above 0")


@dataclass(frozen=True)
class Reranker:
    enabled: bool = False
    model_id: str | None = None
    revision: str | None = None
    top_n_in: int = 50

    def __post_init__(self) -> None:
        _need(self.top_n_in > 0, "top_n_in is above 0")
        _need(not self.enabled or bool(self.model_id and self.revision), "an enabled reranker has a pinned model")


@dataclass(frozen=True)
class Retrieval:
    name: str
    retrieval_mode: str
    top_k: int
    dense_top_n: int
    chunking: Chunking
    embedding: Embedding
    description: str = ""
    schema_version: int = 1
    lexical: Lexical | None = None
    fusion: Fusion | None = None
    reranker: Reranker = field(default_factory=Reranker)

    def __post_init__(self) -> None:
        _need(bool(self.name) and self.schema_version >= 1, "a configuration has a name and a schema version")
        _need(self.retrieval_mode in ("dense", "hybrid"), f"unknown mode {self.retrieval_mode}")
        _need(self.top_k > 0 and self.dense_top_n >= self.top_k, "dense_top_n is at least top_k, above 0")
        hybrid = self.retrieval_mode == "hybrid"
        _need(hybrid == (self.lexical is not None) and hybrid == (self.fusion is not None), "hybrid runs, and only they, have lexical and fusion settings")
        _need(not self.reranker.enabled or self.reranker.top_n_in >= self.top_k, "top_n_in is at least top_k")

    @property
    def config_hash(self) -> str:
        payload = asdict(self)
        return content_hash({k: v for k, v in payload.items() if k not in ("name", "description")})

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Retrieval:
        parts = {"chunking": Chunking, "embedding": Embedding, "lexical": Lexical, "fusion": Fusion, "reranker": Reranker}
        try:
            return cls(**{k: parts[k](**v) if k in parts and v is not None else v for k, v in raw.items()})
        except TypeError as error:
            raise ConfigError(str(error)) from error


@dataclass(frozen=True)
class GatePolicy:
    gated_configs: tuple[str, ...]
    max_absolute_drop: dict[str, float]
    primary_metric: str = "recall_at_10"
    require_golden_set_hash_match: bool = True
    require_corpus_hash_match: bool = True
    config_hash_mismatch: str = "warn"
    per_category: str = "report_only"

    def __post_init__(self) -> None:
        _need(bool(self.gated_configs), "a policy gates a configuration")
        _need(self.config_hash_mismatch in ("warn", "fail"), "config_hash_mismatch is warn or fail")
        _need(all(v >= 0 for v in self.max_absolute_drop.values()), "drops are at least 0")


def load_config(path: str | Path) -> Retrieval:
    path = Path(path)
    config = Retrieval.of(yaml.safe_load(path.read_text()))
    _need(config.name == path.stem, f"{path.name} names {config.name}")
    return config


def load_configs(folder: str | Path) -> dict[str, Retrieval]:
    """All configurations of a folder by name; none, or two that mean the same run, are an error."""
    found = [load_config(p) for p in sorted(Path(folder).glob("*.yaml")) if p.stem != "gate_policy"]
    _need(bool(found), f"no configuration in {folder}")
    _need(len({c.config_hash for c in found}) == len(found), "two configurations have one hash")
    return {c.name: c for c in found}


def load_policy(path: str | Path) -> GatePolicy:
    raw = yaml.safe_load(Path(path).read_text())
    return GatePolicy(**raw | {"gated_configs": tuple(raw["gated_configs"])})
