"""Settings of the operators, checked when made: from defaults, a mapping, and environment variables, the later ones first."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ledgerleaf.operators import chunks, text, vectors


@dataclass
class Chunking:
    target: int = 4000
    overlap_chars: int = 400
    least: int = 400
    most: int = 6000

    def __post_init__(self) -> None:
        if not 0 <= self.overlap_chars < self.target or not self.least <= self.target <= self.most:
            raise ValueError("overlap must be below the target, and least <= target <= most")


@dataclass
class Search:
    metric: str = "cosine"
    top_k: int = 10
    threshold: float | None = None

    def __post_init__(self) -> None:
        if self.metric not in ("cosine", "dot", "euclid") or self.top_k < 1:
            raise ValueError("metric is cosine, dot or euclid, and top_k positive")


@dataclass
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    search: Search = field(default_factory=Search)
    min_table_confidence: float = 0.3


def _read(value: str) -> object:
    low = value.strip().lower()
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    if "," in value:
        return [_read(x) for x in value.split(",")]
    try:
        return json.loads(low)
    except ValueError:
        return value


def _made(kind: type, values: Mapping[str, object]) -> object:
    known = {f.name: f for f in dataclasses.fields(kind)}
    if odd := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    parts = {"chunking": Chunking, "search": Search} if kind is Config else {}
    return kind(**{k: _made(parts[k], v) if k in parts else v for k, v in values.items()})


def load(values: Mapping[str, object] | None = None, prefix: str = "LEDGERLEAF_", environment: Mapping[str, str] | None = None) -> Config:
    """values, overridden by variables such as LEDGERLEAF_SEARCH__TOP_K=5."""
    merged = {k: dict(v) if isinstance(v, Mapping) else v for k, v in (values or {}).items()}
    for name, value in (os.environ if environment is None else environment).items():
        if name.startswith(prefix):
            *path, last = name.removeprefix(prefix).lower().split("__")
            place = merged
            for p in path:
                place = place.setdefault(p, {})
            place[last] = _read(value)
    return _made(Config, merged)


def chunked(docs: DataFrame, config: Config) -> DataFrame:
    c = config.chunking
    return chunks.chunk_texts(docs, chunks.Sizes(c.target, c.overlap_chars, c.least, c.most))


def searched(rows: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """Every match at a threshold or above; without one the top_k best."""
    s = config.search
    return vectors.search(rows, queries, k=s.top_k if s.threshold is None else None, threshold=s.threshold, metric=s.metric)


def typed_tables(tables: DataFrame, kind: str, config: Config) -> DataFrame:
    return text.of_type(tables, kind, config.min_table_confidence)
