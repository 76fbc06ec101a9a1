"""Parameters of the search engine, from code, the environment or the command line."""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    shards: int = 8
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    title_weight: float = 3.0
    abstract_weight: float = 1.5
    vector_weight: float = 0.75
    bm25_per_shard: int = 100
    vectors_per_shard: int = 50
    shortlist: int = 100
    page_size: int = 10
    max_pages: int = 10
    suggestions: int = 5
    max_edit_distance: int = 2
    min_prefix_length: int = 1
    cache_seconds: float = 3600.0
    dim: int = 64
    #: Cells of a shard to probe; none: as many as reach ``recall``, measured against a scan.
    probes: int | None = None
    recall: float = 0.95
    exact_vectors: bool = True
    query_block: int = 4096
    #: Documents of a shard that one task scores.
    doc_block: int = 65_536
    default_top_k: int = 10

    def weight(self, field: str) -> float:
        return {"title": self.title_weight, "abstract": self.abstract_weight}[field]


@dataclass(frozen=True)
class Settings:
    """Where a corpus and its index are, and how the index is built."""

    dataset: str = "papers.jsonl"
    output: str = "index"
    shards: int = 8
    max_docs: int = 0

    @classmethod
    def read(cls, arguments: Sequence[str] = (), environment: Mapping[str, str] = os.environ) -> Settings:
        """Options win over DATASET_PATH, INDEX_OUTPUT_DIR and NUM_SHARDS, which win over the defaults."""
        options = argparse.ArgumentParser(prog="paperloom")
        options.add_argument("--dataset", default=environment.get("DATASET_PATH", cls.dataset))
        options.add_argument("--output", default=environment.get("INDEX_OUTPUT_DIR", cls.output))
        options.add_argument("--shards", type=int, default=int(environment.get("NUM_SHARDS", cls.shards)))
        options.add_argument("--max-docs", type=int, default=cls.max_docs)
        found = cls(**vars(options.parse_args(list(arguments))))
        if found.shards < 1 or found.max_docs < 0:
            raise ValueError("shards have to be positive, max_docs not negative")
        return found
