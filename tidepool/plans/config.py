"""Settings of an index: what it is made from, and by whom texts are embedded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidepool.functions.embed import Provider, provider
from tidepool.operators.merges import index_candidates
from tidepool.sources.readers import alias_map


@dataclass(frozen=True)
class IndexConfig:
    """``summary_mode`` is ``none`` (by rule) or ``writer``; with ``summary_fallback_allowed`` rules stand in for a writer that fails."""

    collection: str = "main"
    embedding_provider: str = "hash"
    embedding_dimension: int = 256
    embedding_batch: int = 64
    alias_map_path: str | None = None
    summary_mode: str = "none"
    summary_fallback_allowed: bool = False
    eligible_only: bool = True
    require_transcript: bool = True
    official_owner: str = "official"

    def __post_init__(self) -> None:
        if self.summary_mode not in ("none", "writer"):
            raise ValueError(f"unknown summary mode: {self.summary_mode}")
        if self.embedding_dimension < 8 or self.embedding_batch < 1:
            raise ValueError("embedding_dimension is 8 at least, embedding_batch 1")

    def make(self) -> Callable[[], Provider]:
        """Builds the provider, once for each task."""
        name, dim = self.embedding_provider, self.embedding_dimension
        return lambda: provider(name, dim=dim)

    def aliases(self, spark: SparkSession, defaults: dict[str, str] | None = None) -> dict[str, str]:
        """The aliases of the map's file over the defaults; the file is small."""
        if not self.alias_map_path:
            return alias_map(None, defaults)
        return alias_map("\n".join(r["value"] for r in spark.read.text(self.alias_map_path).collect()), defaults)

    def candidates(self, items: DataFrame, transcripts: DataFrame, title_docs: DataFrame, since: str | None = None) -> DataFrame:
        """Items to index by these settings."""
        return index_candidates(items, transcripts, title_docs, since, self.require_transcript, self.official_owner if self.eligible_only else None)

    def count_eligible(self, items: DataFrame, transcripts: DataFrame, title_docs: DataFrame) -> int:
        return self.candidates(items, transcripts, title_docs).count()
