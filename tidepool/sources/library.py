"""A catalogue's items, media jobs and text chunks as one table, so that an item is replaced with all of them in one write.

The table is partitioned by kind (item, job, chunk) and by a bucket of the item; a row has its item's key, its own key,
where it comes from (chunks), and its columns in the struct of its kind. A snapshot of items brings their descriptions,
jobs and content chunks: what vanished goes, jobs that are still there keep their state, chunks of other sources (a
transcript's) stay, and other items are neither read nor written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.sources import parts

BY = ["kind", "bucket"]
#: Where a snapshot's own chunks come from.
CONTENT = "content"
#: Items of a bucket.
BUCKET_ITEMS = 20_000
ITEM, JOB, CHUNK = "item", "job", "chunk"


def packed(rows: DataFrame, kind: str, key: str, origin: Column | None = None) -> DataFrame:
    """(kind, item_key, key, origin and a struct of the kind's name) of one kind's rows."""
    return rows.select(F.lit(kind).alias("kind"), "item_key", F.col(key).cast("string").alias("key"), (F.lit(None) if origin is None else origin).cast("string").alias("origin"), F.struct("*").alias(kind))


@dataclass
class Library:
    """``state`` names the columns of a job that a snapshot doesn't overwrite."""

    spark: SparkSession
    path: str
    state: tuple[str, ...]
    buckets: int

    @classmethod
    def create(cls, items: DataFrame, jobs: DataFrame, chunks: DataFrame, path: str, state: tuple[str, ...], bucket_items: int = BUCKET_ITEMS) -> Library:
        """items (item_key, ...), jobs (item_key, job_id, ...) and chunks (item_key, chunk_id, source, ...)."""
        self = cls(items.sparkSession, path, state, max(1, -(-items.count() // bucket_items)))
        parts.write(self._rows(items, jobs, chunks), path, BY, ["item_key", "key"])
        return self

    def _rows(self, items: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
        kinds = (packed(items, ITEM, "item_key"), packed(jobs, JOB, "job_id"), packed(chunks, CHUNK, "chunk_id", F.col("source")))
        out = kinds[0]
        for rows in kinds[1:]:
            out = out.unionByName(rows, allowMissingColumns=True)
        return out.withColumn("bucket", parts.part_of(F.col("item_key"), self.buckets))

    def _of(self, kind: str) -> DataFrame:
        return parts.live(self.spark, self.path).where(F.col("kind") == kind).select(f"{kind}.*")

    def items(self) -> DataFrame:
        return self._of(ITEM)

    def jobs(self) -> DataFrame:
        return self._of(JOB)

    def chunks(self) -> DataFrame:
        return self._of(CHUNK)

    def replace(self, items: DataFrame, jobs: DataFrame, chunks: DataFrame) -> int:
        """The snapshot of items in place of the one before, all three kinds in one write; partitions rewritten.

        Jobs and chunks are those of the given items. A job's state columns are taken from the job of the same id and
        item, where there is one. The write replaces whole partitions behind staged files, so one that fails while it
        computes leaves all three kinds as they were.
        """
        named = items.select("item_key").distinct().checkpoint(eager=True)
        held = self.jobs().join(parts.few(named), "item_key", "left_semi").select("item_key", "job_id", F.lit(True).alias("__held"), *[F.col(c).alias(f"__{c}") for c in self.state])
        # A state that was cleared stays cleared: the old job's columns count as they are.
        kept = jobs.join(held, ["item_key", "job_id"], "left").withColumns({c: F.when(F.col("__held"), F.col(f"__{c}")).otherwise(F.col(c)) for c in self.state}).select(*jobs.columns)
        own = (F.col("kind") != CHUNK) | (F.col("origin") == CONTENT)
        bucket = parts.part_of(F.col("item_key"), self.buckets)
        places = named.select(F.explode(F.array(*[F.lit(k) for k in (ITEM, JOB, CHUNK)])).alias("kind"), bucket.alias("bucket"))
        return parts.replace(self.path, self._rows(items, kept, chunks.where(F.col("source") == CONTENT)), named, BY, ["item_key"], ["item_key", "key"], own, places)

    def replace_chunks(self, chunks: DataFrame, source: str) -> int:
        """Chunks of one source in place of those that their items have of it, as when a transcript is saved."""
        mine = chunks.where(F.col("source") == source)
        rows = packed(mine, CHUNK, "chunk_id", F.col("source")).withColumn("bucket", parts.part_of(F.col("item_key"), self.buckets))
        own = (F.col("kind") == CHUNK) & (F.col("origin") == source)
        named = mine.select("item_key").distinct()
        places = named.select(F.lit(CHUNK).alias("kind"), parts.part_of(F.col("item_key"), self.buckets).alias("bucket"))
        return parts.replace(self.path, rows, named, BY, ["item_key"], ["item_key", "key"], own, places)
