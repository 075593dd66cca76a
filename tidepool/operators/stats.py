"""Counts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.streaming.incremental import progress


def grouped_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of each value of the first key, by the others too; those without a value aren't counted."""
    return rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))


def trimmed_counts(rows: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Counts of trimmed non-blank values, most frequent first, then by name in lower case."""
    out = rows.withColumn(key, F.trim(key)).where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower(key), key)
    return out if limit is None else out.limit(limit)


def member_counts(rows: DataFrame, members: Column, limit: int = 0) -> DataFrame:
    """Counts of the stripped members of an array column, most frequent first, ties by name; limit 0 means all."""
    each = rows.select(F.explode(members).alias("name")).select(F.trim("name").alias("name")).where("name <> ''")
    out = each.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")
    return out.limit(limit) if limit else out


def hours(rows: DataFrame, seconds: str, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.round(F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600.0, 2).alias("hours"))


def document_frequency(rows: DataFrame, terms: Column, limit: int = 2000) -> DataFrame:
    """In how many rows each term stands; the ``limit`` most frequent, ties by term."""
    each = rows.select(F.explode(F.array_distinct(terms)).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(limit)


def pipeline_report(jobs: DataFrame) -> DataFrame:
    """Download and transcript totals of media jobs, and their percentages."""
    n = lambda c: F.count(F.when(c, 1))
    done = n(F.col("status").isin("downloaded", "unsupported"))
    spoken = n(F.col("transcript_status") == "completed")
    return jobs.agg(
        F.count("*").alias("total"), done.alias("download_done"), n(F.col("status").isin("pending", "error")).alias("download_remaining"), progress(done, F.count("*")).alias("download_percent"),
        spoken.alias("transcript_done"), n(F.col("transcript_status").isin("pending", "error", "submitted")).alias("transcript_remaining"), progress(spoken, F.count("*")).alias("transcript_percent"),
    )


def filter_options(counts: DataFrame, selected: Sequence[str] = (), name: str = "name", count: str = "n", collation: str = "zh") -> DataFrame:
    """Options of a filter: the selected first, then by falling count, then by name as a reader of the language expects.

    Adds ``selected``; counts are those of grouped names, as many as there are options.
    """
    chosen = F.coalesce(F.col(name).isin(*selected), F.lit(False)) if selected else F.lit(False)
    return counts.withColumn("selected", chosen).orderBy(F.desc("selected"), F.desc(count), F.collate(F.col(name), collation), name)
