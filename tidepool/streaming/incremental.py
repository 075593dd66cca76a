"""Incremental work by high-water marks, and the same as a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def before_mark(time: Column, key: Column, mark: str | None, ties: Iterable[str] | Column = ()) -> Column:
    """Whether a row is known already: older than the mark, or at it with a key among the ties. No mark or time: not.

    Many ties are joined beforehand, and come as a column that says whether a row is among them.
    """
    if mark is None:
        return F.lit(False)
    tied = ties if isinstance(ties, Column) else key.cast("string").isin(*map(str, ties)) if list(ties) else F.lit(False)
    return F.coalesce(F.when(time < F.lit(mark), True).when(time == F.lit(mark), tied).otherwise(False), F.lit(False))


def since(rows: DataFrame, time: str, key: str, mark: str | None, ties: Iterable[str] = ()) -> DataFrame:
    return rows.where(~before_mark(F.col(time), F.col(key), mark, list(ties)))


def next_mark(rows: DataFrame, time: str, key: str) -> DataFrame:
    """(mark, ties): the latest time and the keys that share it."""
    last = rows.agg(F.max(time).alias("mark"))
    return rows.join(last, rows[time] == last["mark"]).groupBy("mark").agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("ties"))


def changed(rows: DataFrame, seen: DataFrame, keys: list[str], signature: str = "signature") -> DataFrame:
    """Rows whose key and signature are not among the seen."""
    return rows.join(seen.select(*keys, signature), [*keys, signature], "left_anti")


def file_signature(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, signature, modificationTime): modification time and length of each file, without reading it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("signature"), "modificationTime").orderBy("modificationTime", "path")


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that a stream has now, in micro-batches, then stop; a restart goes on behind the checkpoint."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def backoff(base: float, failures: int, most: float) -> float:
    """Seconds to wait after so many failures in a row."""
    return min(most, base * 2 ** max(0, failures - 1))


def next_workers(now: int, most: int, errors: int, healthy: int) -> int:
    """Half the workers after three transient errors in a cycle, one more after three healthy cycles."""
    return max(1, now // 2) if errors >= 3 else min(most, now + 1) if healthy >= 3 else now


def progress(done: Column, total: Column) -> Column:
    """Percent with two digits, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(done.cast("double"), total) * 100, 2), F.lit(0.0))
