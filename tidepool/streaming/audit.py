"""A log of queries that were asked, appended once each however often a batch is run, and rotated by size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a log before it is rotated, and how many of that size are kept behind it.
MOST_BYTES, KEPT = 10 * 1024 * 1024, 5
ENTRY = (
    "timestamp string, mode string, query string, scope string, `limit` int, doc_types array<string>, categories array<string>, participants array<string>, status string, result_count int, client_ip string, "
    "forwarded_for string, host string, referer string, user_agent string, error string"
)


def client_ip(forwarded_for, real_ip, peer):
    """The first forwarded address, else the real one, else the peer's, as a Column."""
    first = F.trim(F.split(F.trim(F.coalesce(forwarded_for, F.lit(""))), ",")[0])
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(F.coalesce(real_ip, F.lit(""))), F.lit("")), peer)


def append(path: str, most_bytes: int = MOST_BYTES, kept: int = KEPT) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is a folder of its number, so running it again replaces it; old folders go beyond the size."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path)
        rotate(batch.sparkSession, path, most_bytes * (kept + 1))

    return apply


def sizes(spark: SparkSession, path: str) -> list[tuple[int, int, object]]:
    """(batch, bytes, place) of the log's batches, by number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return sorted(((int(p.getName()[6:]), files.getContentSummary(p).getLength(), p) for p in found), key=lambda x: x[0])


def rotate(spark: SparkSession, path: str, most: int) -> int:
    """Deletes the oldest batches until the others have so many bytes at most; the newest stays. How many went."""
    held = sizes(spark, path)
    total, gone = sum(n for _, n, _ in held), 0
    for _, n, place in held[:-1]:
        if total <= most:
            break
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        total, gone = total - n, gone + 1
    return gone


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The log's entries, oldest batch first."""
    return spark.read.schema(f"{ENTRY}, batch bigint").json(path).orderBy("batch", "timestamp")
