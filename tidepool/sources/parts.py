"""Tables in parts, of which a change rewrites those that it touches, in one write.

A table is a folder of Parquet partitions. ``replace`` takes the rows of some keys out and puts new ones in: it reads and
writes the touched partitions only, by a dynamic partition overwrite, so all kinds of rows that share a table change in
one commit, and a write that fails leaves the old rows. A touched partition also gets one marker row, so that one which
loses all its rows is rewritten as well; ``live`` leaves markers out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import shared_folder

#: Keys that a broadcast may hold.
FEW_KEYS = 200_000
MARK = "__mark"
#: Bytes of a row group: lookups prune by them.
ROW_GROUP = 8 << 20


def part_of(key: Column, parts: int) -> Column:
    """One of ``parts`` numbers for a key."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def few(keys: DataFrame) -> DataFrame:
    """Keys, marked for broadcast where their counted number is small; joined by a shuffle otherwise."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def write(rows: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = ()) -> None:
    """The whole table anew; hot parts are split between files."""
    dealt(rows, by, order).write.mode("overwrite").option("partitionOverwriteMode", "static").option("parquet.block.size", ROW_GROUP).partitionBy(*by).parquet(path)


def dealt(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    marked = rows if MARK in rows.columns else rows.withColumn(MARK, F.lit(None).cast("boolean"))
    return marked.hint("rebalance", *by).sortWithinPartitions(*by, *order)


def live(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows as they are now."""
    return spark.read.parquet(path).where(F.col(MARK).isNull()).drop(MARK)


def inside(touched: Sequence[tuple], by: Sequence[str]) -> Column:
    """Whether a row is of one of the partitions; Spark prunes all others. Those that differ in the last column only make one list."""
    lists: dict[tuple, list] = {}
    for t in touched:
        lists.setdefault(t[:-1], []).append(t[-1])
    each = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, head, strict=False)] + [F.col(by[-1]).isin(*last)]) for head, last in lists.items()]
    return reduce(lambda a, b: a | b, each)


def replace(path: str, new: DataFrame, gone: DataFrame, by: Sequence[str], keys: Sequence[str], order: Sequence[str] = (), only: Column | None = None, places: DataFrame | None = None) -> int:
    """New rows in place of those whose keys ``gone`` has (and for which ``only`` holds); the number of partitions rewritten.

    ``places`` has the partitions that the keys' rows stand in, where these follow from the keys; else their columns are
    searched for the keys. Partition columns and keys are never null. Only names of partitions come to the driver.
    """
    spark = new.sparkSession
    shared_folder(spark)
    new = new.checkpoint(eager=True)  # it, and the keys, may be read from the rows that go
    old, leaving = live(spark, path), few(gone.select(*keys).distinct().checkpoint(eager=True))
    reached = old if only is None else old.where(only)
    stood = reached.join(leaving, list(keys), "left_semi").select(*by) if places is None else places.select(*by)
    touched = [tuple(r) for r in stood.unionByName(new.select(*by)).distinct().collect()]
    if not touched:
        return 0
    near = old.where(inside(touched, by))
    if only is None:
        kept = near.join(leaving, list(keys), "left_anti")
    else:
        kept = near.where(~F.coalesce(only, F.lit(False))).unionByName(near.where(only).join(leaving, list(keys), "left_anti"))
    kinds = {f.name: f.dataType for f in old.schema.fields}
    marks = spark.createDataFrame(touched, ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in by)).withColumn(MARK, F.lit(True))
    rows = kept.withColumn(MARK, F.lit(None).cast("boolean")).unionByName(new.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    # The write reads the partitions that it replaces: they stay until all its files are written.
    dealt(rows, by, order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP).partitionBy(*by).parquet(path)
    spark.catalog.refreshByPath(path)
    return len(touched)
