"""Reading the tables that the queries of this subpackage run over, and cutting lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.session import shared_folder, spread

#: Rows of a small table that a broadcast may hold.
SMALL_ROWS = 200_000
#: Copies that one task makes of one row.
DEALT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few; left to a shuffled join otherwise."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Cuts lineage with a Parquet table, in the shared folder if no place is named."""
    at = at or place(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def place(spark: SparkSession) -> str:
    """A place for a table in the shared folder."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, at: str) -> None:
    """Deletes a stored table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held(c: Column, kind: T.DataType) -> Column:
    """A column as something that can be hashed: maps can't."""
    return F.to_json(F.struct(c.alias("v"))) if "map<" in kind.simpleString() or "variant" in kind.simpleString() else c


def row_keys(docs: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two hashes, 96 bits together, that tell rows apart by the named columns (all of them by default); never null."""
    fields = [f for f in docs.schema.fields if columns is None or f.name in columns]
    parts = [x for f in fields for x in (held(F.col(f"`{f.name}`"), f.dataType), F.col(f"`{f.name}`").isNull())]
    return [F.xxhash64(*parts).alias("__a"), F.hash(*parts).alias("__b")]


def distinct_rows(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Docs with their keys __a and __b, one row of those that are equal in the named columns.

    Equal rows are merged in each task before the shuffle, so a hot row travels once from each; whole rows travel once
    at most, and what is joined by the keys afterwards finds them in place.
    """
    keyed = docs.select("*", *row_keys(docs, columns))
    return keyed.dropDuplicates(["__a", "__b"])


def dealt(rows: DataFrame, times: Column, nth: str, by: list[str], counts: DataFrame) -> DataFrame:
    """Rows as often as times says, numbered from 1; more than DEALT copies are made in blocks, dealt to tasks by ``by``.

    ``counts`` has times at hand without the rows: where none is above DEALT, rows are read once.
    """
    few = rows.where(times <= DEALT).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"), F.lit(1).cast("long"))))
    if counts.where(times > DEALT).isEmpty():
        return few
    blocks = rows.where(times > DEALT).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / F.lit(DEALT)).cast("long"))))
    blocks = blocks.repartition(*by, "__block")
    many = blocks.withColumn(nth, F.explode(F.sequence(F.col("__block") * DEALT + 1, F.least(times.cast("long"), (F.col("__block") + 1) * DEALT)))).drop("__block")
    return few.unionByName(many)
