"""Sharding into ranges of nearly equal bytes by sampled splitters.

Records are ordered by a 64-bit key: 34 bits of a hash of the text, 16 of a hash of doc_id, 14 of the record's place in
its input, so equal texts stand together, a hot text still spreads over a billion keys, and a record repeated under one
id (or none) over thousands. A sample of keys, drawn with chances in proportion to size, gives quantile splitters for many
more ranges than shards; ranges that turn out overfull are subdivided by new splitters sampled from them alone, or by
their middle key where the draws give none, until each is small enough or a single key. Exact bytes and rows of all
ranges are summed; a running sum in each range, on top of what all ranges before it hold, places each record, and shards
are cut where the bytes say.

Only splitters and totals of ranges come to the driver: a fixed number for a number of shards.

Defined results: a null text has no bytes, its record counts 16; repeated rows are records of their own, in any order
among themselves (they are equal); with fewer records than shards some shards are empty; an empty table gives no rows.
Further columns are kept by ``sharded`` but never read; one that is called like the shards' column is kept as
``<name>_given``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.tables import bounded, durable

SHARDS = 40
#: Bytes that each record counts besides its text.
RECORD_BYTES = 16
#: Ranges for each shard, keys drawn for each range, and the times the mean that a range may hold.
RANGES_PER_SHARD, DRAWS, OVERFULL = 8, 16, 2.0


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(RECORD_BYTES)


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def sort_key(text: Column, doc_id: Column, place: Column) -> Column:
    by_text = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 30), 30)
    by_id = F.shiftleft(F.shiftrightunsigned(F.xxhash64(doc_id), 48), 14)
    return by_text.bitwiseXOR(by_id).bitwiseXOR(F.shiftrightunsigned(F.xxhash64(place), 50))


PLACE = "__place"


def placed_rows(docs: DataFrame) -> DataFrame:
    """Docs with each row's place: the same each time that the same files are read."""
    return docs.withColumn(PLACE, F.monotonically_increasing_id())


def range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters that are at most the key, by a binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    steps = len(splitters).bit_length()
    array = f"array({','.join(f'{s}L' if s > -(1 << 63) else 'bigint(-9223372036854775808)' for s in splitters)})"
    return F.expr(
        f"aggregate(array({','.join(str(1 << k) for k in reversed(range(steps)))}), named_struct('at', 0, 'key', __key), "
        f"(acc, step) -> named_struct('at', if(acc.at + step <= {len(splitters)} and try_element_at(__cuts, least(acc.at + step, {len(splitters)})) <= acc.key, acc.at + step, acc.at), 'key', acc.key), acc -> acc.at)".replace("__cuts", array)
    ).alias("range")


def quantiles(draws: list[tuple[int, float]], ranges: int) -> list[int]:
    """Keys that cut weighted draws into so many parts of equal weight."""
    draws = sorted(draws)
    total, run, cuts = sum(w for _, w in draws), 0.0, []
    for key, weight in draws:
        while len(cuts) < ranges - 1 and run + weight > total * (len(cuts) + 1) / ranges:
            cuts.append(key)
            break
        run += weight
    return sorted(set(cuts))


def drawn(keyed: DataFrame, share: Column) -> list[tuple[int, float]]:
    """Keys drawn with chance share (the expected number of draws of a record), and the weight each stands for."""
    luck = F.pmod(F.xxhash64("key", "doc_id", F.lit(3)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = keyed.withColumn("share", share).where(luck < F.col("share")).select("key", F.greatest(F.lit(1.0), "share").alias("weight")).collect()
    return [(r["key"], r["weight"]) for r in rows]


def placed(keyed: DataFrame, shards: int) -> DataFrame:
    """Adds shard and slot to (doc_id, size, key, ...)."""
    spark = keyed.sparkSession
    ranges = shards * RANGES_PER_SHARD
    whole = keyed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not whole["rows"]:
        return keyed.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    mean = whole["bytes"] / ranges
    cuts = quantiles(drawn(keyed, F.col("size") * F.lit(ranges * DRAWS / whole["bytes"])), ranges)
    while True:
        measured = cut_at(keyed, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        over = {r["range"]: r for r in measured.where((F.col("bytes") > OVERFULL * mean) & (F.col("low") < F.col("high"))).collect()}  # of a fixed number of ranges
        if not over:
            break
        inside = cut_at(keyed, cuts).where(F.col("range").isin(*over))
        more: dict[int, list[tuple[int, float]]] = {k: [] for k in over}
        for key, weight in drawn(inside, F.col("size") * F.lit(DRAWS / mean)):
            more[sum(c <= key for c in cuts)].append((key, weight))
        new = set()
        for k, r in over.items():
            # A splitter must leave something below it; the middle does where no draw does.
            own = {c for c in quantiles(more[k], max(2, round(r["bytes"] / mean))) if r["low"] < c <= r["high"]}
            new |= own or {(r["low"] + r["high"]) // 2 + 1}
        cuts = sorted(set(cuts) | new)
    ranged = durable(cut_at(keyed, cuts))
    totals = sorted(ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect(), key=lambda r: r["range"])
    before, at_bytes, at_rows = [], 0, 0
    for r in totals:
        before.append((r["range"], at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + r["bytes"], at_rows + r["rows"]
    base = bounded(spark.createDataFrame(before, "range int, bytes_before long, rows_before long"))
    order = Window.partitionBy("range").orderBy("key", "doc_id", "size")
    run = ranged.withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("nth", F.row_number().over(order) - 1)
    # The shard that the middle of the record falls into.
    middle = F.coalesce("run", F.lit(0)) + F.col("bytes_before") + F.col("size") / 2
    settled = (
        run.join(base, "range")
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(at_bytes)).cast("int")))
        .withColumn("nth", F.col("nth") + F.col("rows_before"))
        .drop("range", "run", "bytes_before", "rows_before")
    )
    settled = durable(settled)
    first = bounded(durable(settled.groupBy("shard").agg(F.min("nth").alias("first"))))  # a row for each shard
    return settled.join(first, "shard").withColumn("slot", F.col("nth") - F.col("first")).drop("nth", "first")


def cut_at(keyed: DataFrame, cuts: list[int]) -> DataFrame:
    if not cuts:
        return keyed.withColumn("range", F.lit(0))
    return keyed.withColumnRenamed("key", "__key").withColumn("range", range_of(F.col("__key"), cuts).cast("int")).withColumnRenamed("__key", "key")


def keyed_rows(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return placed_rows(docs).select("doc_id", text_size(text).alias("size"), text_crc32(text).alias("text_crc32"), sort_key(text, F.col("doc_id"), F.col(PLACE)).alias("key"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs (doc_id, text)."""
    return placed(durable(keyed_rows(docs)), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int = SHARDS, column: str = "shard") -> DataFrame:
    """Docs with their shards: those of ``shard`` as ranges of (key, doc_id), given to rows where they are read.

    Only the first record of each shard comes to the driver. Rows that are equal in key and doc_id share a shard.
    """
    held = placed(durable(keyed_rows(docs)), shards)
    first = held.groupBy("shard").agg(F.min(F.struct("key", "doc_id")).alias("at")).orderBy("shard").collect()
    given = column
    while given in docs.columns:
        given += "_given"
    rows = docs.withColumnRenamed(column, given) if given != column else docs
    if not first:
        return rows.withColumn(column, F.lit(0))
    kind = docs.schema["doc_id"].dataType
    bounds = F.array(*[F.struct(F.lit(r["at"]["key"]).cast("long").alias("key"), F.lit(r["at"]["doc_id"]).cast(kind).alias("doc_id")) for r in first])
    own = F.struct(sort_key(F.col("text"), F.col("doc_id"), F.col(PLACE)).alias("key"), F.col("doc_id").alias("doc_id"))
    nth = F.greatest(F.lit(1), F.size(F.filter(bounds, lambda b: b <= own)))
    return placed_rows(rows).withColumn(column, F.get(F.array(*[F.lit(r["shard"]) for r in first]), nth - 1)).drop(PLACE)
