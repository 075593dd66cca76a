"""Joins that bring context to hits: neighbours by index, by ids and by time, timeline hints, display records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours_by_index(hits: DataFrame, atoms: DataFrame, reach: int = 1) -> DataFrame:
    """Atoms of the hit's item at most ``reach`` places away, itself included; hits have (hit_id, item_key, doc_index)."""
    a = atoms.select(F.col("item_key").alias("a_item"), F.col("doc_index").alias("a_index"), F.col("text").alias("a_text"))
    near = (F.col("item_key") == F.col("a_item")) & F.col("a_index").between(F.greatest(F.lit(0), F.col("doc_index") - reach), F.col("doc_index") + reach)
    return hits.join(a, near).select("hit_id", "item_key", "doc_index", F.col("a_index").alias("neighbour_index"), F.col("a_text").alias("neighbour_text"))


def neighbours_by_ids(hits: DataFrame, docs: DataFrame, ids: str = "atom_ids", first: int = 8, most: int = 6) -> DataFrame:
    """Documents named by the first ids of a hit, in id order, ``most`` of them."""
    wanted = hits.select("hit_id", F.explode(F.array_sort(F.array_distinct(F.slice(ids, 1, first)))).alias("doc_id"))
    nth = F.row_number().over(Window.partitionBy("hit_id").orderBy("doc_id"))
    return wanted.join(docs, "doc_id").withColumn("nth", nth).where(F.col("nth") <= most)


def gap(anchor: Column, start: Column, end: Column) -> Column:
    """Distance of an anchor to the nearer end of an interval."""
    return F.least(F.abs(start - anchor), F.abs(end - anchor))


def neighbours_by_time(hits: DataFrame, atoms: DataFrame, reach: int = 24_000, most: int = 4, width: int | None = None) -> DataFrame:
    """The ``most`` atoms of the item that are nearest to a hit's anchor, within reach.

    hits: (hit_id, item_key, anchor_ms); atoms: (atom_id, item_key, start_ms, end_ms). Atoms stand under each time
    bucket that they touch once widened by reach, so the join has an equality on item and bucket, a hot item included.
    """
    size = width or 2 * reach
    bucket = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    h = hits.select("hit_id", "item_key", "anchor_ms", bucket(F.col("anchor_ms")).alias("bucket"))
    a = atoms.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()).withColumn("bucket", F.explode(F.sequence(bucket(F.col("start_ms") - reach), bucket(F.col("end_ms") + reach))))
    over = (F.col("start_ms") <= F.col("anchor_ms") + reach) & (F.col("end_ms") >= F.col("anchor_ms") - reach)
    distance = gap(F.col("anchor_ms"), F.col("start_ms"), F.col("end_ms"))
    near = h.join(a, ["item_key", "bucket"]).where(over).withColumn("distance", distance).where(F.col("distance") <= reach)
    nth = F.row_number().over(Window.partitionBy("hit_id").orderBy("distance", "start_ms", "atom_id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= most).drop("bucket")


def timeline_hints(atoms: DataFrame, notes: DataFrame, reach: int = 12_000) -> DataFrame:
    """(atom_id, note_ids, note_titles): notes of the item whose anchor is within reach of either end of an atom.

    An atom's notes are gathered in one row: those of one item within seconds, a handful in practice.
    """
    size = 2 * reach
    bucket = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    near_ends = F.array_distinct(F.flatten(F.array(*[F.sequence(bucket(F.col(c) - reach), bucket(F.col(c) + reach)) for c in ("start_ms", "end_ms")])))
    a = atoms.select("atom_id", "item_key", "start_ms", "end_ms", F.explode(near_ends).alias("bucket"))
    n = notes.where(F.col("anchor_ms").isNotNull()).withColumn("bucket", bucket(F.col("anchor_ms")))
    hit = (F.abs(F.col("start_ms") - F.col("anchor_ms")) <= reach) | (F.abs(F.col("end_ms") - F.col("anchor_ms")) <= reach)
    found = a.join(n, ["item_key", "bucket"]).where(hit)
    listed = F.array_sort(F.collect_list(F.struct("anchor_ms", "note_id", "title")))
    return found.groupBy("atom_id").agg(listed.alias("x")).select(
        "atom_id", F.col("x.note_id").alias("note_ids"), F.filter("x.title", lambda t: F.coalesce(t, F.lit("")) != "").alias("note_titles")
    )


def overlapping(rows: DataFrame, keys: Sequence[str], name: str, start: str, end: str, least: int = 1000) -> DataFrame:
    """(keys, name, other): pairs of rows of equal keys whose closed intervals overlap, both ways round.

    An interval has the level of its length, doubling from ``least``; at its own level it touches two buckets at most, and
    it also stands in the buckets of the longer levels that occur, some forty at most. Of a pair the longer one meets the
    other in the bucket of the later start, so a long interval is never cut into the buckets of short ones.
    """
    length = F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("double")
    own = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(least)))).cast("int")
    held = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))).select(*keys, name, start, end, own.alias("level"))
    levels = held.select("level").distinct().withColumnRenamed("level", "at_level")  # some forty rows at most
    width = lambda level: F.lit(least) * F.pow(F.lit(2.0), level).cast("long")
    bucket = lambda c, level: F.floor(c / width(level)).cast("long")
    placed = lambda df, level: df.withColumn("bucket", F.explode(F.sequence(bucket(F.col(start), F.col(level)), bucket(F.col(end), F.col(level)))))
    longer = placed(held.withColumn("at_level", F.col("level")), "at_level").drop("level")
    guests = held.join(F.broadcast(levels), F.col("at_level") >= F.col("level"))
    guests = placed(guests, "at_level").select(*keys, "at_level", "bucket", F.col(name).alias("other"), F.col(start).alias("o_start"), F.col(end).alias("o_end"), F.col("level").alias("o_level"))
    met = longer.join(guests, [*keys, "at_level", "bucket"])
    over = (F.col(name) != F.col("other")) & (F.col("o_start") <= F.col(end)) & (F.col("o_end") >= F.col(start)) & (bucket(F.greatest(start, "o_start"), F.col("at_level")) == F.col("bucket"))
    pairs = met.where(over)
    # Rows of one level meet both ways round already.
    turned = pairs.where(F.col("o_level") < F.col("at_level")).select(*keys, F.col("other").alias(name), F.col(name).alias("other"))
    return pairs.select(*keys, name, "other").unionByName(turned)


def lookup_ordered(docs: DataFrame, ids: Sequence, key: str = "doc_id") -> DataFrame:
    """Documents in the order of the given ids, with that position as ``pos``."""
    kind = docs.schema[key].dataType
    wanted = docs.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i).cast(kind) for i in ids])).alias("pos", key))
    return wanted.join(docs, key).orderBy("pos")


def display_merge(rows: DataFrame, files: DataFrame, columns: Sequence[str], key: str = "item_key") -> DataFrame:
    """Rows overlaid by normalised files: a file's value stands where it isn't NULL or empty."""
    over = files.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    merged = {c: F.coalesce(F.nullif(F.col(f"__{c}").cast("string"), F.lit("")), F.col(c).cast("string")) for c in columns}
    return rows.join(over, key, "left").withColumns(merged).drop(*[f"__{c}" for c in columns])
