"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.tables import bounded, durable

#: Rows whose text is longer are taken into a sample only where a class has no shorter ones.
SAMPLE_CHARS = 20_000
#: Draws are cut to so many times the quota before they are ranked, and to so many more.
HEADROOM, SPARE = 2, 256


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def in_fold(doc_id: Column, n: int, k: int) -> Column:
    """Whether a row is of fold k; a row without an id is of none."""
    return F.coalesce(fold(doc_id, n) == k, F.lit(False))


def with_labels(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label, key, chars) of the documents that have a label; a shuffle of narrow rows only.

    A document with two labels is a row of each.
    """
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label")).distinct()
    return narrow(docs).join(named, "doc_id")


def narrow(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, key, chars) and more of rows with a text; key is a hash of the text."""
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("chars"), *more)


def labelled_sample(docs: DataFrame, labelled: DataFrame, per_class: int) -> list:
    """At most ``per_class`` distinct rows of each label, as (doc_id, text, label) rows on the driver.

    ``labelled`` has (doc_id, label, key, chars). Rows equal in id, text and label are one; the choice hangs on a hash of
    all three, so reruns agree and no id fills a quota by its copies. Classes are bounded in rows, not in number. The
    largest share of a class that can be needed is cut off by its hash before any ranking, so that no task ranks a class.
    """
    rows = labelled.groupBy("doc_id", "key", "label").agg((F.min("chars") > SAMPLE_CHARS).alias("long"))
    drawn = durable(rows.withColumn("draw", F.xxhash64("doc_id", "key", F.lit(17))))
    sizes = drawn.groupBy("label", "long").agg(F.count("*").alias("n"))
    # A quota of short rows is met by the smallest draws; draws are uniform over 64 bits.
    share = F.least(F.lit(1.0), (HEADROOM * per_class + SPARE) / F.col("n"))
    near = drawn.join(bounded(sizes), ["label", "long"]).where((F.col("draw") / F.lit(2.0**64) + 0.5) <= share)
    ranked = Window.partitionBy("label").orderBy("long", "draw", "doc_id", "key")
    chosen = durable(near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= per_class).select("doc_id", "key", "label"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = texts.join(bounded(chosen), ["doc_id", "key"]).groupBy("doc_id", "key", "label").agg(F.first("text").alias("text"))
    return sorted(found.select("doc_id", "text", "label").collect(), key=lambda r: (str(r["label"]), str(r["doc_id"]), r["text"]))
