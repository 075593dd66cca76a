"""Vector tables: (collection_name, doc_id, doc_type, item_key, embedding) and what is done to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.merges import replace_scope


def scroll(vectors: DataFrame, collection: str | None = None, doc_types: Sequence[str] = (), item_keys: Sequence[str] = ()) -> DataFrame:
    """Vectors of a collection, of given types and items; empty lists don't filter."""
    if collection is not None:
        vectors = vectors.where(F.col("collection_name") == collection)
    if doc_types:
        vectors = vectors.where(F.col("doc_type").isin(*doc_types))
    return vectors.where(F.col("item_key").isin(*item_keys)) if item_keys else vectors


def count(vectors: DataFrame, **scope) -> int:
    return scroll(vectors, **scope).count()


def reset(vectors: DataFrame, collection: str) -> DataFrame:
    """All collections but one."""
    return vectors.where(~F.col("collection_name").eqNullSafe(F.lit(collection)))


def misfits(vectors: DataFrame, size: int) -> DataFrame:
    """(collection_name, n): vectors of another length than a collection is made for."""
    wrong = F.col("embedding").isNull() | (F.size("embedding") != size)
    return vectors.where(wrong).groupBy("collection_name").agg(F.count("*").alias("n"))


def copied(vectors: DataFrame, source: str, target: str, doc_types: Sequence[str] = (), item_keys: Sequence[str] = ()) -> DataFrame:
    """Vectors with a collection's copied to another; what the target has of the copied scope goes first."""
    scope = {"doc_types": doc_types, "item_keys": item_keys}
    new = scroll(vectors, source, **scope).withColumn("collection_name", F.lit(target))
    gone = scroll(vectors, target, **scope).select("collection_name", "doc_id")
    return replace_scope(vectors, new, gone, ["collection_name", "doc_id"])


def next_items(docs: DataFrame, start_after: str | None = None, limit: int | None = None) -> DataFrame:
    """The next item keys of a pass that can be resumed: those behind a key, in order."""
    keys = docs.select("item_key").distinct()
    keys = keys if start_after is None else keys.where(F.col("item_key") > start_after)
    return keys.orderBy("item_key") if limit is None else keys.orderBy("item_key").limit(limit)


def replaced_items(vectors: DataFrame, new: DataFrame, doc_types: Sequence[str] = ()) -> DataFrame:
    """New vectors in place of the old of their collection and item (and of the given types only)."""
    keys = ["collection_name", "item_key"]
    if not doc_types:
        return replace_scope(vectors, new, new, keys)
    touched = vectors.where(F.col("doc_type").isin(*doc_types))
    return vectors.where(~F.col("doc_type").isin(*doc_types)).unionByName(replace_scope(touched, new, new, keys))
