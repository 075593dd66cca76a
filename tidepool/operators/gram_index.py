"""An inverted index of letter trigrams, so that a substring search reads postings instead of all texts.

Documents are dealt by their item to parts of some PART_DOCS, and each part has its own postings, sorted by trigram in
small row groups: a hot trigram's list is split between all parts, a lookup reads the row groups of the trigrams it asks
for, and a sync rewrites the parts of the items that changed, nothing else. A term is sought by its rarest trigrams:
documents that hold all of them are its candidates, and only candidates' texts are read and scored, by the same score as a
scan. Terms shorter than a trigram can't be sought; with one among them the texts are scanned. Texts are cut in Arrow
batches, CUT_ROWS at a time, so long ones take time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.text import lowered
from tidepool.operators.retrieval import lexical_topk
from tidepool.sources import parts

LETTERS = 3
#: Documents of a part.
PART_DOCS = 20_000
#: Texts whose grams a task holds at once.
CUT_ROWS = 256
#: Grams that a term is sought by.
SOUGHT = 3


def postings(docs: DataFrame, count: int, text: str = "text", key: str = "doc_id", item: str = "item_key") -> DataFrame:
    """(part, of_item, gram, key): a row for each document and distinct gram of its text in lower case; the item as a hash of 64 bits."""
    of_item = F.coalesce(F.xxhash64(item), F.lit(0)).alias("of_item")
    texts = docs.select(F.pmod(of_item, F.lit(count)).cast("int").alias("part"), of_item, F.col(key), lowered(F.col(text)).alias("__low"))

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, CUT_ROWS):
                part = b.slice(at, CUT_ROWS)
                found = [set(map("".join, zip(*(low[i:] for i in range(LETTERS))))) for low in part.column("__low").to_pylist()]
                own = pa.array(np.repeat(np.arange(part.num_rows), [len(g) for g in found]))
                taken = {c: part.column(c).take(own) for c in ("part", "of_item", key)}
                yield pa.record_batch({"part": taken["part"], "of_item": taken["of_item"], "gram": pa.array([g for gs in found for g in gs], pa.string()), key: taken[key]})

    return texts.mapInArrow(cut, f"part int, of_item long, gram string, `{key}` {texts.schema[key].dataType.simpleString()}")


def write_index(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", item: str = "item_key", part_docs: int = PART_DOCS) -> None:
    """The index of all documents; how many parts it has is kept beside it."""
    count = max(1, -(-docs.count() // part_docs))
    docs.sparkSession.createDataFrame([(count,)], "parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")
    parts.write(postings(docs, count, text, key, item), f"{path}/postings", ["part"], ["gram", key])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parts.live(spark, f"{path}/postings")


def sync_index(path: str, docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_key") -> int:
    """The postings of docs in place of those of all documents of items (item); the number of parts rewritten."""
    spark = docs.sparkSession
    count = spark.read.parquet(f"{path}/size").first()["parts"]
    gone = items.select(F.coalesce(F.xxhash64(item), F.lit(0)).alias("of_item"))
    places = gone.select(F.pmod("of_item", F.lit(count)).cast("int").alias("part"))
    return parts.replace(f"{path}/postings", postings(docs, count, text, key, item), gone, ["part"], ["of_item"], ["gram", key], places=places)


def candidates(index: DataFrame, terms: Sequence[str], key: str = "doc_id") -> DataFrame | None:
    """(key) of the documents that may hold a term; None where a term is too short to be sought."""
    cut = {low: sorted({low[i : i + LETTERS] for i in range(len(low) - LETTERS + 1)}) for low in (t.lower() for t in terms)}
    if not cut or any(not g for g in cut.values()):
        return None
    # Equalities, each of which a row group's least and greatest gram can refute; a long list would be one wide range.
    among = lambda gs: reduce(lambda a, b: a | b, [F.col("gram") == g for g in gs])
    near = index.where(among(sorted({g for gs in cut.values() for g in gs})))
    counts = {r["gram"]: r["n"] for r in near.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # the query's grams
    out = None
    for gs in cut.values():
        rare = sorted(gs, key=lambda g: (counts.get(g, 0), g))[:SOUGHT]
        held = index.where(among(rare)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select(key)
        out = held if out is None else out.unionByName(held)
    return out.distinct()


def indexed_topk(docs: DataFrame, index: DataFrame, terms: Sequence[str], k: int, text: str = "text", key: str = "doc_id", order: Sequence[str] = ("doc_type", "item_key", "doc_index")) -> DataFrame:
    """As ``lexical_topk``, over candidates only."""
    found = candidates(index, terms, key)
    rows = docs if found is None else docs.join(found, key, "left_semi")
    return lexical_topk(rows, terms, k, text=F.col(text), order=order)
