"""A search index in a folder: documents, points and postings of collections, kept in step by syncs of single items."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.embed import Provider, embed_with
from tidepool.operators import gram_index
from tidepool.plans.search import CARRIED, Memory, searched
from tidepool.session import shared_folder
from tidepool.sources import parts
from tidepool.sources.points import ITEM, PointTable, text_key

#: Documents of a part of the document table.
PART_DOCS = 20_000
BY = ["collection_name", "part"]


@dataclass
class Synced:
    """What a sync did: texts embedded, and partitions of documents, points and postings that it rewrote."""

    embedded: int
    documents: int
    points: int
    postings: int


def whole(docs: DataFrame) -> DataFrame:
    """Documents with all columns that a search carries."""
    return docs.withColumns({c: F.lit(None).cast(kind) for c, kind in CARRIED.items() if c not in docs.columns})


@dataclass
class Collection:
    """The folder ``path``; ``make`` builds the provider that embeds texts and queries."""

    spark: SparkSession
    path: str
    make: Callable[[], Provider]

    @classmethod
    def create(cls, docs: DataFrame, path: str, make: Callable[[], Provider], text: str = "vector_text", part_docs: int = PART_DOCS) -> Collection:
        """docs: collection_name, doc_id, item_key, a text to embed and any of CARRIED; doc_id is unique in a collection."""
        spark, rows = docs.sparkSession, whole(docs)
        count = max(1, -(-rows.count() // part_docs))
        parts.write(rows.withColumn("part", parts.part_of(F.col("item_key"), count)), f"{path}/documents", BY, ["doc_id"])
        spark.createDataFrame([(count,)], "parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")
        self = cls(spark, path, make)
        held = self.documents()
        named = held.withColumn("__key", F.to_json(F.struct("collection_name", "doc_id")))
        shared_folder(spark)
        vectors = embed_with(named, make, text, "__key").checkpoint(eager=True)  # each text is embedded once
        PointTable.create(named.join(vectors, "__key").withColumn("text_key", text_key(F.col(text))), f"{path}/points")
        gram_index.write_index(self.sought(held), f"{path}/grams", text="__text", part_docs=part_docs)
        return self

    @staticmethod
    def sought(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", "item_key", searched().alias("__text"))

    def documents(self) -> DataFrame:
        return parts.live(self.spark, f"{self.path}/documents").drop("part")

    def points(self, probes: int | None = None) -> PointTable:
        return PointTable.open(self.spark, f"{self.path}/points", probes)

    def postings(self) -> DataFrame:
        return gram_index.read_index(self.spark, f"{self.path}/grams")

    def sync(self, docs: DataFrame, items: DataFrame, text: str = "vector_text") -> Synced:
        """docs in place of all documents of items (collection_name, item_key), in all three tables.

        Each table changes in one write. They change one after the other, and each is brought to the state that docs
        names, so a sync that stopped halfway is simply run again. Only texts that are new are embedded.
        """
        rows, items = whole(docs), items.select(*ITEM).distinct()
        count = self.spark.read.parquet(f"{self.path}/size").first()["parts"]
        here = parts.part_of(F.col("item_key"), count)
        documents = parts.replace(f"{self.path}/documents", rows.withColumn("part", here), items, BY, ITEM, ["doc_id"], places=items.withColumn("part", here))
        embedded, points = self.points().sync(rows, items, self.make, text)
        # Postings are those of all collections: an item's go and come as its documents stand now.
        now = self.documents().join(parts.few(items.select("item_key").distinct()), "item_key", "left_semi")
        return Synced(embedded, documents, points, gram_index.sync_index(f"{self.path}/grams", self.sought(now), items, text="__text"))

    def memory(self, collection: str, probes: int | None = None, **options) -> Memory:
        """Searches of one collection, exact or with ``probes`` cells."""
        docs = self.documents().where(F.col("collection_name") == collection)
        return Memory(docs, self.points(probes), self.make(), collection=collection, postings=self.postings(), **options)
