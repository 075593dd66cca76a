"""Point tables: vectors beside what searches filter by, stored by collection and cell of an inverted-file index.

A search reads one collection's partitions, pushes filters on type and category down to the files, and ranks what is left:
no join and no shuffle of vectors comes before the top-k. An approximate search reads the cells nearest to the query. How
many it needs under a filter is found from the filtered rows of each cell, counted without reading a vector: the nearest
cells are taken until ``probes`` of them hold rows that pass the filter, and these hold REACH times the rows asked for, so
a narrow filter looks further instead of finding less.

``sync`` embeds only documents whose text is new, and rewrites the cells that changed items touch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.embed import Provider, embed_with
from tidepool.operators import ann
from tidepool.operators.retrieval import nearest, payload_filter, vector_topk
from tidepool.session import shared_folder, spread
from tidepool.sources import parts
from tidepool.sources.sinks import point_id

BY = ["collection_name", "cell"]
ITEM = ["collection_name", "item_key"]
#: Columns of a point and their types; doc_id keeps its own.
PAYLOAD = {"item_key": "string", "doc_type": "string", "category": "string", "users": "array<string>", "text_key": "string", "embedding": "array<float>"}
#: Rows that pass the filter, for each row asked for, in the cells that an approximate search reads.
REACH = 8


def text_key(text: Column) -> Column:
    """What tells whether a text was embedded before."""
    return F.md5(F.coalesce(text, F.lit("")))


@dataclass
class PointTable:
    spark: SparkSession
    path: str
    cells: ann.Cells
    #: Cells with rows that an approximate search reads at least; None searches exactly.
    probes: int | None = None

    @classmethod
    def create(cls, points: DataFrame, path: str, cells: int | None = None, probes: int | None = None) -> PointTable:
        """points: collection_name, doc_id, embedding and any of PAYLOAD. Those without a vector are refused."""
        whole, spark = shaped(points), points.sparkSession
        fitted = ann.fit(whole, cells=cells)
        rows = [(k, [float(x) for x in c]) for k, c in enumerate(fitted.centroids)]  # ann.MOST_CELLS at most
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        parts.write(ann.indexed(whole, fitted), f"{path}/points", BY, ["doc_type", "doc_id"])
        return cls(spark, path, fitted, probes)

    @classmethod
    def open(cls, spark: SparkSession, path: str, probes: int | None = None) -> PointTable:
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        return cls(spark, path, ann.Cells(np.array([r["centroid"] for r in rows], float)), probes)

    def rows(self, collection: str | None = None, doc_types: Sequence[str] = (), categories: Sequence[str] = (), participants: Sequence[str] = ()) -> DataFrame:
        """Points of a collection that pass the filters."""
        points = parts.live(self.spark, f"{self.path}/points")
        if collection is not None:
            points = points.where(F.col("collection_name") == collection)
        return payload_filter(points, doc_types, categories, participants)

    # Searches.

    def held(self, rows: DataFrame) -> dict[int, int]:
        """How many rows each cell has; ann.MOST_CELLS numbers at most."""
        return {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}

    def search(self, query: Sequence[float], k: int, probes: int | None = None, **scope) -> DataFrame:
        """The k points of the highest cosine, as points with a score; ties by doc_id."""
        rows, probes = self.rows(**scope), probes or self.probes
        if probes is not None:
            rows = rows.where(F.col("cell").isin(*reached(self.cells.ranked(query), self.held(rows), probes, k)))
        return vector_topk(rows, query, k)

    def search_many(self, queries: DataFrame, k: int, probes: int, digits: int = 9, **scope) -> DataFrame:
        """(query_id, doc_id, score, nth) for queries (query_id, q): each meets the points of its cells."""
        rows = self.rows(**scope)
        held, centroids = self.held(rows), self.cells.centroids

        @F.pandas_udf("array<int>")
        def near(q: pd.Series) -> pd.Series:
            order = np.argsort(-(np.stack(q.to_numpy()) @ centroids.T), axis=1, kind="stable")
            return pd.Series([reached(line.tolist(), held, probes, k) for line in order])

        asked = spread(queries.select("query_id", "q")).select("query_id", "q", F.explode(near("q")).alias("cell"))
        return nearest(rows, asked, k, digits=digits, on=["cell"])

    def nearest(self, queries: DataFrame, k: int, **scope) -> DataFrame:
        """(query_id, doc_id): the true k nearest under the filters, by brute force; kept, as they are compared more than once."""
        shared_folder(self.spark)
        return nearest(self.rows(**scope), queries, k).select("query_id", "doc_id").checkpoint(eager=True)

    def recall(self, queries: DataFrame, k: int, probes: int, truth: DataFrame | None = None, **scope) -> float:
        """Share of the true k nearest under the filters that an approximate search finds."""
        truth = self.nearest(queries, k, **scope) if truth is None else truth
        found = self.search_many(queries, k, probes, **scope).select("query_id", "doc_id", F.lit(1).alias("hit"))
        n, hit = truth.join(found, ["query_id", "doc_id"], "left").agg(F.count("*"), F.count("hit")).first()
        return hit / n if n else 1.0

    def tuned(self, queries: DataFrame, k: int, least: float = 0.9, **scope) -> PointTable:
        """The table with the fewest probes, doubling from one, whose recall on ann.MEASURED queries reaches the least.

        It is measured on REACH times k neighbours: behind a filter that leaves that share of the rows, the k nearest are
        as far off as these. Narrower filters read on by the rule of ``reached``.
        """
        shared_folder(self.spark)
        asked, probes = queries.orderBy("query_id").limit(ann.MEASURED).checkpoint(eager=True), 1
        truth = self.nearest(asked, REACH * k, **scope)
        while self.recall(asked, REACH * k, probes, truth, **scope) < least and probes < len(self.cells.centroids):
            probes = min(2 * probes, len(self.cells.centroids))
        return PointTable(self.spark, self.path, self.cells, probes)

    # Upkeep.

    def upsert(self, new: DataFrame, doc_types: Sequence[str] = ()) -> int:
        """New points in place of all of their items (of the given types only); the number of cells rewritten."""
        return self.replace(new, new, doc_types)

    def replace(self, new: DataFrame, items: DataFrame, doc_types: Sequence[str] = ()) -> int:
        """New points in place of all points of items (collection_name, item_key)."""
        only = F.col("doc_type").isin(*doc_types) if doc_types else None
        return parts.replace(f"{self.path}/points", ann.indexed(shaped(new), self.cells), items, BY, ITEM, ["doc_type", "doc_id"], only)

    def sync(self, docs: DataFrame, items: DataFrame, make: Callable[[], Provider], text: str = "vector_text") -> tuple[int, int]:
        """Documents (collection_name, doc_id, item_key, doc_type, category, users and a text) in place of all points of items.

        Texts that a point of the same document was made from before keep its vector; ``make`` builds the provider that
        embeds the others, once for each task. Returns how many were embedded, and how many cells rewritten.
        """
        wanted = docs.withColumn("text_key", text_key(F.col(text)))
        known = self.rows().join(parts.few(items.select(*ITEM).distinct()), ITEM, "left_semi").select("collection_name", "doc_id", "text_key", "embedding")
        both = wanted.join(known.dropDuplicates(["collection_name", "doc_id", "text_key"]), ["collection_name", "doc_id", "text_key"], "left").checkpoint(eager=True)
        fresh = both.where(F.col("embedding").isNull()).drop("embedding")
        named = fresh.withColumn("__key", F.struct("collection_name", "doc_id"))
        vectors = embed_with(named.withColumn("__key", F.to_json("__key")), make, text, "__key").withColumnRenamed("embedding", "__vector")
        made = named.withColumn("__key", F.to_json("__key")).join(vectors, "__key").withColumn("embedding", F.col("__vector")).drop("__key", "__vector")
        whole = both.where(F.col("embedding").isNotNull()).unionByName(made).checkpoint(eager=True)
        return fresh.count(), self.replace(whole, items)

    def ids(self, **scope) -> DataFrame:
        """(doc_id, point_id)."""
        return self.rows(**scope).select("doc_id", point_id(F.col("doc_id").cast("string")).alias("point_id"))


def shaped(points: DataFrame) -> DataFrame:
    """Points with all columns of PAYLOAD; a point without a vector is an error."""
    columns = {c: (F.col(c) if c in points.columns else F.lit(None)).cast(kind) for c, kind in PAYLOAD.items()}
    vector = F.when(F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0, columns["embedding"]).otherwise(F.raise_error(F.concat(F.lit("no vector for "), F.col("doc_id").cast("string"))).cast("array<float>"))
    return points.select("collection_name", "doc_id", *[c.alias(k) for k, c in columns.items() if k != "embedding"], vector.alias("embedding"))


def reached(order: Sequence[int], held: dict[int, int], probes: int, k: int) -> list[int]:
    """The first cells in order that hold rows, until there are enough of them and of rows."""
    out, rows = [], 0
    for cell in order:
        if held.get(cell):
            out.append(cell)
            rows += held[cell]
            if len(out) >= probes and rows >= REACH * k:
                break
    return out
