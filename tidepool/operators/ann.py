"""An inverted-file index over vectors: cells around centroids, of which a search reads the nearest ones only.

Centroids are fitted on a bounded sample, FIT_POINTS vectors chosen by a hash of their key; every vector is indexed, in
Arrow batches by one matrix product each. Stored by cell, a search for one vector prunes all other cells' files; a search
for many joins them to the index by cell. How many cells are read is set by measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.embed import cosine
from tidepool.operators.retrieval import nearest
from tidepool.session import shared_folder, spread

#: Vectors that centroids are fitted on at most, and rounds of the fit.
FIT_POINTS, ROUNDS = 20_000, 12
MOST_CELLS = 4096
#: Queries that recall is measured on at most.
MEASURED = 256


@dataclass(frozen=True)
class Cells:
    centroids: np.ndarray  # unit rows

    def ranked(self, vector: Sequence[float]) -> list[int]:
        return np.argsort(-(self.centroids @ np.asarray(vector, float)), kind="stable").tolist()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def fit(points: DataFrame, vector: str = "embedding", key: str = "doc_id", cells: int | None = None, fit_points: int = FIT_POINTS) -> Cells:
    """Spherical k-means; by default as many cells as the square root of the number of vectors, at most MOST_CELLS."""
    n = points.count()
    share = min(1.0, 1.2 * fit_points / max(1, n))
    draw = F.pmod(F.xxhash64(key), F.lit(1_000_003))
    drawn = points.where(draw / F.lit(1_000_003.0) < share).orderBy(draw, key).select(vector).limit(fit_points).collect()  # by the draw, whatever file a row is in
    x = unit(np.array([r[0] for r in drawn], float)) if drawn else np.zeros((0, 1))
    k = min(len(x), cells or max(1, min(MOST_CELLS, round(n**0.5))))
    rng = np.random.default_rng(3)
    centroids = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=k) > 0
        centroids = np.where(held[:, None], unit(sums), centroids)
    return Cells(centroids)


def indexed(points: DataFrame, cells: Cells, vector: str = "embedding") -> DataFrame:
    """Points with their cell; all of them."""
    shared = points.sparkSession.sparkContext.broadcast(cells.centroids)  # MOST_CELLS rows at most

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series((np.stack(batch.to_numpy()) @ shared.value.T).argmax(axis=1)) if len(batch) else pd.Series([], dtype="int32")

    return points.withColumn("cell", cell(vector))


def search(index: DataFrame, cells: Cells, query: Sequence[float], k: int, probes: int, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """The k vectors of the highest cosine among the cells nearest to the query; ties by key."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    rows = index.where(F.col("cell").isin(*cells.ranked(query)[:probes]))
    return rows.withColumn("score", cosine(F.col(vector), wanted)).orderBy(F.desc("score"), key).limit(k)


def search_many(index: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int, vector: str = "embedding", key: str = "doc_id", digits: int = 9) -> DataFrame:
    """(query_id, key, score, nth) for queries (query_id, q): each meets the vectors of its nearest cells."""
    shared = index.sparkSession.sparkContext.broadcast(cells.centroids)

    @F.pandas_udf("array<int>")
    def near(q: pd.Series) -> pd.Series:
        ranks = np.argsort(-(np.stack(q.to_numpy()) @ shared.value.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(ranks.astype(np.int32)))

    asked = spread(queries.select("query_id", "q")).select("query_id", "q", F.explode(near("q")).alias("cell"))
    return nearest(index, asked, k, vector, key, digits, on=["cell"])


def truth(index: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """(query_id, key): the true k nearest, by brute force; kept, as they are compared more than once."""
    shared_folder(index.sparkSession)
    return nearest(index, queries, k, vector=vector, key=key).select("query_id", key).checkpoint(eager=True)


def recall(index: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int, vector: str = "embedding", key: str = "doc_id", true: DataFrame | None = None) -> float:
    """Share of the true k nearest, found by brute force, that a search finds."""
    true = truth(index, queries, k, vector, key) if true is None else true
    found = search_many(index, cells, queries, k, probes, vector, key).select("query_id", key, F.lit(1).alias("hit"))
    n, hit = true.join(found, ["query_id", key], "left").agg(F.count("*"), F.count("hit")).first()
    return hit / n if n else 1.0


def probes_for(index: DataFrame, cells: Cells, queries: DataFrame, k: int, least: float = 0.9, vector: str = "embedding", key: str = "doc_id") -> tuple[int, float]:
    """The fewest cells, doubling from one, at which measured recall reaches the least; all of them are exact."""
    shared_folder(index.sparkSession)
    asked = queries.orderBy("query_id").limit(MEASURED).checkpoint(eager=True)
    probes, cap, true = 1, len(cells.centroids), truth(index, asked, k, vector, key)
    while True:
        got = recall(index, cells, asked, k, probes, vector, key, true)
        if got >= least or probes >= cap:
            return probes, got
        probes = min(cap, 2 * probes)
