"""Nearest vectors by products of blocks: which points of a block may be among the k best of each query of a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries of one product.
PRODUCT_ROWS = 256


class Vectors:
    """An Arrow column of vectors; ``sizes`` has their lengths, -1 for one that is null or holds a null."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        rows = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten()
        self.starts, self.sizes = np.cumsum(lengths) - lengths, lengths.copy()
        self.sizes[pc.is_null(rows).to_numpy(zero_copy_only=False)] = -1
        if flat.null_count:
            self.sizes[np.repeat(np.arange(len(rows)), lengths)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
        self.values = flat.to_numpy(zero_copy_only=False).astype(float)

    def rows(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.values[self.starts[at][:, None] + np.arange(size)]


def first_of(k: int, *groups: np.ndarray) -> np.ndarray:
    """Places of the first k of each run of rows that are equal in all groups; rows of a group stand together."""
    n = len(groups[0])
    fresh = np.ones(n, bool)
    fresh[1:] = np.any([g[1:] != g[:-1] for g in groups], axis=0)
    runs = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.flatnonzero(np.arange(n) - runs < k)


def least_copies(points: np.ndarray, k: int) -> np.ndarray:
    """Places of points, of equal ones the first k only: no later one can be among the k best."""
    if not points.shape[1]:
        return np.arange(min(k, len(points)))
    _, own = np.unique(points.view(np.dtype((np.void, points.shape[1] * points.itemsize))).ravel(), return_inverse=True)
    order = np.argsort(own, kind="stable")
    return np.sort(order[first_of(k, own[order])])


def candidates(points: np.ndarray, queries: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score): all that may be among the k best by the score rounded to digits, of equal scores the first k points.

    The product finds them; scores are then summed place by place, so they don't depend on how a product is worked out.
    """
    with np.errstate(all="ignore"):
        rough = queries @ points.T
        rough[~np.isfinite(rough)] = np.inf
        longest = np.sqrt((points * points).sum(axis=1).max() * (queries * queries).sum(axis=1).max())
        slack = 1.01 * 10.0**-digits + 4 * (2 + points.shape[1]) * np.finfo(float).eps * longest
        least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        row, column = np.nonzero(rough >= np.where(np.isfinite(least), least - slack, least)[:, None]) if np.isfinite(slack) else np.nonzero(np.ones_like(rough))
        score = np.zeros(len(row))
        for j in range(points.shape[1]):
            score += queries[row, j] * points[column, j]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    own = first_of(k, row, np.nan_to_num(score, nan=np.inf, posinf=np.finfo(float).max))
    return row[own], column[own], score[own]


def block_best(points: pa.Table, queries: pa.Table, k: int, vector: str, key: str, digits: int) -> pa.Table:
    """(query_id, key, score) of a block's points that may be among the k best of a block's queries.

    A point whose length is not the query's, and one with nulls, has no score and comes last.
    """
    points = points.take(pc.sort_indices(points[key], null_placement="at_start"))  # ties go by key
    x, q = Vectors(points[vector]), Vectors(queries["q"])
    asked, found, scores = [np.zeros(0, int)], [np.zeros(0, int)], [pa.array([], pa.float64())]
    for size in np.unique(q.sizes):
        mine = np.flatnonzero(q.sizes == size)
        able = np.flatnonzero(x.sizes == size) if size >= 0 else np.zeros(0, int)
        if len(able):
            vectors = x.rows(able, size)
            first = least_copies(vectors, k)
            vectors = vectors[first]
            for at in range(0, len(mine), PRODUCT_ROWS):
                part = mine[at : at + PRODUCT_ROWS]
                row, column, score = candidates(vectors, q.rows(part, size), k, digits)
                asked.append(part[row]), found.append(able[first][column]), scores.append(pa.array(score))
        if len(able) < k:
            rest = np.setdiff1d(np.arange(len(x.sizes)), able)[:k]
            asked.append(np.repeat(mine, len(rest))), found.append(np.tile(rest, len(mine))), scores.append(pa.nulls(len(mine) * len(rest), pa.float64()))
    ids, keys = queries["query_id"].take(pa.array(np.concatenate(asked))), points[key].take(pa.array(np.concatenate(found)))
    return pa.table({"query_id": ids, key: keys, "score": pa.chunked_array(scores, pa.float64())})
