"""Language identification by string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which byte n-grams of 1 to 4 bytes
(hashed to 2**DIM_BITS buckets, of the lower-cased text) each holds. A bounded sample of labelled texts gives landmarks;
the Nystrom map turns kernel values against them into features, on which a ridge regression is fitted for each
language against the rest. Texts are scored in blocks by matrix products.

Defined results: null texts and texts without a letter are `und` with score 0; with nothing to learn from every text
is `und`; an empty table gives no rows; repeated rows are labelled alike, one output row for each input row; ties
between languages go to the first by code point; a document with two labels is learned from under both. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.blocks import Block, split
from tidepool.llm.sampling import fold, labelled_sample, narrow

ORDERS = (1, 2, 3, 4)
DIM_BITS = 15
#: Labelled rows of each language that are learned from at most, how many of them are landmarks, and landmarks in all
#: (with more languages each has fewer, one at least), so that the model's size follows the languages only from there on.
FIT_ROWS = 250
LANDMARKS, MOST_LANDMARKS = 24, 960
RIDGE = 1e-3
#: Rows whose presence vectors stand in memory at once: 32 * 2**15 * 4 bytes.
ROWS_AT_ONCE = 32
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # buckets x landmarks, unit columns
    heads: np.ndarray  # landmarks x languages: Nystrom map and ridge weights in one product
    bias: np.ndarray

    def kernels(self, presence: np.ndarray) -> np.ndarray:
        return unit_rows(presence) @ self.landmarks

    def scores(self, kernels: np.ndarray) -> np.ndarray:
        return kernels @ self.heads + self.bias

    def overlap(self, presence: np.ndarray, kernels: np.ndarray) -> np.ndarray:
        """For each row the largest share of n-grams in common with a landmark, of those that the shorter of both holds.

        Scores sum to a constant and so always have a best language; this one is small for a text like no landmark.
        """
        own = np.maximum(1.0, presence.sum(axis=1, keepdims=True))
        theirs = np.maximum(1.0, (self.landmarks > 0).sum(axis=0))
        return (kernels * np.sqrt(np.maximum(own, theirs) / np.minimum(own, theirs))).max(axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1.0, np.sqrt(x.sum(axis=1, keepdims=True)))  # presence: the sum is the squared length


def presence(block: Block) -> Iterator[np.ndarray]:
    """Presence matrices of ROWS_AT_ONCE rows each."""
    codes = []
    for n in ORDERS:
        if len(block.data) < n:
            continue
        code = np.full(len(block.data) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + block.data[k : len(block.data) - n + 1 + k]
        codes.append((n, ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)).astype(np.int64)))
    size = 1 << DIM_BITS
    for at in range(0, block.rows, ROWS_AT_ONCE):
        to = min(block.rows, at + ROWS_AT_ONCE)
        out = np.zeros((to - at, size), np.float32)
        flat = out.reshape(-1)
        for n, code in codes:
            for row in range(at, to):
                flat[code[block.offsets[row] : max(block.offsets[row], block.offsets[row + 1] - n + 1)] + (row - at) * size] = 1.0
        yield out


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def fit(rows: list) -> LanguageModel | None:
    if not rows:
        return None
    languages = sorted({r["label"] for r in rows})
    texts = lowered(pa.array([r["text"] for r in rows], pa.string()))
    place = {name: k for k, name in enumerate(languages)}
    label = np.array([place[r["label"]] for r in rows])
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
    chosen = np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(languages))])
    blocks = lambda held: (unit_rows(m) for _, b in split([pa.record_batch({"text": held})]) for m in presence(b))
    marks = np.concatenate(list(blocks(texts.take(pa.array(chosen))))).T.copy()
    # Presence vectors never stand in memory all at once, only their kernels.
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([x @ marks for x in blocks(texts)]) @ whiten
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1.0 / np.bincount(label, minlength=len(languages)))[label]
    weight = weight / weight.mean()
    mean, target = (weight[:, None] * phi).mean(0), (weight[:, None] * y).mean(0)
    z = phi - mean
    w = np.linalg.solve((z * weight[:, None]).T @ z + RIDGE * len(rows) * np.eye(z.shape[1]), (z * weight[:, None]).T @ (y - target))
    return LanguageModel(languages, marks.astype(np.float32), (whiten @ w).astype(np.float32), target - mean @ w)


def labelled(batches: Iterator[pa.RecordBatch], model: LanguageModel | None, kept: tuple[str, ...] = ("doc_id",), made: tuple[str, ...] = ("lang_pred", "score")) -> Iterator[pa.RecordBatch]:
    for batch, _ in split(batches):
        texts = lowered(batch.column("text"))
        lettered = np.asarray(pc.match_substring_regex(texts, r"\pL"))
        best, score, overlap = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        if model is not None and batch.num_rows:
            asked = len(made) > 2
            found = [(model.scores(k), model.overlap(m, k) if asked else overlap[:0]) for m in presence(Block.of(texts)) for k in [model.kernels(m)]]
            raw, shares = (np.concatenate(x) for x in zip(*found, strict=True))
            overlap = np.where(lettered, shares, 0.0) if asked else overlap
            best = np.where(lettered, raw.argmax(axis=1), -1)
            score = np.where(lettered, np.clip((raw.max(axis=1) + 1) / 2, 0, 1), 0.0)
        names = [UNDETERMINED if k < 0 else model.languages[k] for k in best]
        out = (pa.array(names, pa.string()), score.astype(np.float64), overlap.astype(np.float64))
        yield pa.record_batch({name: batch.column(name) for name in kept} | dict(zip(made, out, strict=False)))


def identify_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, held_out_fold: int | None = 2, folds: int = 4, kept: tuple[str, ...] = ("doc_id",), made: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``kept``, and language, score and, with a third name, overlap under the names ``made``, for each row of docs (doc_id, text), learned from its column lang outside the fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if held_out_fold is not None:
        known = known.where(fold(F.col("doc_id"), folds) != held_out_fold)
    model = fit(labelled_sample(known, narrow(known, F.col("lang").alias("label")), fit_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**DIM_BITS x landmarks
    rows = docs.select(*dict.fromkeys([*kept, "text"]))
    schema = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in kept)
    return rows.mapInArrow(lambda batches: labelled(batches, shared.value, kept, made), f"{schema}, `{made[0]}` string, " + ", ".join(f"`{name}` double" for name in made[1:]))
