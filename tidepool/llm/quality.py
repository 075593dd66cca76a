"""Quality rules: counts for each text, and a calibrated logistic regression over hashed n-grams.

The classifier reads hashed word unigrams and bigrams and character (code point) n-grams, each family normalised by its
count. It is fitted on a bounded sample of labelled rows, its probabilities are calibrated on a fold that the fit
does not see (Platt's method), and rows are scored in Arrow batches against fixed thresholds.

Defined results: a null text counts as empty; an empty text has zero counts and fails the base rules; ties and
repeated rows are scored alike, one output row for each input row; an empty table gives no rows; without labelled rows
of both classes the probability is 1 for every text, so the base rules alone decide; a document with two labels is learned
from under both. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.blocks import BASE, SPACED, Block, byte_class, chained, mixed, repeated, span_hash, split
from tidepool.llm.sampling import labelled_sample, with_labels

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Texts whose calibrated probability of good quality is below this are not kept.
KEEP_AT = 0.5
#: Labelled rows of either class that the classifier is fitted on at most.
FIT_ROWS = 1500
BITS = 17
CHAR_ORDERS = (2, 3, 4)
SYMBOLS = byte_class(b"#*$%&|<>")
FAMILIES = 2 + len(CHAR_ORDERS)
#: Frequencies times this stand in the design matrix.
SCALE = 50.0

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return logistic(self.slope * raw + self.shift)


def char_codes(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams of code points that stay in a row, and the row limits among them."""
    size = len(points)
    if size < n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = np.full(size - n + 1, n, np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) + points[k : size - n + 1 + k]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    counts = np.maximum(0, np.diff(offsets) - n + 1)
    if counts.sum() == len(code):
        return code, np.concatenate([[0], np.cumsum(counts)])
    stays = np.ones(len(code), bool)
    for k in range(1, n):  # n-grams that begin in one row and end in the next
        cross = offsets[1:-1] - k
        stays[cross[(cross >= 0) & (cross < len(code))]] = False
    return code[stays], np.concatenate([[0], np.cumsum(counts)])


def features(block: Block, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family, the buckets of all features and the row limits among them."""
    yield (hashes >> np.uint64(64 - BITS)).astype(np.int64), first
    pairs, at = chained(hashes, first, 2)
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(at, first)
    points, begins = block.points()
    for n in CHAR_ORDERS:
        yield char_codes(points, begins, n)


def raw_scores(block: Block, hashes: np.ndarray, first: np.ndarray, model: QualityModel) -> np.ndarray:
    out = np.full(block.rows, float(model.bias))
    for k, (codes, limits) in enumerate(features(block, hashes, first)):
        run = np.zeros(len(codes) + 1)
        np.cumsum(model.weights[k][codes], out=run[1:])
        out += (run[limits[1:]] - run[limits[:-1]]) / np.maximum(1, np.diff(limits))
    return out


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = block.words(SPACED)
    return starts, ends, first, span_hash(block.rolling(), starts, ends)


def counts(block: Block, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    inside = SPACED[block.data]
    letters = block.total(inside & ((block.data & 0xC0) != 0x80))
    symbols = block.total(SYMBOLS[block.data])
    rows = np.arange(block.rows, dtype=np.uint64)
    row_key = mixed(rows * BASE + np.uint64(1))
    # Lines: from a row's start or a newline to the next newline or the row's end.
    breaks = np.flatnonzero(block.data == 0x0A)
    line_starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([block.offsets[1:], breaks]))
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    s, e = line_starts[with_word], line_ends[with_word]
    line_row = np.searchsorted(block.offsets[1:], s, side="right")
    line_key = span_hash(block.rolling(), s, e) ^ row_key[line_row]
    _, seen_first = np.unique(line_key, return_index=True)
    n_lines, n_distinct = np.bincount(line_row, minlength=block.rows), np.bincount(line_row[seen_first], minlength=block.rows)
    # Windows of five words found twice or more in a row.
    windows, at = chained(hashes, first, 5)
    word_row = np.repeat(np.arange(block.rows), np.diff(first))
    twice = at[repeated(windows ^ row_key[word_row[at]])]
    cover = np.zeros(len(hashes) + 6, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(cover)[: len(hashes)] > 0, out=covered[1:])
    return {
        "n_words": np.diff(first),
        "word_chars": letters,
        "n_symbols": symbols,
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": covered[first[1:]] - covered[first[:-1]],
    }


def design(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse design matrix: (feature, row, value), a feature being family * 2**BITS + bucket."""
    code, row, value, at = [], [], [], 0
    for _, block in split([pa.record_batch({"text": pa.array(texts, pa.string())})]):
        _, _, first, hashes = word_hashes(block)
        for k, (buckets, limits) in enumerate(features(block, hashes, first)):
            n = np.diff(limits)
            key, count = np.unique((np.repeat(np.arange(block.rows, dtype=np.int64), n) << BITS) | buckets.astype(np.int64), return_counts=True)
            code.append(((key & ((1 << BITS) - 1)) + (k << BITS)).astype(np.int32))
            row.append(((key >> BITS) + at).astype(np.int32))
            value.append((SCALE * count / np.maximum(1, n)[key >> BITS]).astype(np.float32))
        at += block.rows
    return np.concatenate(code), np.concatenate(row), np.concatenate(value)


class Sums:
    """Sums of values by a key, for one order of the values: they are sorted by it once."""

    def __init__(self, key: np.ndarray, size: int) -> None:
        self.order = np.argsort(key, kind="stable")
        held = key[self.order]
        self.start = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
        self.key, self.size = held[self.start], size

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.start):
            out[self.key] = np.add.reduceat(values, self.start)
        return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def platt(raw: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve through raw scores, by Newton steps with a light prior."""
    mean, spread = raw.mean(), raw.std() + 1e-9
    x = np.stack([(raw - mean) / spread, np.ones(len(raw))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = logistic(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 0.05 * (w - np.array([1.0, 0.0])))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(rows: list, seed: int = 7, rounds: int = 80) -> QualityModel | None:
    """Full-batch AdaGrad on four fifths of the sample; the last fifth calibrates."""
    if len({int(r["label"] > 0) for r in rows}) < 2:
        return None
    order = np.random.default_rng(seed).permutation(len(rows))
    rows = [rows[i] for i in order]
    y = np.array([float(r["label"] > 0) for r in rows])
    fitted = np.arange(len(rows)) % 5 > 0
    code, row, x = design([r["text"] for r in rows])
    half = {c: 0.5 / max(1, (fitted & (y == c)).sum()) for c in (0.0, 1.0)}
    share = np.where(y > 0, half[1.0], half[0.0]) * fitted
    size = FAMILIES << BITS
    # The matrix by rows for the scores, and by features for the gradient.
    by_row, by_code = Sums(row, len(y)), Sums(code, size)
    code, x_row = code[by_row.order], x[by_row.order]
    row, x_code = row[by_code.order], x[by_code.order]
    w, bias, squares, bias_squares = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        g = (logistic(by_row.of(x_row * w[code]) + bias) - y) * share
        grad = by_code.of(x_code * g[row]) + 1e-6 * w
        squares += grad * grad
        w -= 0.2 * grad / np.sqrt(squares)
        bias_squares += g.sum() ** 2
        bias -= 0.2 * g.sum() / np.sqrt(bias_squares)
    raw = by_row.of(x_row * w[code]) + bias
    test = ~fitted if len(set(y[~fitted])) > 1 else fitted
    slope, shift = platt(raw[test], y[test])
    return QualityModel((w * SCALE).reshape(FAMILIES, -1), bias, slope, shift)


def scored(batches: Iterator[pa.RecordBatch], model: QualityModel | None) -> Iterator[pa.RecordBatch]:
    for batch, block in split(batches):
        starts, ends, first, hashes = word_hashes(block)
        found = counts(block, starts, ends, first, hashes)
        failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
        good = np.ones(block.rows) if model is None else model.probability(raw_scores(block, hashes, first, model))
        yield pa.record_batch(
            {"doc_id": batch.column("doc_id")}
            | {k: v.astype(np.int64) for k, v in found.items()}
            | {"base_failed": failed, "kept": ~failed & (good >= KEEP_AT), "quality": good}
        )


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Counts, base verdict, verdict and calibrated probability of good quality for each row of docs (doc_id, text)."""
    model = fit(labelled_sample(docs, with_labels(docs, labels, label), fit_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: FAMILIES * 2**BITS weights
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda batches: scored(batches, shared.value), SCHEMA.replace("doc_id long", f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"))
