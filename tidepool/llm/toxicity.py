"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers run over the symbols of a clause and are composed into one machine (product states, factors
multiplied, weights added): a target before an insult raises it, an insult or a threat before a target emits a weight of
its own, and negation and reported speech lower whatever is emitted after them, insults and threats alike. The insult
lexicon itself is a transducer from words to weighted insult symbols: its arcs are stems (word beginnings) and whole words,
whose weights are log-odds learned from a bounded sample of labelled rows. The grammar's factors are learned from the same
rows. A clause's score is the weight of its path; a text's score is a logistic function, calibrated on a fold the lexicon
doesn't see, of its clauses' scores and of nothing else.

Defined results: null and empty texts score like texts without a match; without labelled rows of both classes the
lexicon holds the fixed English words only and the score is a fixed logistic curve; repeated rows score alike, one
output row for each input row; a document with two labels is learned from under both; ties between arcs go to the longer
one; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.blocks import PLAIN, Block, span_hash, split
from tidepool.llm.quality import logistic
from tidepool.llm.sampling import fold, labelled_sample, with_labels

#: Labelled rows of either class that are learned from at most.
FIT_ROWS = 2500
STEMS = range(3, 9)
MOST_ARCS = 4096
#: An arc needs so many toxic training texts, this log-odds, and so many standard errors between the two shares: of some
#: hundred thousand candidates many stand a few times in toxic texts by chance.
LEAST_TEXTS, LEAST_ODDS, LEAST_SIGMAS = 4, 1.5, 5.0
#: Words that open the grammar before anything is learned, and its closed classes.
INSULTS = "idiot moron stupid scum trash loser clown worthless pathetic disgusting".split()
THREATS = "kill hurt destroy beat töten schlagen umbringen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u they them he she du dich dir ihr euch sie tu te toi vous tú usted ustedes vosotros".split()
NEGATIONS = "not no never nor isn aren don nicht kein keine nie pas jamais ne nunca jamás ni".split()
REPORTS = "said says wrote writes quoted reported claimed sagte schrieb zitierte dit écrit dijo escribió".split()
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True

LOWERED = {c: c + 0x20 for c in range(0x41, 0x5B)}
WORDS = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Symbols: other word, insult, target, negation, threat, report.
OTHER, INSULT, TARGET, NEGATION, THREAT, REPORT = range(6)


SYMBOLS = 6
#: What the grammar's factors are before anything is learned, and the values that are tried for each.
FACTORS = {"target": 1.25, "negation": 0.4, "report": 0.6, "threat": 3.0, "addressed": 0.5}
TRIED = {"target": (1.0, 1.25, 1.6), "negation": (0.2, 0.4, 0.7), "report": (0.3, 0.6, 0.8), "threat": (2.0, 3.0, 4.0), "addressed": (0.0, 0.5, 1.0)}
#: A factor is changed only where the loss falls by more than this share.
BETTER = 0.01


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> next state, a factor on what is emitted, a weight that is emitted; 0 is the start."""

    to: np.ndarray
    factor: np.ndarray
    weight: np.ndarray


def window(trigger: int, length: int, on: tuple[int, ...], factor: float = 1.0, weight: float = 0.0) -> Transducer:
    """For ``length`` words after a trigger, symbols in ``on`` get a factor and emit a weight."""
    states = length + 1
    to = np.maximum(0, np.arange(states)[:, None] - 1) * np.ones((1, SYMBOLS), np.int64)
    to[:, trigger] = length
    near = (np.arange(states)[:, None] > 0) & np.isin(np.arange(SYMBOLS), on)
    return Transducer(to, np.where(near, factor, 1.0), np.where(near, weight, 0.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols; factors multiply and weights add."""
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(a.to)), np.arange(len(b.to)), indexing="ij"))
    return Transducer(a.to[i] * len(b.to) + b.to[j], a.factor[i] * b.factor[j], a.weight[i] + b.weight[j])


def grammar(factors: dict[str, float] = FACTORS) -> Transducer:
    """The composed machine. An insult emits its own weight, which stands beside the weights of the states."""
    machine = window(TARGET, 3, (INSULT,), factor=factors["target"])
    for part in (
        window(THREAT, 3, (TARGET,), weight=factors["threat"]),
        window(INSULT, 4, (TARGET,), weight=factors["addressed"]),
        window(NEGATION, 4, (INSULT, TARGET), factor=factors["negation"]),
        window(REPORT, 8, (INSULT, TARGET), factor=factors["report"]),
    ):
        machine = compose(machine, part)
    return machine


def clause_scores(machine: Transducer, symbols: np.ndarray, weights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Weights of the paths of clauses (words begin to end), all clauses stepping at once."""
    out, state = np.zeros(len(begin)), np.zeros(len(begin), np.int64)
    order = np.argsort(begin - end, kind="stable")  # long clauses first, so that those still running stand in front
    first, size = begin[order], (end - begin)[order]
    running = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for k, n in enumerate(running.tolist()):
        at = first[:n] + k
        symbol, now = symbols[at], state[:n]
        emitted = np.where(symbol == INSULT, weights[at], 0.0) + machine.weight[now, symbol]
        out[:n] += machine.factor[now, symbol] * emitted
        state[:n] = machine.to[now, symbol]
    scores = np.empty(len(begin))
    scores[order] = out
    return scores


@dataclass
class ToxicModel:
    stems: dict[int, np.ndarray]  # length -> sorted hashes; 0: whole words
    weights: dict[int, np.ndarray]
    closed: tuple[np.ndarray, np.ndarray]  # sorted hashes of the closed classes' words, and symbols
    curve: np.ndarray
    machine: Transducer


FEATURES = 3


def hashes_of(words: list[str]) -> np.ndarray:
    block = Block.of(pa.array(words, pa.string()))
    return span_hash(block.rolling(), block.offsets[:-1], block.offsets[1:]) if words else np.zeros(0, np.uint64)


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def build(lexicon: dict[tuple[int, str], float], curve: np.ndarray, factors: dict[str, float] = FACTORS) -> ToxicModel:
    """Arcs are keyed by (letters of the stem, or 0 for a whole word; text)."""
    stems, weights = {}, {}
    for n in sorted({k for k, _ in lexicon}):
        mine = [(w, x) for (k, w), x in lexicon.items() if k == n]
        h = hashes_of([w for w, _ in mine])
        order = np.argsort(h)
        stems[n], weights[n] = h[order], np.array([x for _, x in mine])[order]
    closed = [(w, s) for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (THREATS, THREAT), (REPORTS, REPORT)) for w in words]
    h = hashes_of([w for w, _ in closed])
    order = np.argsort(h)
    return ToxicModel(stems, weights, (h[order], np.array([s for _, s in closed])[order]), curve, grammar(factors))


@dataclass
class Clauses:
    """The words of a block as symbols, and its clauses that hold an insult or a threat."""

    symbols: np.ndarray
    weights: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray  # of each clause
    words: np.ndarray  # of each row


def clauses(block: Block, model: ToxicModel) -> Clauses:
    low = block.lowered()
    starts, ends, first = low.words(PLAIN)
    rolling = low.rolling()
    weight = np.zeros(len(starts))
    # Letters, not bytes: positions of the characters' first bytes.
    lead = np.flatnonzero((low.data & 0xC0) != 0x80)
    at_lead = np.searchsorted(lead, starts)
    for n in sorted(model.stems, key=lambda k: (k == 0, k)):  # longer arcs, then whole words, prevail
        if not len(starts):
            break
        if n:
            nth = at_lead + n
            stop = np.where(nth < len(lead), lead[np.minimum(nth, len(lead) - 1)], len(low.data))
            fits = np.flatnonzero(stop <= ends)
            at, hit = lookup(model.stems[n], span_hash(rolling, starts[fits], stop[fits]))
            fits = fits[hit]
        else:
            at, hit = lookup(model.stems[n], span_hash(rolling, starts, ends))
            fits = np.flatnonzero(hit)
        weight[fits] = model.weights[n][at[hit]]
    at, hit = lookup(model.closed[0], span_hash(rolling, starts, ends))
    symbol = np.where(hit, model.closed[1][at], OTHER)
    symbol[weight != 0] = INSULT
    # Clauses: words between two ends of clauses; a row's start begins one.
    ends_before = np.cumsum(np.concatenate([[0], CLAUSE_END[low.data]]))[starts]
    row = np.repeat(np.arange(block.rows), np.diff(first))
    new = np.concatenate([[True], (ends_before[1:] != ends_before[:-1]) | (row[1:] != row[:-1])]) if len(starts) else np.zeros(0, bool)
    limits = np.concatenate([np.flatnonzero(new), [len(starts)]])
    kept = np.unique((np.cumsum(new) - 1)[(symbol == INSULT) | (symbol == THREAT)])
    return Clauses(symbol, weight, limits[kept], limits[kept + 1], row[limits[kept]], np.diff(first))


def evidence(found: Clauses, machine: Transducer) -> np.ndarray:
    """FEATURES numbers for each text, none below 0: best clause, sum of clauses, their sum for its words."""
    out = np.zeros((len(found.words), FEATURES))
    score = clause_scores(machine, found.symbols, found.weights, found.begin, found.end)
    np.maximum.at(out[:, 0], found.row, score)
    np.add.at(out[:, 1], found.row, score)
    out[:, 2] = 20 * out[:, 1] / np.maximum(20, found.words)
    return np.log1p(np.maximum(0.0, out))


def arcs_of(text: str, heads: set[str] | None = None) -> set[tuple[int, str]]:
    """Words and stems of a text; with ``heads``, only those that begin with one of these shortest stems, or are shorter."""
    least = STEMS[0]
    words = set(WORDS.findall(text.translate(LOWERED)))
    if heads is not None:
        words = {w for w in words if w[:least] in heads}
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in STEMS if len(w) >= n}


def learn(rows: list) -> dict[tuple[int, str], float]:
    """Log-odds of arcs; an arc that says no more than a shorter stem of it is left out.

    An arc that enough toxic texts have begins with a head that as many have, so other words of clean texts are passed over.
    """
    toxic, clean = Counter(), Counter()
    for r in rows:
        if r["label"] > 0:
            toxic.update(arcs_of(r["text"]))
    wanted = {a for a, n in toxic.items() if n >= LEAST_TEXTS}
    heads = {w[: STEMS[0]] for _, w in wanted}
    for r in rows:
        if r["label"] <= 0:
            clean.update(arcs_of(r["text"], heads) & wanted)
    n_toxic = sum(r["label"] > 0 for r in rows)
    n_clean = len(rows) - n_toxic
    odds = {a: float(np.log((toxic[a] + 0.5) / (n_toxic + 1)) - np.log((clean[a] + 0.5) / (n_clean + 1))) for a in wanted}

    def sigmas(a: tuple[int, str]) -> float:
        share = (toxic[a] + clean[a] + 1) / (n_toxic + n_clean + 2)
        return (toxic[a] / max(1, n_toxic) - clean[a] / max(1, n_clean)) / np.sqrt(share * (1 - share) * (1 / max(1, n_toxic) + 1 / max(1, n_clean)))

    out: dict[tuple[int, str], float] = {}
    for a in sorted((a for a in wanted if odds[a] >= LEAST_ODDS and sigmas(a) >= LEAST_SIGMAS), key=lambda a: (a[0] or 99, -odds[a], a[1])):
        shorter = [odds[b] for n in STEMS if n < (a[0] or len(a[1]) + 1) and (b := (n, a[1][:n])) in out]
        if not shorter or odds[a] > max(shorter) + 0.7:
            out[a] = odds[a]
    best = sorted(out, key=lambda a: (-out[a] * np.log1p(toxic[a]), a))[:MOST_ARCS]
    return {a: out[a] for a in best}


def calibrate(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, and its loss; more evidence never lowers a score, so no weight is below 0.

    Rows are weighted so that classes stand in their natural proportion; a ridge keeps separable classes finite. Weights
    that would be negative are left out, the most negative first.
    """
    spread = x.std(axis=0) + 1e-9
    z = np.concatenate([x / spread, np.ones((len(x), 1))], axis=1)
    weight = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y <= 0).sum()))
    used = np.ones(z.shape[1], bool)
    while True:
        w = np.append(np.zeros(used.sum() - 1), np.log(prior / (1 - prior)))
        ridge = np.append(np.full(len(w) - 1, 1e-4), 1e-8)
        for _ in range(rounds):
            p = logistic(z[:, used] @ w)
            g = z[:, used].T @ (weight * (p - y)) + ridge * w
            h = (z[:, used] * (weight * p * (1 - p))[:, None]).T @ z[:, used] + np.diag(ridge + 1e-9)
            step = np.clip(np.linalg.solve(h, g), -2.0, 2.0)
            w = w - step
            if np.abs(step).max() < 1e-7:
                break
        if len(w) == 1 or w[:-1].min() >= 0:
            break
        used[np.flatnonzero(used)[int(np.argmin(w[:-1]))]] = False
    p = np.clip(logistic(z[:, used] @ w), 1e-9, 1 - 1e-9)
    loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    full = np.zeros(z.shape[1])
    full[used] = w
    return np.append(full[:-1] / spread, full[-1]), loss


def tuned(held: list[Clauses], y: np.ndarray, prior: float) -> tuple[dict[str, float], np.ndarray]:
    """The grammar's factors, each in turn set to what predicts the held-out half best, and the curve that goes with them."""
    fitted = lambda factors: calibrate(np.concatenate([evidence(c, grammar(factors)) for c in held]), y, prior)
    best = dict(FACTORS)
    curve, loss = fitted(best)
    for name, values in TRIED.items():
        for value in values:
            if value == best[name]:
                continue
            other, less = fitted(best | {name: value})
            if less < loss * (1 - BETTER):
                best, curve, loss = best | {name: value}, other, less
    return best, curve


def distinct(rows: list, words: int = 3) -> list:
    """One row for each least hash of a text's word windows: copies and near copies would count a text's own words as evidence."""
    seen, out = set(), []
    for r in rows:
        held = WORDS.findall(r["text"].translate(LOWERED))
        least = min((xxhash.xxh64_intdigest(" ".join(held[i : i + words])) for i in range(max(1, len(held) - words + 1))), default=0)
        if (r["label"] > 0, least) not in seen:
            seen.add((r["label"] > 0, least))
            out.append(r)
    return out


def texts_block(rows: list) -> Iterator[Block]:
    yield from (b for _, b in split([pa.record_batch({"text": pa.array([r["text"] for r in rows], pa.string())})]))


def fit(rows: list, prior: float) -> ToxicModel:
    seeds = {(0, w): 3.0 for w in INSULTS}
    plain = np.array([1.5, 0.5, 0.0, -2.5])
    if len({int(r["label"] > 0) for r in rows}) < 2:
        return build(seeds, plain)
    rows = distinct(rows)
    order = np.random.default_rng(5).permutation(len(rows))
    halves = [[rows[i] for i in order[k::2]] for k in (0, 1)]
    held, y = [], []
    for mine, other in (halves, halves[::-1]):  # each half is scored by the lexicon of the other
        part = build(seeds | learn(mine), plain)
        held += [clauses(b, part) for b in texts_block(other)]
        y += [float(r["label"] > 0) for r in other]
    factors, curve = tuned(held, np.array(y), prior)
    return build(seeds | learn(rows), curve, factors)


def scored(batches: Iterator[pa.RecordBatch], model: ToxicModel) -> Iterator[pa.RecordBatch]:
    for batch, block in split(batches):
        x = evidence(clauses(block, model), model.machine)
        score = logistic(np.concatenate([x, np.ones((len(x), 1))], axis=1) @ model.curve)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)})


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS, held_out_fold: int | None = 0, folds: int = 5) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text), learned from labels outside the fold."""
    known = labels if held_out_fold is None else labels.where(fold(F.col("doc_id"), folds) != held_out_fold)
    mean = known.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    model = fit(labelled_sample(docs, with_labels(docs, known, label), fit_rows), min(0.5, max(0.02, mean or 0.0)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_ARCS arcs at most
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda batches: scored(batches, shared.value), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
