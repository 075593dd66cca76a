"""Language-model scoring by Brown class-based bigrams.

Counts of all training tokens are gathered exactly, keyed by 64-bit hashes. Classes are made in two steps, both by
exchange, that is by what a move does to the likelihood of class bigrams:

1. The UNIT_WORDS most frequent words, and SUFFIX_UNITS groups of all others by their last letters, are moved between
   CLASSES classes until no move gains, on their pair counts over the whole training part.
2. Every other training word, however many there are, moves to its own best class against these: its counts of classes
   before and after it are summed over the whole training part, one shuffle by word, and weighed in Arrow batches.

A word is predicted in its own class; as the word before, one beyond the UNIT_WORDS counts in its group's class (a
two-sided class model), so a text is read in one pass. A text's score is the sum of log10 of class transitions,
P(class | class before), and emissions, P(word | class); both are smoothed. Words never seen have their group's class.

Everything but rarer words is worked out where the text is read: a table of the CACHED_WORDS most frequent words travels
to the workers (a fixed size), and only tokens outside it are joined to all words, with a row for each text, word and
class before it. Nothing is cut off: the table spares a shuffle of the hot words, the join has the rest. Sums of doubles
over rows are decimals, so partitioning changes nothing.

Defined results: a null text counts as empty and has one token, the end; rows with a null doc_id are trained on;
repeated rows score alike, one output row for each input row; without training rows counts are zero and transitions
uniform; ties in frequency go to the smaller hash; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.blocks import SPACED, Block, span_hash, split
from tidepool.llm.sampling import in_fold
from tidepool.llm.tables import dealt, durable

UNIT_WORDS, SUFFIX_UNITS, CLASSES = 1024, 256, 48
CACHED_WORDS = 1 << 19
#: Counts from here on share a row of the histogram that the cache is cut by.
TALLY = 1 << 16
ADDED = 0.1
TRANSITION_PRIOR = 5.0
EXCHANGE_ROUNDS = 8
#: The end of a text, a token of its own.
END = np.uint64(0x0123456789ABCDEF)
#: Distinct keys held before they are passed on.
HELD = 1 << 20
#: Entries that one step of the word exchange weighs against all classes.
WEIGHED = 1 << 16
#: Counts whose gains are worked out once.
FEW = 24


@dataclass
class Tokens:
    hashes: np.ndarray
    suffix: np.ndarray  # suffix unit, from 0
    first: np.ndarray  # rows + 1
    texts: np.ndarray | None  # a hash for each whole text, where it is asked for


def tokens(block: Block, named: bool = False) -> Tokens:
    low = block.lowered()
    starts, ends, first = low.words(SPACED)
    rolling = low.rolling()
    hashes = span_hash(rolling, starts, ends)
    code = np.zeros(len(starts), np.uint32)
    for k in (1, 2, 3):
        code = code * np.uint32(257) + np.where(ends - k >= starts, low.data[np.maximum(ends - k, 0)], 0).astype(np.uint32)
    suffix = ((code * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64) % SUFFIX_UNITS if len(starts) else np.zeros(0, np.int64)
    texts = span_hash(block.rolling(), block.offsets[:-1], block.offsets[1:]) if named else None
    return Tokens(np.insert(hashes, first[1:], END), np.insert(suffix, first[1:], 0), first + np.arange(block.rows + 1), texts)


def summed(keys: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys with their sums, merged as far as HELD goes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        u, inverse = np.unique(k, return_inverse=True)
        return u, np.bincount(inverse, n, minlength=len(u)).astype(np.int64)

    for pair in keys:
        held.append(pair)
        if sum(len(x[0]) for x in held) > HELD:
            held = [merged()]
            if len(held[0][0]) > HELD // 2:
                yield held.pop()
    if held:
        yield merged()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of the tokens of a partition."""
    for h, n in summed(np.unique(tokens(block).hashes, return_counts=True) for _, block in split(batches)):
        yield pa.record_batch({"h": h.view(np.int64), "n": n})


@dataclass
class Units:
    """Sorted hashes of the words that are units, and their numbers; the end is one of them."""

    hashes: np.ndarray
    number: np.ndarray
    room: int  # numbers of words; those of groups begin here

    @classmethod
    def of(cls, ranked: np.ndarray) -> Units:
        """Of words by falling frequency: the end and the most frequent others."""
        top = np.concatenate([[END], ranked[ranked != END]]).astype(np.uint64)[:UNIT_WORDS]
        order = np.argsort(top)
        return cls(top[order], order, UNIT_WORDS)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Units of words, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)

    def contexts(self, t: Tokens) -> np.ndarray:
        """Unit of each token, a word that is none standing in its group."""
        unit = self.find(t.hashes)
        return np.where(unit < 0, self.room + t.suffix, unit)


def before(unit: np.ndarray) -> np.ndarray:
    """The unit before each token; each text ends with the end, so the first follows one as well."""
    return np.concatenate([np.zeros(1, unit.dtype), unit[:-1]])


def paired(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """(pair, n): counts of consecutive units, an end standing before each text."""
    size = units.room + SUFFIX_UNITS
    total = np.zeros(size * size, np.int64)
    for _, block in split(batches):
        u = units.contexts(tokens(block))
        total += np.bincount(before(u) * size + u, minlength=size * size)
    pair = np.flatnonzero(total)
    yield pa.record_batch({"pair": pair.astype(np.int64), "n": total[pair]})


def sided(batches: Iterator[pa.RecordBatch], units: Units, label: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, slot, n) of the words that are no units: class before (from 0), class after (from CLASSES)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    slots = 2 * CLASSES

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, slot, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, nth = np.unique(h, return_inverse=True)
        key, inverse = np.unique(nth * slots + slot, return_inverse=True)  # numbers sort faster than pairs
        return word[key // slots], key % slots, np.bincount(inverse, n, minlength=len(key)).astype(np.int64)

    def out(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch({"h": x[0].view(np.int64), "slot": x[1].astype(np.int32), "n": x[2].astype(np.int64)})

    for _, block in split(batches):
        t = tokens(block)
        unit = units.contexts(t)
        mine = np.flatnonzero(unit >= units.room)  # never the end, so a token follows in the text
        word, nth = np.unique(t.hashes[mine], return_inverse=True)
        key, n = np.unique(np.concatenate([nth * slots + label[before(unit)[mine]], nth * slots + CLASSES + label[unit[mine + 1]]]), return_counts=True)
        held.append((word[key // slots], key % slots, n))
        if sum(len(x[0]) for x in held) > HELD:
            held = [merged()]
            if len(held[0][0]) > HELD // 2:
                yield out(held.pop())
    if held:
        yield out(merged())


ASSIGNED = "h long, n long, class int, cell int"


def assigned(batches: Iterator[pa.RecordBatch], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """From rows (h, slot, n) sorted by h: (h, n, class) of each word, and (cell, n) of class bigrams that end in such words."""
    tables = np.concatenate([n, n.T])  # for class before i, row i: its pairs with each class; for class after, likewise
    # What so few more pairs add to the likelihood is looked up; most words are rare.
    few = np.stack([xlogx(tables + k) - xlogx(tables) for k in range(FEW + 1)])
    rows, columns = n.sum(1), n.sum(0)
    cells = np.zeros(CLASSES * CLASSES, np.int64)

    def weighed(h: np.ndarray, slot: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        gain = np.zeros((len(start), CLASSES))
        word = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))
        for a in range(0, len(h), WEIGHED):
            part = slice(a, a + WEIGHED)
            many = count[part] > FEW
            more = few[np.where(many, 0, count[part]), slot[part]]
            base = tables[slot[part][many]]
            more[many] = xlogx(base + count[part][many, None]) - xlogx(base)
            cut = np.flatnonzero(np.concatenate([[True], np.diff(word[part]) > 0]))
            gain[word[part][cut]] += np.add.reduceat(more, cut, axis=0)
        is_left = slot < CLASSES
        into, out_of = np.add.reduceat(count * is_left, start), np.add.reduceat(count * ~is_left, start)
        gain -= xlogx(rows + out_of[:, None]) - xlogx(rows) + xlogx(columns + into[:, None]) - xlogx(columns)
        best = gain.argmax(axis=1)
        cells[:] += np.bincount(slot[is_left] * CLASSES + best[word[is_left]], count[is_left], minlength=len(cells)).astype(np.int64)
        return pa.record_batch({"h": h[start], "n": into, "class": best.astype(np.int32), "cell": pa.nulls(len(start), pa.int32())})

    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = tuple(np.asarray(batch.column(c)).astype(np.int64) for c in ("h", "slot", "n"))
        if held is not None:
            new = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        cut = int(np.searchsorted(new[0], new[0][-1]))  # the last word may go on; a word has 2 * CLASSES rows at most
        if cut:
            yield weighed(*(x[:cut] for x in new))
        held = tuple(x[cut:] for x in new)
    if held is not None:
        yield weighed(*held)
    at = np.flatnonzero(cells)
    yield pa.record_batch({"h": pa.nulls(len(at), pa.int64()), "n": cells[at], "class": pa.nulls(len(at), pa.int32()), "cell": at.astype(np.int32)})


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each unit: each unit in turn moves to the class where the likelihood of class bigrams is largest."""
    size = len(pairs)
    mass = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-mass, kind="stable")
    label = np.zeros(size, np.int64)
    label[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), label] = 1.0
    n = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for u in order[mass[order] > 0]:
            right, left, own = pairs[u] @ member, pairs[:, u] @ member, pairs[u, u]
            a = label[u]
            right[a] -= own
            left[a] -= own
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= own
            # Margins as they are wherever the unit goes: pairs with it count in the other classes' rows and columns.
            rows, columns, diagonal = n.sum(1) + left, n.sum(0) + right, np.diag(n)
            # What the objective gains for each class c: entries of row c, of column c, the diagonal, the two margins.
            gain = (xlogx(n + right) - xlogx(n)).sum(1) + (xlogx(n + left[:, None]) - xlogx(n)).sum(0)
            each = np.arange(classes)
            gain -= xlogx(n[each, each] + right) + xlogx(n[each, each] + left) - 2 * xlogx(diagonal)
            gain += xlogx(diagonal + right + left + own) - xlogx(diagonal)
            out_of, into = right.sum() + own, left.sum() + own
            gain -= xlogx(rows + out_of) - xlogx(rows) + xlogx(columns + into) - xlogx(columns)
            c = int(np.argmax(gain))
            if gain[c] <= gain[a] + 1e-9:
                c = a
            moved += c != a
            member[u, a], member[u, c] = 0.0, 1.0
            label[u] = c
            n[c] += right
            n[:, c] += left
            n[c, c] += own
        if not moved:
            break
    return label


@dataclass
class ClassModel:
    cache: np.ndarray  # sorted hashes of the cached words
    cached_log: np.ndarray  # log10(count + ADDED)
    cached_class: np.ndarray
    units: Units
    label: np.ndarray  # class of each unit
    transition: np.ndarray  # log10 P(class | class before)
    divisor: np.ndarray  # log10 of each class's emission divisor


FLAT = "thash long, h long, tf long, rows long, n_tokens long, n_cached long, s_cached double, s_class double, context int, group int"


def flat(batches: Iterator[pa.RecordBatch], model: ClassModel) -> Iterator[pa.RecordBatch]:
    """A row for each text with its sums (tf 0), and one for each of its words outside the cache and class before it."""
    for batch, block in split(batches):
        t = tokens(block, named=True)
        at = np.minimum(np.searchsorted(model.cache, t.hashes), max(0, len(model.cache) - 1))
        known = model.cache[at] == t.hashes if len(model.cache) else np.zeros(len(t.hashes), bool)
        unit = model.units.contexts(t)
        context = model.label[before(unit)]
        log, step = np.zeros(len(unit)), np.zeros(len(unit))
        log[known] = model.cached_log[at[known]]
        own = model.cached_class[at[known]]
        step[known] = model.transition[context[known], own] - model.divisor[own]
        per_row = lambda x, first=t.first: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
        rare = np.flatnonzero(~known)
        row = np.repeat(np.arange(block.rows), np.diff(t.first))[rare]
        word, at_first, nth = np.unique(t.hashes[rare], return_index=True, return_inverse=True)
        key, tf = np.unique((row * max(1, len(word)) + nth) * CLASSES + context[rare], return_counts=True)
        c, nth, row = key % CLASSES, key // CLASSES % max(1, len(word)), key // CLASSES // max(1, len(word))
        who = np.concatenate([np.arange(block.rows), row])
        blank = np.zeros(len(key))
        texts = np.zeros(block.rows, np.int64)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id").take(pa.array(who)),
                "thash": t.texts[who].view(np.int64),
                "h": np.concatenate([t.texts, word[nth]]).view(np.int64),
                "tf": np.concatenate([texts, tf]),
                "rows": np.concatenate([texts + 1, blank.astype(np.int64)]),
                "n_tokens": np.concatenate([np.diff(t.first), blank.astype(np.int64)]),
                "n_cached": np.concatenate([per_row(known.astype(np.int64)), blank.astype(np.int64)]),
                "s_cached": np.concatenate([per_row(log), blank]),
                "s_class": np.concatenate([per_row(step), blank]),
                "context": np.concatenate([texts, c]).astype(np.int32),
                "group": np.concatenate([texts, model.label[model.units.room + t.suffix[rare[at_first[nth]]]]]).astype(np.int32),
            }
        )


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def frequent(counts: DataFrame, most: int) -> pa.Table:
    """Rows of the most frequent words, most frequent first: all that reach a count which ``most`` at most reach.

    The count is read off a histogram of TALLY rows, so no task sends more than it has of the result.
    """
    tally = sorted(counts.groupBy(F.least("n", F.lit(TALLY)).alias("n")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["n"])
    run, least = 0, None
    for r in tally:
        run += r["words"]
        if run > most:
            break
        least = r["n"]
    if least is None:
        return counts.limit(0).toArrow()
    return counts.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("h", "ascending")])


def learned(training: DataFrame) -> tuple[ClassModel, DataFrame, int, int]:
    """The model of texts (text), its words (h, n, class), training tokens and the least count in the cache."""
    spark = training.sparkSession
    counts = durable(training.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "h").limit(UNIT_WORDS).toArrow()
    units = Units.of(column(top, "h").view(np.uint64))
    shared = spark.sparkContext.broadcast(units)
    found = training.mapInArrow(lambda b: paired(b, shared.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    size = UNIT_WORDS + SUFFIX_UNITS
    pairs = np.zeros(size * size)
    pairs[column(found, "pair")] = column(found, "n")
    pairs = pairs.reshape(size, size)
    label = exchange(pairs, CLASSES, EXCHANGE_ROUNDS)
    member = (label[:, None] == np.arange(CLASSES)).astype(float)
    classes = member.T @ pairs @ member
    # Every other word, against the classes of the units. Counts are merged in each task, then by word.
    sides = training.mapInArrow(lambda b: sided(b, shared.value, label), "h long, slot int, n long").repartition("h").groupBy("h", "slot").agg(F.sum("n").alias("n"))
    own = durable(sides.sortWithinPartitions("h").mapInArrow(lambda b: assigned(b, classes), ASSIGNED))
    tops = [(int(h), int(label[u])) for h, u in zip(units.hashes.view(np.int64), units.number, strict=True)]
    of_units = counts.join(F.broadcast(spark.createDataFrame(tops, "h long, class int")), "h")  # UNIT_WORDS rows
    words = durable(own.where("cell is null").select("h", "n", "class").unionByName(of_units.select("h", "n", "class")))
    n = member.T @ pairs[:, :UNIT_WORDS] @ member[:UNIT_WORDS]
    ended = own.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n.reshape(-1)[column(ended, "cell")] += column(ended, "n")
    into = (n.sum(0) + 1) / (n.sum() + CLASSES)
    transition = np.log10((n + TRANSITION_PRIOR * into) / (n.sum(1, keepdims=True) + TRANSITION_PRIOR))
    by_class = words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    mass, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    mass[column(by_class, "class")], distinct[column(by_class, "class")] = column(by_class, "n"), column(by_class, "v")
    divisor = np.log10(mass + ADDED * (distinct + 1))
    cached = frequent(words, CACHED_WORDS)
    hashes = column(cached, "h").view(np.uint64)
    order = np.argsort(hashes)
    model = ClassModel(hashes[order], np.log10(column(cached, "n")[order] + ADDED), column(cached, "class")[order], units, label, transition, divisor)
    return model, words, total, int(column(cached, "n")[-1]) if len(cached) else 1 << 62


def score_texts(docs: DataFrame, held_out_fold: int = 0, folds: int = 10) -> DataFrame:
    """For each row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = in_fold(F.col("doc_id"), folds, held_out_fold)
    model, words, total, least = learned(docs.where(~held_out).select("text"))
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: flat(b, shared.value), f"doc_id {kind}, {FLAT}")
    joined = rows.join(words.where(F.col("n") < least).select("h", F.col("n").alias("c"), "class"), "h", "left")  # the cache has all others
    numbers = lambda x: F.split(F.lit(",".join(map(repr, x.reshape(-1).tolist()))), ",").cast("array<double>")
    own = F.coalesce("class", "group")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADDED))
    step = F.get(numbers(model.transition - model.divisor), F.col("context") * CLASSES + own)
    exact = lambda x: F.sum(x.cast("decimal(28,9)"))
    sums = joined.groupBy("doc_id", "thash").agg(
        F.sum("rows").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_cached") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        exact(F.when(F.col("tf") > 0, F.col("tf") * log).otherwise(F.col("s_cached"))).alias("emitted"),
        exact(F.when(F.col("tf") > 0, F.col("tf") * step).otherwise(F.col("s_class"))).alias("classed"),
    )
    one = lambda c: F.col(c).cast("double") / F.col("copies")
    whole_log = float(np.log10(int(total["n"]) + ADDED * (int(total["v"]) + 1)))
    score = one("emitted") + one("classed")
    sums = durable(sums)
    return dealt(sums, F.col("copies"), "copy", ["doc_id", "thash"], sums).select(
        "doc_id",
        held_out.alias("held_out"),
        one("n_tokens").cast("long").alias("n_tokens"),
        one("n_known").cast("long").alias("n_known"),
        F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (one("emitted") - one("n_tokens") * F.lit(whole_log)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / one("n_tokens")).alias("perplexity"),
    )
