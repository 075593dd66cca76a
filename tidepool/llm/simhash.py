"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits, cut into segments of 21, 21 and 22 bits. Two fingerprints that differ in at most 4 bits
differ in at most one bit of the first, or at most one of the second, or in none of the third: otherwise they would
differ in 2 + 2 + 1 bits at least. So each distinct fingerprint stands in a table by its segments, and small Hamming
balls (radius 1, 1 and 0) around its segments fetch the matches; complete distances are then verified. Buckets of so few
bits would grow with the square of very many fingerprints, so beyond a count there are two segments of 30 and 34 bits with
radius 1 and 2 instead (2 + 3 exceeds 4 as well); the links are the same. Balls only clear bits: of two segments that
differ in one bit exactly one holds a 1 there, and of two that differ in two bits either one holds both, and clearing
both finds the other, or each holds one, and they meet where each has cleared its own.

Equal fingerprints meet before any search. A bucket of very many fingerprints is dealt to several tasks: its members are
cut into parts, and each pair of parts is a bucket of its own. From a large bucket only the links of a spanning forest
leave the task, so the links grow with the distinct fingerprints and no pair of different texts that are linked ends in
different classes.

Defined results: null and empty texts have fingerprint zero, linked like any other; texts of fewer words than a shingle
have one shingle of all their words; repeated rows share a class; a null doc_id takes part but never names a class while
another id is there; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.blocks import SPACED, split
from tidepool.llm.components import components
from tidepool.llm.tables import bounded, durable

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: First bit, bits and radius of each segment: the sum of (radius + 1) exceeds RADIUS.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
WIDE_SEGMENTS = ((0, 30, 1), (30, 34, 2))
#: Beyond so many distinct fingerprints, some 200 a bucket, the wide segments are used.
WIDE_FROM = 400_000_000
#: Fingerprints of one segment that one task holds.
BUCKET_PART = 50_000
#: Buckets with more pairs of owners and members give a spanning forest instead of each pair.
LARGE_BUCKET = 4096


def fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch, block in split(batches):
        low = block.lowered()
        starts, ends, first = low.words(SPACED)
        line, at = low.joined(starts, ends)  # a shingle is a slice
        last = np.repeat(first[1:], np.diff(first))
        begin = np.flatnonzero((np.arange(len(starts)) + words <= last) | (np.arange(len(starts)) == np.repeat(first[:-1], np.diff(first))))
        stop = np.minimum(begin + words, last[begin])
        view = memoryview(line)
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)], dtype=np.uint64)
        limits = np.searchsorted(begin, first)
        out = np.zeros(block.rows, np.uint64)
        for bit in range(64):
            run = np.zeros(len(hashes) + 1, np.int64)
            np.cumsum((hashes >> np.uint64(bit)) & np.uint64(1), out=run[1:])
            ones = run[limits[1:]] - run[limits[:-1]]
            out |= (2 * ones > np.diff(limits)).astype(np.uint64) << np.uint64(bit)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "bits": out.view(np.int64)})


def probes(batches: Iterator[pa.RecordBatch], segments: tuple[tuple[int, int, int], ...] = SEGMENTS) -> Iterator[pa.RecordBatch]:
    """(key, bits, visit) of each fingerprint under its own segments and under those with 1s cleared, up to the radius.

    visit is the number of bits that were cleared.
    """
    for batch in batches:
        bits = np.asarray(batch.column("bits")).view(np.uint64)
        keys, owners, visits = [], [], []
        for number, (low, size, radius) in enumerate(segments):
            segment = (bits >> np.uint64(low)) & np.uint64((1 << size) - 1)
            tag = np.uint64(number << 40)
            for cleared in range(radius + 1):
                for chosen in combinations(range(size), cleared):
                    mask = np.uint64(sum(1 << k for k in chosen))
                    own = segment & mask == mask
                    keys.append((segment[own] ^ mask) | tag)
                    owners.append(bits[own])
                    visits.append(np.full(int(own.sum()), cleared, np.int8))
        yield pa.record_batch({"key": np.concatenate(keys).view(np.int64), "bits": np.concatenate(owners).view(np.int64), "visit": np.concatenate(visits)})


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def pairs(limits: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each of a bucket's first ``owners`` and of all that follow it there."""
    sizes = np.diff(limits)
    n = int(owners.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = np.arange(n) - np.repeat(np.cumsum(owners) - owners, owners)
    left = np.repeat(limits[:-1], owners) + within
    follow = np.repeat(sizes, owners) - 1 - within
    step = np.arange(int(follow.sum())) - np.repeat(np.cumsum(follow) - follow, follow)
    return np.repeat(left, follow), np.repeat(left, follow) + 1 + step


def forest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within RADIUS in one large bucket, one for each point at most.

    Breadth first: a point that is reached is compared once with those that aren't. Pairs of visitors only add true links.
    """
    left, a, b = np.arange(len(points)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            hit = near(points[left], points[at])
            reached = left[hit]
            a.append(np.full(len(reached), points[at]))
            b.append(points[reached])
            front += reached.tolist()
            left = left[~hit]
    return np.concatenate([*a, np.zeros(0, np.uint64)]), np.concatenate([*b, np.zeros(0, np.uint64)])


def solved(most: int, key: np.ndarray, part: np.ndarray, bits: np.ndarray, visit: np.ndarray) -> pa.RecordBatch:
    """Links of whole buckets. Two may be near where one has cleared ``most`` bits at most; those come first."""
    limits = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
    owners = np.diff(np.concatenate([[0], np.cumsum(visit <= most)])[limits])
    large = owners * np.diff(limits) > LARGE_BUCKET
    x, y = pairs(limits, np.where(large, 0, owners))
    hit = near(bits[x], bits[y])
    a, b = [bits[x][hit]], [bits[y][hit]]
    for k in np.flatnonzero(large):
        more = forest(bits[limits[k] : limits[k + 1]])
        a.append(more[0])
        b.append(more[1])
    return pa.record_batch({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def linked(batches: Iterator[pa.RecordBatch], segments: tuple[tuple[int, int, int], ...] = SEGMENTS) -> Iterator[pa.RecordBatch]:
    """Links of each bucket, from rows sorted by key, part and visit.

    With radius 1 one of two is an owner; with radius 2 one is an owner or both have cleared one bit.
    """
    most = max(0, max(radius for *_, radius in segments) - 1)
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = (np.asarray(batch.column("key")), np.asarray(batch.column("part")), np.asarray(batch.column("bits")).view(np.uint64), np.asarray(batch.column("visit")))
        key, part = new[0], new[1]
        # The last bucket may go on in the next batch.
        cut = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))[-1])
        if held and (cut or held[-1][0][-1] != key[0] or held[-1][1][-1] != part[0]):
            ends = cut or 0
            whole = [*held, tuple(x[:ends] for x in new)]
            yield solved(most, *(np.concatenate(x) for x in zip(*whole, strict=True)))
            held = [tuple(x[ends:] for x in new)]
        elif cut:
            yield solved(most, *(x[:cut] for x in new))
            held = [tuple(x[cut:] for x in new)]
        else:
            held.append(new)
    if held:
        yield solved(most, *(np.concatenate(x) for x in zip(*held, strict=True)))


def fingerprint(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, bits) for each row of docs (doc_id, text); text_key is a hash of the text."""
    rows = docs.select("doc_id", "text", text_key())
    return rows.mapInArrow(lambda batches: fingerprints(batches, words), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, bits long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def links(distinct: DataFrame, segments: tuple[tuple[int, int, int], ...] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (bits), enough of them to join each class."""
    if segments is None:
        segments = SEGMENTS if distinct.count() <= WIDE_FROM else WIDE_SEGMENTS
    probed = distinct.select("bits").mapInArrow(lambda batches: probes(batches, segments), "key long, bits long, visit byte")
    # Segments that very many fingerprints share, counted by the owners: few, since fingerprints are distinct.
    own = [F.shiftrightunsigned("bits", low).bitwiseAND(F.lit((1 << size) - 1)).bitwiseOR(F.lit(k << 40)) for k, (low, size, _) in enumerate(segments)]
    hot = distinct.select(F.explode(F.array(*own)).alias("hot")).groupBy("hot").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_PART)
    hot = durable(hot.select("hot", F.ceil(F.col("n") / F.lit(BUCKET_PART)).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != mine)
    # Parts are pairs of parts of the bucket; a bucket of one part is a pair with itself.
    each = F.when(F.col("parts").isNull() | (F.col("parts") < 2), F.array(F.lit(0))).otherwise(F.transform(other, lambda k: F.least(k, mine) * F.col("parts") + F.greatest(k, mine)))
    dealt = probed.join(bounded(hot), F.col("key") == F.col("hot"), "left").select("key", F.explode(each).alias("part"), "bits", "visit")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "visit").mapInArrow(lambda batches: linked(batches, segments), "a long, b long")


def rooted(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, bits) of each row, and (bits, least, root): the smallest doc_id and the class of each fingerprint.

    The root is the smallest fingerprint of a class, so it tells classes apart where doc_ids are null or repeated.
    """
    prints = durable(fingerprint(docs, words))
    distinct = durable(prints.groupBy("bits").agg(F.min("doc_id").alias("least")))
    found = components(durable(links(distinct)))
    return prints, distinct.join(found, distinct["bits"] == found["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, bits, component_id): each row's fingerprint and the smallest doc_id that links reach from it."""
    prints, least = rooted(docs, words)
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    # Plain joins, so that adaptive execution can split a hot fingerprint or class.
    return prints.join(least.join(roots, "root").select("bits", "component_id"), "bits").select("doc_id", "text_key", "bits", "component_id")


def deduplicated(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Docs with one row of each class: the one of the smallest doc_id, null last (then text hash); of rows equal in both, one.

    The choice is made on ids and hashes; whole rows travel once, those equal in id and text together.
    """
    prints, least = rooted(docs, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("c")
    chosen = prints.join(least.select("bits", "root"), "bits").groupBy("root").agg(first).select("c.doc_id", F.col("c.text_key").alias("text_key"))
    a, b = named(F.col("doc_id"), F.col("text_key"))
    keyed = docs.select("*", *named(F.col("doc_id"), text_key())).dropDuplicates(["__a", "__b"])
    return keyed.join(chosen.select(a, b), ["__a", "__b"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def named(doc_id: Column, key: Column) -> tuple[Column, Column]:
    """Hashes of doc_id and of both it and the text's key; never null."""
    return F.xxhash64(doc_id, doc_id.isNull(), key).alias("__a"), F.hash(key, doc_id).alias("__b")
