"""URL filters by a bit-parallel wildcard automaton.

Rules are globs over a canonical URL, that is host and path (and, for glob rules of the method, the query behind a ?).
In a glob ``*`` stands for any run of bytes but ``/``, ``**`` for any run at all; all else stands for itself. A host rule
(host, path) is two globs, ``host path**`` and ``*.host path**``, so that it fits its host and all subdomains.

All globs are packed end to end into one bit vector of several 64-bit words, a bit for each state "so many signs of this
glob are read". A byte moves all states of all globs at once, by the extended Shift-And step

    D = ((D << 1) & reads[byte]) | (D & stays[byte])

where ``reads`` holds the states that a byte leads into and ``stays`` those that a star lets it stay in; the bit shifted
out of a word enters the next one, and no byte leads into a glob's first state. URLs of a batch are stepped together, the
longer ones last, straight from the Arrow buffer, so memory follows the batch and not the longest URL squared. The masks
are of a size that the rules fix; each URL is judged where it is read, without a shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is blocked by the
method as no address. A URL that no host rule fits has the verdict of the longest glob of the method that matches it, and
is allowed if none does. Of fitting rules the longest wins (letters of host and path), then the one with the longer host,
then a blocking one. Repeated rows are judged alike, one row for each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.blocks import split

#: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: (verdict, glob) of URLs that no host rule fits: machinery of sites and files that hold no prose, and what is wanted in spite of it.
GLOBS = (
    ("block", "*/wp-admin/**"),
    ("block", "*/login**"),
    ("block", "*/**/login**"),
    ("block", "*/cart/**"),
    ("block", "ads.**"),
    ("block", "*/**.css"),
    ("block", "*/**.js"),
    ("block", "*/**.jpg"),
    ("block", "*/**.png"),
    ("block", "*/**.zip"),
    ("block", "*/**?**sessionid=**"),
    ("block", "*/**?**page=*"),
    ("block", "*/**?**page=*&**"),
    ("allow", "docs.*/**?**page=*"),
)
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or end, A-Z lower-cased; empty if there is no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ? # or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """What follows the path up to # or end, with its ?."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^?#]*(\?[^#]*)", 1)


def signs(glob: str) -> list[int | None | str]:
    """A glob's signs: bytes, ``*`` for a run within a part, ``**`` for any run."""
    out: list[int | str] = []
    for k, part in enumerate(glob.split("**")):
        out += ["**"] * (k > 0)
        for j, piece in enumerate(part.split("*")):
            out += ["*"] * (j > 0)
            out += list(piece.encode())
    return out


@dataclass
class Automaton:
    """Masks of packed globs, as arrays of 64-bit words, the lowest bits first."""

    start: np.ndarray  # words
    reads: np.ndarray  # 256, words
    stays: np.ndarray  # 256, words
    accepting: np.ndarray  # state of each glob that accepts

    @classmethod
    def of(cls, globs: Sequence[str]) -> Automaton:
        states = sum(1 + sum(isinstance(s, int) for s in signs(g)) for g in globs)
        bits = np.zeros((2, 256, states), bool)
        first, accepting, at = np.zeros(states, bool), [], -1
        for glob in globs:
            at += 1
            first[at] = True
            for sign in signs(glob):
                if isinstance(sign, int):
                    at += 1
                    bits[0, sign, at] = True
                else:
                    bits[1, :, at] = True
                    bits[1, ord("/"), at] &= sign == "**"
            accepting.append(at)
        return cls(packed(first), packed(bits[0]), packed(bits[1]), np.array(accepting, np.int64))

    def matched(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text (bytes between offsets) and glob, whether the glob matches the whole text."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        begin, left = offsets[:-1][order], np.sort(-sizes)
        now = np.tile(self.start, (len(sizes), 1))
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(left, -step, side="left"))  # longer than step
            byte, d = data[begin[:live] + step], now[:live]
            up = d << np.uint64(1)
            up[:, 1:] |= d[:, :-1] >> np.uint64(63)
            now[:live] = (up & self.reads[byte]) | (d & self.stays[byte])
        out = np.empty((len(sizes), len(self.accepting)), bool)
        word, bit = self.accepting >> 6, (self.accepting & 63).astype(np.uint64)
        out[order] = (now[:, word] >> bit) & np.uint64(1)
        return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as 64-bit words, the first in the lowest bit."""
    room = -(-max(1, bits.shape[-1]) // 64) * 64
    wide = np.zeros((*bits.shape[:-1], room), bool)
    wide[..., : bits.shape[-1]] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8").astype(np.uint64)


def host_globs(name: str, start: str) -> tuple[str, str]:
    """Globs of a host rule: the host itself, and its subdomains."""
    return f"{name}{start}**", f"*.{name}{start}**"


def best(matched: np.ndarray, order: Sequence[int]) -> np.ndarray:
    """The first in order that matches, or -1."""
    out = np.full(len(matched), -1, np.int64)
    for k in reversed(order):
        out[matched[:, k]] = k
    return out


def judged(batches: Iterable[pa.RecordBatch], rules: Sequence[tuple[str, str, str]], globs: Sequence[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Adds rule and verdict to rows that have host, canonical (host and path) and asked (with the query)."""
    by_host = Automaton.of([g for _, name, start in rules for g in host_globs(name, start)])
    by_glob = Automaton.of([g for _, g in globs])
    rule_order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), -len(rules[k][1]), rules[k][0] != BLOCK, k))
    glob_order = sorted(range(len(globs)), key=lambda k: (-len(globs[k][1]), globs[k][0] != BLOCK, k))
    names = np.array([*(name + start for _, name, start in rules), None], object)  # the last stands for none
    said = np.array([*(v for v, _, _ in rules), None], object)
    for batch, block in split(batches, "asked"):
        hosted = np.asarray(batch.column("hosted"), dtype=np.int64)  # bytes of host and path
        asked = by_glob.matched(block.data, block.offsets)
        # Host and path are a prefix of what is asked: stepped on their own, as rows of their own length.
        fit = by_host.matched(*prefixes(block.data, block.offsets, hosted))
        rule = best(fit.reshape(len(hosted), len(rules), 2).any(axis=2), rule_order)
        glob = best(asked, glob_order)
        default = np.where(hosted > 0, ALLOW, BLOCK).astype(object)
        own = np.where(glob < 0, default, np.array([*(v for v, _ in globs), ""], object)[glob])
        verdict = np.where(rule < 0, own, said[rule])
        yield pa.record_batch(
            {
                "page_id": batch.column("page_id"),
                "host": batch.column("host"),
                "path": batch.column("path"),
                "rule": pa.array(names[rule], pa.string()),
                "verdict": pa.array(verdict, pa.string()),
                "method_glob": pa.array(np.array([*(g for _, g in globs), None], object)[glob], pa.string()),
            }
        )


def prefixes(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first so many bytes of each text, end to end."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], sizes)
    return data[at], ends


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS) -> DataFrame:
    """For each row of pages (page_id, url): host, path, rule, verdict, and the glob of the method that matches."""
    kind = pages.schema["page_id"].dataType.simpleString()
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), query(F.col("url")).alias("query"))
    rows = parts.select("page_id", "host", "path", F.concat("host", "path", "query").alias("asked"), F.octet_length(F.concat("host", "path")).cast("long").alias("hosted"))
    return rows.mapInArrow(lambda b: judged(b, rules, globs), f"page_id {kind}, host string, path string, rule string, verdict string, method_glob string")
