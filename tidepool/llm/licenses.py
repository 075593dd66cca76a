"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice of n letters may differ by k edits. Cut into k + 1 pieces, at least one piece must stand unchanged
(pigeonhole), at most k letters from its place, so the exact pieces are seeds: one automaton (Aho-Corasick) finds all of
them in a pass over the text, and each hit names the few words that a notice may begin with. From each of these the
regex library's bounded-error matching verifies the best match and reports its span. Of matches that overlap, those with
the fewest edits are taken first, then those that begin first; what overlaps one taken before is left out, unless it is
another label's with as few edits. So what a better match doesn't cover is never lost.

Texts are compared as their words (A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) joined by single spaces; spans
are of words, from 0, the end exclusive. Further notices are a parameter.

Defined results: a null text counts as empty; an empty text has no words, no label and score 0; repeated rows are
scanned alike, one output row for each input row; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepool.llm.blocks import PLAIN, split

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices of well-known licenses, and the labels that this method adds.
NOTICES = (
    ("released under the mit license", "notice-mit"),
    ("licensed under the mit license", "notice-mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "notice-mit"),
    ("licensed under the apache license version 2 0", "notice-apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "notice-gpl-3"),
    ("under the terms of the gnu general public license", "notice-gpl"),
    ("under the terms of the gnu lesser general public license", "notice-lgpl"),
    ("gnu affero general public license", "notice-agpl"),
    ("licensed under cc by nc 4 0", "notice-cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "notice-cc-by-sa-4.0"),
    ("creative commons attribution", "notice-creative-commons"),
    ("redistribution and use in source and binary forms", "notice-bsd"),
    ("subject to the terms of the mozilla public license", "notice-mpl"),
    ("this is free and unencumbered software released into the public domain", "notice-unlicense"),
    ("all rights reserved", "notice-reserved"),
)
#: One edit for so many letters of a notice, and so many at most.
LETTERS_PER_EDIT, MOST_EDITS = 12, 3
SPAN = "struct<label:string,start:long,end:long,errors:int>"


def edits(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // LETTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """Offset and text of the k + 1 parts of nearly equal length."""
    parts = edits(notice) + 1
    cuts = [len(notice) * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


Notices = tuple[tuple[str, str], ...]


@lru_cache(maxsize=4)
def compiled(notices: Notices) -> tuple[ahocorasick.Automaton, list[tuple[regex.Pattern, str, int, int]]]:
    """The automaton of seeds, valued (length, [(notice, offset)], phrase or None), and the notices' verifiers."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    verifiers = []
    for k, (notice, label) in enumerate(notices):
        for at, piece in pieces(notice):
            seeds.setdefault(piece, []).append((k, at))
        # (?b): of the matches from a place on, that with the fewest errors; whole words only.
        verifiers.append((regex.compile(rf"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits(notice)}}}(?![^ ])"), label, edits(notice), len(notice)))
    automaton = ahocorasick.Automaton()
    for word in sorted({*seeds, *(f" {p} " for p in PHRASES)}):
        automaton.add_word(word, (len(word), seeds.get(word, []), word.strip(" ") if word.startswith(" ") and word.strip(" ") in PHRASES else None))
    automaton.make_automaton()
    return automaton, verifiers


def hits(joined: str, notices: Notices) -> tuple[list[tuple[int, str]], set[tuple[int, int]]]:
    """Of words joined and enclosed by spaces: first letter and label of each base phrase, and (notice, begin) to verify."""
    automaton, verifiers = compiled(notices)
    bases, begins = [], set()
    for end, (size, uses, phrase) in automaton.iter(joined):
        at = end - size + 1
        if phrase is not None:
            bases.append((at, PHRASES[phrase]))
        for k, offset in uses:
            slack = verifiers[k][2]
            for begin in range(max(1, at - offset - slack), at - offset + slack + 1):
                if begin < len(joined) and joined[begin - 1] == " " != joined[begin]:
                    begins.add((k, begin))
    return bases, begins


def verified(joined: str, k: int, begin: int, notices: Notices) -> tuple[int, int, int, str] | None:
    """(errors, start, end, label) of the best match of a notice that begins here."""
    pattern, label, most, size = compiled(notices)[1][k]
    stop = joined.find(" ", min(len(joined) - 1, begin + size + most))  # whole words, so that an end is a word's end
    m = pattern.match(joined, begin, stop if stop >= 0 else len(joined))
    if not m or m.end() == begin or joined[m.end() - 1] == " ":
        return None
    return sum(m.fuzzy_counts), m.start(), m.end(), label


def chosen(found: Sequence[tuple[int, int, int, str]]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, errors) of the matches that are kept where some overlap."""
    taken: list[tuple[int, int, int, str]] = []  # (start, end, errors, label), by start
    longest = max((end - start for _, start, end, _ in found), default=0)
    for errors, start, end, label in sorted(set(found)):
        near = taken[bisect_left(taken, (start - longest,)) : bisect_right(taken, (end,))]
        if not any(s < end and start < e and (k < errors or name == label) for s, e, k, name in near):
            insort(taken, (start, end, errors, label))
    return [(label, start, end, errors) for start, end, errors, label in taken]


def scanned(batches: Iterator[pa.RecordBatch], notices: Notices = NOTICES) -> Iterator[pa.RecordBatch]:
    for batch, block in split(batches):
        low = block.lowered()
        starts, ends, first = low.words(PLAIN)
        line, at = low.joined(starts, ends)
        rows = []
        for a, b in zip(at[first[:-1]].tolist(), at[first[1:]].tolist(), strict=True):
            text = " " + line[a:b].decode("utf-8", "replace")
            bases, begins = hits(text, notices)
            spans = chosen([m for k, x in begins if (m := verified(text, k, x, notices))]) if begins else []
            # Words before a letter: spaces before it, but for the first.
            spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 0x20) if bases or spans else None
            nth = lambda x, spaces=spaces: int(np.searchsorted(spaces, x))
            rows.append((sorted((nth(x), label) for x, label in bases), [(label, nth(s) - 1, nth(e), errors, e - s) for label, s, e, errors in spans]))
        base = [sorted({label for _, label in p}) for p, _ in rows]
        score = [1.0 if p else max((1 - x[3] / (x[4] + x[3]) for x in s), default=0.0) for p, s in rows]
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_words": np.diff(first).astype(np.int64),
                "n_base": pa.array([len(p) for p, _ in rows], pa.int64()),
                "first_word": pa.array([p[0][0] if p else None for p, _ in rows], pa.int64()),
                "last_word": pa.array([p[-1][0] if p else None for p, _ in rows], pa.int64()),
                "base_labels": pa.array([",".join(b) for b in base], pa.string()),
                "labels": pa.array([",".join(sorted({*b, *(x[0] for x in s)})) for b, (_, s) in zip(base, rows, strict=True)], pa.string()),
                "score": pa.array(score, pa.float64()),
                "spans": pa.array([[{"label": x[0], "start": x[1], "end": x[2], "errors": x[3]} for x in s] for _, s in rows], SPAN_TYPE),
            }
        )


SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())]))


def scan_licenses(docs: DataFrame, notices: Notices = NOTICES) -> DataFrame:
    """For each row of docs (doc_id, text): words, places of base phrases, labels, score, and the notices' spans."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"
    return rows.mapInArrow(lambda batches: scanned(batches, notices), made)
