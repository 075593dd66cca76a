"""Repair of conversations' structure by shortest paths through an edit lattice.

A node of the lattice is (turns read, state of the role grammar `(s?(ua)+)?`): 0 nothing yet, 1 after the system turn, 2
after a user, 3 after an assistant; 0 and 3 accept at the end. An edge keeps, reroles or deletes the next turn, or
inserts one. The lattice is implicit: Dijkstra's search makes nodes as it reaches them, with the priority (cost, audit), and
stops at the first accepting end node that it pops. Two paths to a node with equal costs have different audits, neither of
which begins the other, so the least key of a node stays least whatever follows.

Rows are dealt out and sorted by ranges of conversation and turn, so a conversation of very many turns stands in several
tasks. One that lies within a task and has at most PIECE_ROWS turns is repaired there. Others are cut into such pieces; each
is searched from every state to every state, and the pieces' tables, read in order, give the whole path: a table is an
edge of the lattice of pieces. What one task then holds of a conversation is its audit, a letter for each turn, which is
the result's own size; its texts pass through in order, into the hash that the result asks for. Repeated rows are merged
before the shuffle, and turns that repeat another turn's role and text are found by sums of keys, so neither is a hot spot.

Defined results: a null conv_id, turn, role or text counts as one space where it is written (rows without conv_id are a
conversation of their own, with a null id); turns of equal number go by role, then text; an empty role fits no state;
conversations all of whose turns are dropped have zeros; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidepool.llm.streams import in_order
from tidepool.llm.tables import durable

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: From a state, the role whose turn it is, and the state after it; a system turn leads from 0 to 1 as well.
WANTED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")
#: Turns and letters of a piece.
PIECE_ROWS, PIECE_CHARS = 512, 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
FACTS = ("blank", "duplicate", "truncated", "illegal")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with the damage that crc32 of conv_id:turn deals out; dropped rows have no copies."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), written("role").alias("role"), written("text").alias("text"), (F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20).alias("fate"))
    fate = F.col("fate")
    return rows.select(
        "conv_id", "turn",
        F.when(fate == 0, "").when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate <= 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Merges equal rows, and adds blank, ended (the last sign ends a sentence) and again (an earlier turn says the same)."""
    key = lambda: F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"))
    body = F.rtrim("text", F.lit(BLANKS))
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    said = rows.where((F.col("copies") > 0) & (body != "")).select(key().alias("key"), when.alias("when"))
    first = said.groupBy("key").agg(F.min("when").alias("first"), F.max("when").alias("last")).where("first < last").select("key", "first")
    out = merged.withColumn("key", key()).join(first, "key", "left")
    return out.select("conv_id", "turn", "role", "text", "copies", (body == "").alias("blank"), F.right(body, F.lit(1)).isin(".", "!", "?").alias("ended"), F.coalesce(when > F.col("first"), F.lit(False)).alias("again"))


# The search. A turn is a sign: d must go, s u a x is its role's initial (x: another), a capital one is truncated.


def search(signs: str, entry: int, exits: tuple[int, ...], all_exits: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest path from an entry state to the first exit popped, or to each exit that is reached."""
    heap, done, found = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(signs) and state in exits:
            found[state] = (cost, audit)
            if not all_exits:
                break
        heappush(heap, (cost + INSERT_COST, audit + INSERT, at, AFTER[state]))
        if at == len(signs):
            continue
        heappush(heap, (cost + DELETE_COST, audit + DELETE, at + 1, state))
        sign = signs[at]
        if sign == "d":
            continue
        more = cost + TRUNCATED_COST * sign.isupper()
        heappush(heap, (more + REROLE_COST, audit + REROLE, at + 1, AFTER[state]))
        initial = sign.lower()
        if initial == "s" and state == 0:
            heappush(heap, (more, audit + KEEP, at + 1, 1))
        elif initial == WANTED[state][0]:
            heappush(heap, (more, audit + KEEP, at + 1, AFTER[state]))
    return found


@lru_cache(maxsize=1 << 14)
def cheapest(signs: str) -> tuple[int, str]:
    return next(iter(search(signs, 0, ACCEPTING).values()))


def joined(now: dict[int, tuple[int, str]], table: list[list]) -> dict[int, tuple[int, str]]:
    """Cheapest paths to each state after one more piece; table has (entry, exit, cost, audit)."""
    out: dict[int, tuple[int, str]] = {}
    for entry, leave, cost, audit in table:
        if entry in now:
            whole = now[entry][0] + cost
            if leave not in out or whole < out[leave][0] or (whole == out[leave][0] and now[entry][1] + audit < out[leave][1]):
                out[leave] = (whole, now[entry][1] + audit)
    return out


def lines(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """The repaired turns as role:text; rows has (role, text) of every turn before the repair."""
    state, rows = 0, iter(rows)
    for letter in audit:
        if letter == INSERT:
            yield WANTED[state] + ":"
        else:
            role, text = next(rows)
            if letter == DELETE:
                continue
            if letter == KEEP and role[:1] == "s":
                state = 1
                yield f"{role}:{text}"
                continue
            yield f"{WANTED[state] if letter == REROLE else role}:{text}"
        state = AFTER[state]


# The passes over sorted rows.


class Piece:
    """Consecutive turns of a conversation, with what is counted over them."""

    def __init__(self) -> None:
        self.signs: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.chars = 0
        self.facts = dict.fromkeys(FACTS, 0)
        self.first = self.last = None  # initials
        self.least = self.most = None  # turns
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, ended: bool, again: bool) -> None:
        fault = "blank" if blank else "duplicate" if again else "" if ended else "truncated"
        if fault:
            self.facts[fault] += 1
        initial = role[:1]
        sign = initial if initial in ("s", "u", "a") else "x"
        self.signs.append({"": sign, "truncated": sign.upper()}.get(fault, "d"))
        if self.last is None:
            self.first = initial
        else:
            self.facts["illegal"] += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            if turn != self.most:
                self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.rows.append((role, text))
        self.chars += len(text) + len(role)

    def summary(self) -> dict:
        return {"facts": self.facts, "first": self.first, "last": self.last, "least": self.least, "most": self.most, "turns": self.turns}


def followed(a: dict, b: dict) -> dict:
    """The summary of two consecutive pieces."""
    out = {"facts": {k: a["facts"][k] + b["facts"][k] for k in FACTS}, "first": a["first"] if a["last"] is not None else b["first"], "last": b["last"] if b["last"] is not None else a["last"]}
    if a["last"] is not None and b["last"] is not None:
        out["facts"]["illegal"] += a["last"] + b["first"] not in LEGAL
    out |= {"least": b["least"] if a["least"] is None else a["least"], "most": a["most"] if b["most"] is None else b["most"]}
    out["turns"] = a["turns"] + b["turns"] - (a["most"] is not None and a["most"] == b["least"])
    return out


def result(summary: dict, cost: int, audit: str, digest: str | None) -> dict:
    gaps = 0 if summary["least"] is None else summary["most"] - summary["least"] + 1 - summary["turns"]
    return {"gaps": gaps, **summary["facts"], "cost": cost, "audit": audit, "repaired_sha256": digest}


def hashed(texts: Iterable[str]) -> str:
    digest, first = hashlib.sha256(), True
    for t in texts:
        digest.update(t.encode() if first else b"\n" + t.encode())
        first = False
    return digest.hexdigest()


RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
#: Of an open conversation: its pieces (facts: summary and table), and its turns (nth from 0).
OPEN = {"part": "long", "seq": "long", "nth": "long", "role": "string", "text": "string", "facts": "string"}
ARROW = {"long": pa.int64(), "string": pa.string()}


class Sink:
    """Rows on their way into record batches of bounded size."""

    def __init__(self, kind: pa.DataType, columns: dict[str, str]) -> None:
        self.schema = pa.schema([("conv_id", kind), *((k, ARROW[v]) for k, v in columns.items())])
        self.rows: list[dict] = []
        self.chars = 0

    def put(self, **row) -> None:
        self.rows.append(row)
        self.chars += sum(len(v) for v in row.values() if isinstance(v, str))

    def full(self) -> bool:
        return len(self.rows) >= 4096 or self.chars >= PIECE_CHARS

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.chars = [], 0
        return out


def in_rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # few rows as Python objects at a time
            piece = batch.slice(at, 256)
            yield from zip(*(piece.column(c).to_pylist() for c in columns), strict=True)


def passed(batches: Iterator[pa.RecordBatch], kind: pa.DataType, most: int) -> Iterator[pa.RecordBatch]:
    """Repairs conversations that lie within the task; passes others on as pieces and turns."""
    sink, piece, run, seq, first, begun, part = Sink(kind, RESULT | OPEN), Piece(), None, 0, True, False, 0

    def close(goes_on: bool) -> None:
        nonlocal piece, seq
        signs = "".join(piece.signs)
        if seq == 0 and not first and not goes_on:
            cost, audit = cheapest(signs)
            sink.put(conv_id=run, **result(piece.summary(), cost, audit, hashed(lines(audit, piece.rows))))
        else:
            table = [(entry, leave, *path) for entry in range(4) for leave, path in search(signs, entry, (0, 1, 2, 3), True).items()]
            sink.put(conv_id=run, part=part, seq=seq, facts=json.dumps([piece.summary(), table]))
            for nth, (role, text) in enumerate(piece.rows):
                sink.put(conv_id=run, part=part, seq=seq, nth=nth, role=role, text=text)
        piece, seq = Piece(), seq + 1

    for conv, number, turn, role, text, copies, blank, ended, again in in_rows(batches, "conv_id", "part", "turn", "role", "text", "copies", "blank", "ended", "again"):
        if begun and conv != run:
            close(False)
            first, seq = False, 0
        run, part, begun = conv, number, True
        for copy in range(copies):
            if len(piece.rows) >= most or piece.chars >= PIECE_CHARS:
                close(True)
            piece.add(turn, role, text, blank, ended, again or copy > 0)
            if sink.full():
                yield sink.batch()
        if sink.full():
            yield sink.batch()
    if begun:
        close(True)  # it may go on in the next task
    yield sink.batch()


def completed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Repairs conversations of several pieces; of each, all pieces come first, then its turns, in order."""
    sink = Sink(kind, RESULT)
    for conv, rows in groupby(in_rows(batches, "conv_id", "nth", "role", "text", "facts"), key=lambda r: r[0]):
        now, whole, head = {0: (0, "")}, None, ()
        for _, nth, role, text, facts in rows:
            if nth is not None:
                head = ((role, text),)
                break
            summary, table = json.loads(facts)
            now, whole = joined(now, table), summary if whole is None else followed(whole, summary)
        cost, audit = min(now[state] for state in ACCEPTING if state in now)
        sink.put(conv_id=conv, **result(whole, cost, audit, hashed(lines(audit, chain(head, ((role, text) for _, _, role, text, _ in rows))))))
        if sink.full():
            yield sink.batch()
    yield sink.batch()


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """For each conversation (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``conversations`` are repaired as they are; ``copies`` says how often a row stands there (0: only its conv_id does).
    """
    field = conversations.schema["conv_id"]
    kind = to_arrow_type(field.dataType)
    name = field.dataType.simpleString()
    said = lambda columns: ", ".join([f"conv_id {name}", *(f"{k} {v}" for k, v in columns.items())])
    rows = in_order(marked(conversations), "conv_id", "turn", "role", "text")
    out = durable(rows.mapInArrow(lambda b: passed(b, kind, piece_rows), said(RESULT | OPEN)))
    order = [F.col("conv_id"), F.col("nth").isNotNull(), F.col("part"), F.col("seq"), F.col("nth")]
    rest = out.where("part is not null").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(lambda b: completed(b, kind), said(RESULT))
    return out.where("part is null").select("conv_id", *RESULT).unionByName(rest)
