"""SHA-256 over long runs of rows in order, without holding a run in a task.

Rows are dealt out by ranges of their key and order, so a run of very many rows stands in several tasks. A run that lies
within one task is hashed there. Of one that may go on in the next task, each task writes its part as strings of bounded
size; these alone are streamed in order through one task for each run, as SHA-256 itself goes through its input in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.tables import durable

#: Letters of a run's part in one string.
PART_CHARS = 1 << 16


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out and sorted by ranges of keys, with the number of the range as ``part``."""
    return rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("part", F.spark_partition_id().cast("long"))


def _pieces(batches: Iterator[pa.RecordBatch], a: str, b: str, item: str, limit: int) -> Iterator[pa.RecordBatch]:
    """(a, b, part, seq, whole, joined) of sorted rows: whole runs with their digest, others' parts as strings."""
    out: list[tuple] = []
    run, held, chars, seq, first, part = None, [], 0, 0, True, 0

    def flush(last: bool) -> None:
        nonlocal held, chars, seq
        joined = ",".join(held)
        if seq == 0 and not first and not last:
            out.append((*run, part, 0, True, hashlib.sha256(joined.encode()).hexdigest()))
        else:
            out.append((*run, part, seq, False, joined))
        held, chars, seq = [], 0, seq + 1

    def sent() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[a, b, "part", "seq", "whole", "joined"])
        out.clear()
        return batch

    for batch in batches:
        for x, y, value, number in zip(*(batch.column(c).to_pylist() for c in (a, b, item, "part")), strict=True):
            part = number
            if run != (x, y):
                if run is not None:
                    flush(False)
                    first = False
                run, seq = (x, y), 0
            if chars > limit:
                seq = max(seq, 1)  # no whole run any more
                flush(False)
            held.append(str(value))
            chars += len(held[-1]) + 1
        if out:
            yield sent()
    if run is not None:
        flush(True)
    yield sent()


def _streamed(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    run, digest, out = None, None, []
    for batch in batches:
        for x, y, joined in zip(*(batch.column(c).to_pylist() for c in (a, b, "joined")), strict=True):
            if run != (x, y):
                if run is not None:
                    out.append((*run, digest.hexdigest()))
                run, digest = (x, y), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(joined.encode())
    if run is not None:
        out.append((*run, digest.hexdigest()))
    columns = list(zip(*out, strict=True)) or [[]] * 3
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=[a, b, "joined"])


def digests(rows: DataFrame, a: str, b: str, item: str, limit: int = PART_CHARS) -> DataFrame:
    """(a, b, digest): for each pair of long keys, the SHA-256 of its distinct items, ascending, joined by commas."""
    pieces = durable(in_order(rows.select(a, b, item), a, b, item).mapInArrow(lambda x: _pieces(x, a, b, item, limit), f"{a} long, {b} long, part long, seq long, whole boolean, joined string"))
    rest = pieces.where("not whole").repartition(a, b).sortWithinPartitions(a, b, "part", "seq").mapInArrow(lambda x: _streamed(x, a, b), f"{a} long, {b} long, joined string")
    return pieces.where("whole").select(a, b, F.col("joined").alias("digest")).unionByName(rest.select(a, b, F.col("joined").alias("digest")))
