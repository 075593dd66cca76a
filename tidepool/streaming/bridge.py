"""Result files of an outside writer, merged into the index as a stream.

Each poll lists the result folder and appends what it saw, (path, signature, item_key, payload), to a log; the stream reads
the log's files once each. State is keyed by file: the signature that was merged last, failures in a row, and when to try
again. A file whose signature was merged is skipped. One that fails waits ``backoff`` of its failures, by a timer, and is
tried again with the payload that state holds; after ``tries`` it goes to the dead letters, until a new signature comes.
Checkpoint and state let a stream that was stopped go on where it was; what a batch writes is keyed by its number, so a
batch that is run again adds nothing. After a restart, Spark looks at timers with the next batch that has rows, which is
the next poll's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepool.sources.readers import bridge_results
from tidepool.streaming.incremental import backoff

SEEN = "path string, signature string, item_key string, payload string"
OUT = "path string, signature string, item_key string, status string, tries int, error string, documents string"
MERGED, SKIPPED, WAITING, DEAD = "merged", "skipped", "waiting", "dead"
#: Settings that keyed state with timers needs.
STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class Policy:
    """Seconds before the second try, at most between two, and tries in all."""

    base: float = 60.0
    most: float = 3600.0
    tries: int = 5


def poll(spark: SparkSession, results: str, log: str, pattern: str = "*.json") -> None:
    """Appends the listing of the result folder, with each file's text, to the log, in one file a task."""
    bridge_results(spark, results, pattern).select("path", "signature", "item_key", "payload").write.mode("append").json(log)


class Files(StatefulProcessor):
    """Keyed by path; ``build`` makes documents (JSON) of (item_key, payload) or raises."""

    def __init__(self, build: Callable[[str, str], str], policy: Policy) -> None:
        self.build, self.policy = build, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "signature string")
        self.open = handle.getValueState("open", "signature string, item_key string, payload string, tries int")

    def _try(self, path: str, signature: str, item_key: str | None, payload: str | None, tries: int, now: int) -> tuple:
        tries += 1
        try:
            if not item_key:
                raise ValueError("no item_key")
            documents = self.build(item_key, payload)
        except Exception as error:  # a fault of one file is a row of the stream
            told = f"{type(error).__name__}: {error}"
            if tries >= self.policy.tries:
                self.open.clear()
                self.done.update((signature,))
                return path, signature, item_key, DEAD, tries, told, None
            self.open.update((signature, item_key, payload, tries))
            self.handle.registerTimer(now + max(1, int(1000 * backoff(self.policy.base, tries, self.policy.most))))
            return path, signature, item_key, WAITING, tries, told, None
        self.open.clear()
        self.done.update((signature,))
        return path, signature, item_key, MERGED, tries, None, documents

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = [r for frame in rows for r in frame.itertuples(index=False)]
        last = max(seen, key=lambda r: r.signature)  # a poll's later listing has the later time
        last_done = self.done.get()[0] if self.done.exists() else None
        waits = self.open.get() if self.open.exists() else None
        if last.signature == last_done or (waits and waits[0] == last.signature):
            out = (key[0], last.signature, last.item_key, SKIPPED, waits[3] if waits else 0, None, None)
        else:
            self._forget()
            out = self._try(key[0], last.signature, last.item_key, last.payload, 0, timerValues.getCurrentProcessingTimeInMs())
        yield frame([out])

    def _forget(self) -> None:
        """A new version of a file takes the place of the one that waits."""
        self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            signature, item_key, payload, tries = self.open.get()
            yield frame([self._try(key[0], signature, item_key, payload, tries, timerValues.getCurrentProcessingTimeInMs())])

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def outcomes(spark: SparkSession, log: str, build: Callable[[str, str], str], policy: Policy = Policy(), files: int | None = None) -> DataFrame:
    """A stream of (path, signature, item_key, status, tries, error, documents) over the log of polls."""
    reader = spark.readStream.schema(SEEN)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.json(log).groupBy("path").transformWithStateInPandas(Files(build, policy), OUT, "Update", "ProcessingTime")


def sink(merge: Callable[[DataFrame], None], dead: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges what was built, and keeps dead letters by batch. ``merge`` gets (item_key, signature, documents) and may be run again."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            built = rows.where(F.col("status") == MERGED).select("item_key", "signature", "documents")
            if not built.isEmpty():
                merge(built)
            lost = rows.where(F.col("status") == DEAD)
            if not lost.isEmpty():
                lost.drop("documents").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(dead)
        finally:
            rows.unpersist()

    return apply
