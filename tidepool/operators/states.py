"""State changes of jobs, transcripts, enrichment jobs and documents, as merges that give new tables.

Changes come as tables, one row for a key; rows whose key no change has stay as they are. Times are parameters, so that
reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import text_chunks
from tidepool.operators.merges import replace_scope, upsert
from tidepool.operators.segments import repaired

SPOKEN = ("audio", "protected_audio", "speech")
NEW = "__new_"


def updated(rows: DataFrame, changes: DataFrame, key: str, values: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """Rows with columns set where a change names their key; ``values`` gets at a change's columns by name."""
    new = changes.select(F.col(key), F.lit(True).alias(f"{NEW}hit"), *[F.col(c).alias(f"{NEW}{c}") for c in changes.columns if c != key])
    joined = rows.join(new, key, "left")
    made = values(lambda c: F.col(f"{NEW}{c}"))
    kinds = dict(rows.dtypes)
    return joined.select(*[F.when(F.col(f"{NEW}hit"), made[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in rows.columns])


def downloaded(jobs: DataFrame, done: DataFrame, at: str) -> DataFrame:
    """done: (job_id, downloaded_path, file_size)."""
    now, none = F.lit(at), F.lit(None)
    return updated(jobs, done, "job_id", lambda new: {"status": F.lit("downloaded"), "last_error": none, "file_size": new("file_size"), "downloaded_path": new("downloaded_path"), "downloaded_at": now, "updated_at": now})


def resourced(jobs: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """Jobs that start anew from another source: (job_id, media_url, local_relpath, provider, access_mode, download_method, status, last_error)."""

    def values(new: Callable[[str], Column]) -> dict[str, Column]:
        again = (new("status") == "pending") & F.col("media_type").isin(*SPOKEN)
        given = {c: new(c) for c in ("media_url", "local_relpath", "provider", "access_mode", "download_method", "status", "last_error")}
        gone = dict.fromkeys(("file_size", "downloaded_path", "downloaded_at"), F.lit(None))
        spoken = {"transcript_status": F.when(again, "pending").otherwise(F.col("transcript_status")), "transcript_error": F.when(~F.coalesce(again, F.lit(False)), F.col("transcript_error"))}
        return given | gone | spoken | {"updated_at": F.lit(at)}

    return updated(jobs, sources, "job_id", values)


def submitted(jobs: DataFrame, sent: DataFrame, at: str) -> DataFrame:
    """sent: (job_id, transcript_path); a NULL path keeps the old one."""
    return updated(jobs, sent, "job_id", lambda new: {"transcript_status": F.lit("submitted"), "transcript_error": F.lit(None), "transcript_path": F.coalesce(new("transcript_path"), "transcript_path"), "updated_at": F.lit(at)})


def transcript_failed(jobs: DataFrame, failed: DataFrame, at: str) -> DataFrame:
    """failed: (job_id, error)."""
    return updated(jobs, failed, "job_id", lambda new: {"transcript_status": F.lit("error"), "transcript_error": new("error"), "updated_at": F.lit(at)})


def save_transcripts(transcripts: DataFrame, chunks: DataFrame, jobs: DataFrame, new: DataFrame, new_chunks: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts, chunks and jobs after new transcripts, whose transcript_id is their job's job_id.

    A transcript that was there keeps its created_at, its item and segment; its chunks are replaced; its job is completed.
    """
    kept = [c for c in transcripts.columns if c not in ("transcript_id", "language", "model_name", "text", "segments_json", "transcript_path", "updated_at")]
    old = transcripts.select("transcript_id", F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in kept])
    stamped = new.withColumns({"created_at": F.lit(at), "updated_at": F.lit(at)}).join(old, "transcript_id", "left")
    rows = stamped.withColumns({c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) for c in kept if c in stamped.columns}).select(*new.columns, "created_at", "updated_at")
    done = new.select(F.col("transcript_id").alias("job_id"), "transcript_path")
    completed = updated(jobs, done, "job_id", lambda c: {"transcript_status": F.lit("completed"), "transcript_error": F.lit(None), "transcript_path": c("transcript_path"), "transcribed_at": F.lit(at), "updated_at": F.lit(at)})
    return upsert(transcripts, rows, ["transcript_id"]), replace_scope(chunks, new_chunks, new, ["transcript_id"]), completed


def enrichment_started(jobs: DataFrame, started: DataFrame, at: str) -> DataFrame:
    """started: (job_key, item_key, transcript_id, job_type, payload_json); each start is one more attempt."""
    before = jobs.select("job_key", F.col("attempt_count").alias("__before"))
    now = started.join(before, "job_key", "left").withColumns(
        {"attempt_count": F.coalesce("__before", F.lit(0)) + 1, "status": F.lit("running"), "last_error": F.lit(None).cast("string"), "payload_json": F.coalesce("payload_json", F.lit("{}")), "updated_at": F.lit(at), "completed_at": F.lit(None).cast("string")}
    )
    return upsert(jobs, now.drop("__before"), ["job_key"])


def enrichment_completed(jobs: DataFrame, done: DataFrame, at: str) -> DataFrame:
    """done: (job_key, payload_json)."""
    return updated(jobs, done, "job_key", lambda new: {"status": F.lit("completed"), "last_error": F.lit(None), "payload_json": F.coalesce(new("payload_json"), F.lit("{}")), "updated_at": F.lit(at), "completed_at": F.lit(at)})


def enrichment_failed(jobs: DataFrame, failed: DataFrame, at: str) -> DataFrame:
    """failed: (job_key, error, payload_json); a NULL payload keeps the old one."""
    return updated(jobs, failed, "job_key", lambda new: {"status": F.lit("error"), "last_error": new("error"), "payload_json": F.coalesce(new("payload_json"), "payload_json"), "updated_at": F.lit(at), "completed_at": F.lit(None)})


def cleared(docs: DataFrame, collection: str | None = None) -> DataFrame:
    """Documents without those of a collection, or none at all."""
    return docs.limit(0) if collection is None else docs.where(~F.col("collection_name").eqNullSafe(F.lit(collection)))


def migrated(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with the columns (name: type) that they lack, NULL."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns})


def backfilled(rows: DataFrame, files: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that lack one of the columns, with what files have for their key where that isn't NULL."""
    lacking = F.lit(False)
    for c in columns:
        lacking = lacking | F.col(c).isNull()
    over = files.select(key, *[F.col(c).alias(f"{NEW}{c}") for c in columns])
    joined = rows.join(over, key, "left")
    return joined.select(*[F.when(lacking, F.coalesce(f"{NEW}{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def defaults(rows: DataFrame, over: DataFrame, columns: list[str], flags: list[str], key: str = "item_key") -> DataFrame:
    """Rows overlaid by a result's values: texts where they aren't empty, flags where they aren't NULL."""
    named = over.select(key, *[F.col(c).alias(f"{NEW}{c}") for c in [*columns, *flags]])
    texts = {c: F.coalesce(F.nullif(F.col(f"{NEW}{c}"), F.lit("")), F.col(c)) for c in columns}
    given = {c: F.coalesce(f"{NEW}{c}", c) for c in flags}
    return rows.join(named, key, "left").withColumns(texts | given).drop(*[f"{NEW}{c}" for c in [*columns, *flags]])


def search_texts(vector: Column, keyword: Column, search: Column, normalized: Column, raw: Column) -> tuple[Column, Column, Column]:
    """(vector, keyword, search text) of a document, each falling back to what there is."""
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    body = first(normalized, raw)
    words = first(keyword, search, body)
    return first(vector, words), words, first(search, words)


def repaired_transcripts(transcripts: DataFrame, width: int = 800) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts (transcript_id, item_key, text, segments, ...) cleaned: what to save, its chunks, and what was refused.

    The first is (transcript_id, item_key, text, segments, removed), the second (chunk_id, transcript_id, item_key, source,
    chunk_index, text) cut anew from the cleaned text, the third (transcript_id, refused). A transcript is in the first or
    in the third; ``save_transcripts`` and a library's ``replace_chunks`` take the first two.
    """
    rows = repaired(transcripts)
    good = rows.where(F.col("refused").isNull())
    saved = good.select("transcript_id", "item_key", F.col("cleaned_text").alias("text"), F.col("cleaned").alias("segments"), (F.size("segments") - F.size("cleaned")).alias("removed"))
    cut = saved.select("transcript_id", "item_key", F.posexplode(text_chunks(F.col("text"), width)).alias("chunk_index", "text"))
    chunks = cut.select(F.concat_ws(":", "transcript_id", F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"), "transcript_id", "item_key", F.lit("transcript").alias("source"), "chunk_index", "text")
    return saved, chunks, rows.where(F.col("refused").isNotNull()).select("transcript_id", "refused")
