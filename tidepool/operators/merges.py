"""Keyed merges over immutable tables: upserts, replacements, state-preserving snapshots. Each is one join or union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import classify_error, rescue_plan
from tidepool.functions.web import timestamp


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and the old ones whose key no new row has."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows outside the scope's keys, and all new rows."""
    return old.join(scope.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def merge_keeping(old: DataFrame, new: DataFrame, keys: Sequence[str], state: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """A snapshot: new descriptive columns, state columns of the surviving old rows, vanished rows gone.

    With ``scope``, only old rows whose scope columns some new row has can vanish; the others stay as they are.
    """
    held = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in state])
    merged = new.join(held, list(keys), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in state}).drop(*[f"__{c}" for c in state])
    if not scope:
        return merged
    return merged.unionByName(old.join(new.select(*scope).distinct(), list(scope), "left_anti"), allowMissingColumns=True)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in the given order (ascending)."""
    descending = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*descending))).where("__n = 1").drop("__n")


def bump_attempts(old: DataFrame, started: DataFrame, key: str = "job_key") -> DataFrame:
    """Enrichment jobs set running, with one more attempt; unknown ones begin with the first."""
    now = started.join(old.select(key, F.col("attempt_count").alias("__before")), key, "left")
    now = now.withColumn("attempt_count", F.coalesce("__before", F.lit(0)) + 1).withColumn("status", F.lit("running")).drop("__before")
    return upsert(old, now, [key])


def download_failed(jobs: DataFrame, failed: DataFrame) -> DataFrame:
    """Jobs with failures (job_id, status, error) set; unsupported audio that waits for a transcript is skipped."""
    f = failed.select("job_id", F.col("status").alias("__status"), F.col("error").alias("__error"))
    joined = jobs.join(f, "job_id", "left")
    hit = F.col("__status").isNotNull()
    skips = hit & (F.col("__status") == "unsupported") & F.col("media_type").isin("audio", "speech", "protected_audio") & (F.col("transcript_status") == "pending")
    return joined.withColumns(
        {
            "transcript_status": F.when(skips, "skipped").otherwise(F.col("transcript_status")),
            "transcript_error": F.when(skips, F.col("__error")).otherwise(F.col("transcript_error")),
            "status": F.when(hit, F.col("__status")).otherwise(F.col("status")),
            "error": F.when(hit, F.col("__error")).otherwise(F.col("error")),
        }
    ).drop("__status", "__error")


def by_priority(jobs: DataFrame, *keys: Column, limit: int | None = None) -> DataFrame:
    """Jobs in the order of the keys; with a limit a top-k, never a whole sort."""
    ordered = jobs.orderBy(*keys)
    return ordered if limit is None else ordered.limit(limit)


def download_order() -> list[Column]:
    """Transcript pending, items before segments, speech, newest, pending, id."""
    first = lambda c: F.when(c, 0).otherwise(1)
    return [
        first(F.col("transcript_status") == "pending"), first(F.col("segment_type") == "item"), first(F.col("media_type").isin("audio", "speech", "protected_audio")),
        F.desc_nulls_last("published_at"), first(F.col("status") == "pending"), F.asc("job_id"),
    ]


def transcription_order() -> list[Column]:
    """Known durations first, shortest first, newest, id."""
    return [F.when(F.col("duration").isNull(), 1).otherwise(0), F.asc("duration"), F.desc_nulls_last("published_at"), F.asc("job_id")]


def rescue_order() -> list[Column]:
    """Failed first, known durations first, shortest first, newest, id."""
    return [F.when(F.col("status") == "error", 0).otherwise(1), *transcription_order()]


def failed_transcriptions(jobs: DataFrame, job_ids: Sequence[str] = (), content_type: str = "radios") -> DataFrame:
    """Downloaded audio whose transcription failed, last changed first, longest first."""
    failed = (F.col("status") == "downloaded") & (F.col("content_type") == content_type) & (F.col("media_type") == "audio") & (F.col("transcript_status") == "error")
    rows = jobs.where(failed)
    rows = rows.where(F.col("job_id").isin(*job_ids)) if job_ids else rows
    return rows.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("duration"), F.desc_nulls_last("published_at"), F.asc("job_id"))


def submitted_transcriptions(jobs: DataFrame, job_ids: Sequence[str] = ()) -> DataFrame:
    rows = jobs.where(F.col("transcript_status") == "submitted")
    rows = rows.where(F.col("job_id").isin(*job_ids)) if job_ids else rows
    return rows.orderBy(F.desc_nulls_last("published_at"), F.asc("job_id"))


def remote_transcriptions(jobs: DataFrame, job_ids: Sequence[str] = (), include_errors: bool = False) -> DataFrame:
    """Audio with an address that waits for a remote transcription, newest first."""
    waiting = F.col("transcript_status").isin("pending", "error") if include_errors else F.col("transcript_status") == "pending"
    rows = jobs.where(F.col("media_type").isin("audio", "speech") & F.col("media_url").isNotNull() & waiting)
    rows = rows.where(F.col("job_id").isin(*job_ids)) if job_ids else rows
    return rows.orderBy(F.desc_nulls_last("published_at"), F.asc("job_id"))


def rescue_jobs(jobs: DataFrame, limit: int, categories: Sequence[str] = (), job_ids: Sequence[str] = ()) -> DataFrame:
    """Failed transcriptions by the priority of their second attempt, longest first; categories filter before the limit."""
    category = classify_error(F.col("transcript_error"))
    rows = failed_transcriptions(jobs, job_ids).withColumn("category", category).withColumn("priority", rescue_plan(F.col("category"), F.col("duration"))["priority"])
    rows = rows.where(F.col("category").isin(*categories)) if categories else rows
    return rows.orderBy("priority", F.desc(F.coalesce("duration", F.lit(0.0))), F.coalesce("updated_at", F.lit("")), "job_id").limit(limit)


def repairable(jobs: DataFrame, prefixes: Sequence[str], items: Sequence[str] = (), job_ids: Sequence[str] = ()) -> DataFrame:
    """Failed audio transcripts that were written, with an error that begins with one of the prefixes."""
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | F.startswith(F.lower(F.col("transcript_error")), F.lit(p.lower()))
    rows = jobs.where((F.col("media_type") == "audio") & (F.col("transcript_status") == "error") & F.col("transcript_path").isNotNull() & begins)
    rows = rows.where(F.col("item_key").isin(*items)) if items else rows
    return rows.where(F.col("job_id").isin(*job_ids)) if job_ids else rows


def chronological(results: DataFrame) -> DataFrame:
    """Results by when what they point to was published, plus their offset; undated ones last."""
    at = F.unix_millis(timestamp(F.coalesce("published_at", "timeline_at"))) + F.coalesce("start_ms", "timeline_ms", F.lit(0))
    return results.orderBy(at.asc_nulls_last(), F.asc("doc_id"))


def index_candidates(items: DataFrame, transcripts: DataFrame, title_docs: DataFrame, since: str | None = None, need_transcript: bool = True, official_owner: str | None = None) -> DataFrame:
    """Items to index, with their latest transcript: those changed since a mark, or with newer transcripts, or without a title document.

    Transcripts are aggregated before the join, so nothing fans out. Times are compared as times, whatever their offset.
    """
    newest = transcripts.groupBy("item_key").agg(F.max_by("updated_at", timestamp(F.col("updated_at"))).alias("transcript_updated_at"))
    rows = items.join(newest, "item_key", "inner" if need_transcript else "left")
    if official_owner is not None:
        rows = rows.where((F.coalesce("owner_type", F.lit("")) == official_owner) & F.coalesce("option_is_official", F.lit(False)))
    if since is not None:
        titled = title_docs.select("item_key").distinct().withColumn("titled", F.lit(True))
        mark = timestamp(F.lit(since))
        later = lambda c: F.coalesce(timestamp(F.col(c)) > mark, F.lit(False))
        rows = rows.join(titled, "item_key", "left").where(later("updated_at") | later("transcript_updated_at") | F.col("titled").isNull()).drop("titled")
    last = timestamp(F.coalesce("transcript_updated_at", "updated_at"))
    return rows.orderBy(F.col("transcript_updated_at").isNull(), last.desc_nulls_last(), "item_key")


def bridge_done(existing: DataFrame, results: DataFrame, accepted: Sequence[str], full: bool = False) -> DataFrame:
    """Results (item_key, signature) whose documents stand already: all needed types there, summaries from an accepted source with this signature.

    existing: (item_key, doc_type, payload_json).
    """
    summaries = ["scene_summary", "episode_card"]
    needed = summaries + (["item_title", "timeline_note", "evidence_atom"] if full else [])
    is_summary = F.col("doc_type").isin(*summaries)
    source, signature = F.get_json_object("payload_json", "$.source"), F.get_json_object("payload_json", "$.bridge_result_signature")
    held = existing.groupBy("item_key").agg(
        F.collect_set("doc_type").alias("types"),  # five at most
        F.min(F.when(is_summary, F.coalesce(source.isin(*accepted), F.lit(False)))).alias("accepted"),
        F.min(F.when(is_summary, signature)).alias("low"),
        F.max(F.when(is_summary, signature)).alias("high"),
        F.count(F.when(is_summary & signature.isNull(), 1)).alias("unsigned"),
    )
    whole = F.size(F.array_except(F.array(*[F.lit(t) for t in needed]), "types")) == 0
    same = (F.col("low") == F.col("signature")) & (F.col("high") == F.col("signature")) & (F.col("unsigned") == 0)
    return results.join(held, "item_key").where(whole & F.col("accepted") & same).select("item_key", "signature")


# The order that documents of an item are listed in.
TYPE_ORDER = {"item_title": 0, "timeline_note": 1, "evidence_atom": 2, "scene_summary": 3, "episode_card": 4}


def document_order() -> list[Column]:
    rank = F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_ORDER.items() for x in p]), F.col("doc_type"))
    return [F.coalesce(rank, F.lit(99)), F.coalesce("doc_index", F.lit(0)), F.coalesce("doc_id", F.lit(""))]
