"""Building and syncing the search index: candidates, documents, merges, errors of single items, the mark to go on from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.web import timestamp
from tidepool.operators.documents import build_documents
from tidepool.operators.merges import index_candidates
from tidepool.operators.states import enrichment_completed, enrichment_failed, enrichment_started
from tidepool.session import shared_folder
from tidepool.sources.sinks import replace_documents


@dataclass
class Synced:
    documents: DataFrame
    jobs: DataFrame
    errors: DataFrame  # (item_key, error)
    mark: str | None  # the latest change of an item that was indexed
    indexed: int
    new: DataFrame  # the documents that were built
    items: DataFrame  # (collection_name, item_key) whose documents they are, all of each


def faults(candidates: DataFrame, records: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(item_key, error) of candidates that can't be built; the others go on."""
    named = records.select("item_key").distinct().withColumn("__record", F.lit(True))
    broken = transcripts.groupBy("item_key").agg(F.bool_or(F.col("segments").isNull()).alias("__broken"))
    found = candidates.join(named, "item_key", "left").join(broken, "item_key", "left")
    error = F.when(F.col("__record").isNull(), "no normalised record").when(F.col("__broken"), "unreadable transcript segments")
    return found.select("item_key", error.alias("error")).where(F.col("error").isNotNull())


def sync_index(docs: DataFrame, jobs: DataFrame, items: DataFrame, records: DataFrame, transcripts: DataFrame, collection: str, at: str, since: str | None = None, **options) -> Synced:
    """Documents and enrichment jobs after the changed items were built and merged in.

    docs: documents with collection_name; items: (item_key, updated_at, ...); transcripts: (item_key, updated_at, segments).
    Items that can't be built keep their old documents and are reported; the mark only follows those that could.
    """
    mine = docs.where(F.col("collection_name") == collection)
    titles = mine.where(F.col("doc_type") == "item_title").select("item_key")
    # What several results are made of is worked out once.
    shared_folder(docs.sparkSession)
    wanted = index_candidates(items, transcripts, titles, since, **options).select("item_key", "updated_at", "transcript_updated_at").checkpoint(eager=True)
    bad = faults(wanted, records, transcripts).checkpoint(eager=True)
    good = wanted.join(bad, "item_key", "left_anti")
    chosen = good.select("item_key")
    new = build_documents(records.join(chosen, "item_key", "left_semi"), transcripts.join(chosen, "item_key", "left_semi").select("item_key", "segments")).checkpoint(eager=True)
    merged = replace_documents(docs, new.withColumn("collection_name", F.lit(collection)))
    key = F.concat(F.lit("search:"), "item_key")
    none = F.lit(None).cast("string")
    started = enrichment_started(jobs, wanted.select(key.alias("job_key"), "item_key", none.alias("transcript_id"), F.lit("search_index").alias("job_type"), none.alias("payload_json")), at)
    counts = new.groupBy("item_key").agg(F.to_json(F.struct(F.count("*").alias("documents"))).alias("payload_json"))
    done = enrichment_completed(started, counts.select(key.alias("job_key"), "payload_json"), at)
    ended = enrichment_failed(done, bad.select(key.alias("job_key"), "error", none.alias("payload_json")), at)
    last = F.coalesce("transcript_updated_at", "updated_at")
    best = good.agg(F.max_by(last, timestamp(last)).alias("mark"), F.count("*").alias("n")).first()
    return Synced(merged, ended, bad, best["mark"] or since, best["n"], new.withColumn("collection_name", F.lit(collection)), chosen.select(F.lit(collection).alias("collection_name"), "item_key"))
