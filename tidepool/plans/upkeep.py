"""Further queries by name with their SQL twins: the search facade, states of jobs, queues, crawling, records, vectors.

The tables stand in as in ``catalogue``, whose registry these join.
"""

from __future__ import annotations

import glob
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import terms as clues
from tidepool.functions import text, web
from tidepool.operators import documents, merges, records, retrieval, segments, states
from tidepool.plans.catalogue import _CLEAN, _WALK, LOW, TERMS, TOP50, query, read, spoken, texts
from tidepool.plans.search import Memory
from tidepool.session import shared_folder, spread
from tidepool.sources import paged_stream, readers, sinks, vectors
from tidepool.sources.points import PointTable
from tidepool.streaming import crawl

# The search facade.

KINDS = {"en": "scene_summary", "de": "episode_card", "fr": "evidence_atom"}
KIND_SQL = "CASE lang WHEN 'en' THEN 'scene_summary' WHEN 'de' THEN 'episode_card' WHEN 'fr' THEN 'evidence_atom' ELSE 'timeline_note' END"
ASKED = "heit tion ment the"
WORDS = clues.query_terms(ASKED)
PRIOR_SQL = "CASE doc_type WHEN 'episode_card' THEN 0.16 WHEN 'scene_summary' THEN 0.12 WHEN 'timeline_note' THEN 0.06 ELSE 0 END"


def memory_docs(docs: DataFrame) -> DataFrame:
    """Documents as search documents: source is the item, lang gives the type."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("lang")), F.lit("timeline_note"))
    return docs.select("doc_id", kind.alias("doc_type"), F.col("source").alias("item_key"), F.col("lang").alias("category"), F.col("text").alias("keyword_text"), F.col("doc_id").cast("int").alias("doc_index"))


def result_columns(found: DataFrame, reason: str | None) -> DataFrame:
    snippet = F.get(F.filter("match_details", lambda m: m["kind"] == "semantic"), F.lit(0))["text"]
    return found.select(
        "doc_id", "item_key", "doc_type", "recall_stage", F.round("rerank_score", 6).alias("rerank_score"), F.array_join("matched_terms", ",").alias("matched"), snippet.alias("snippet"),
        "match_summary", F.lit(reason).cast("string").alias("degraded"),
    )


def result_sql(hits: str, reason: str, limit: int = 10) -> str:
    """Twin of rerank, diversify and the result row over hits (doc_id, doc_type, item_key, text, score, ord, recall_stage)."""
    listed = "[" + ", ".join(f"'{t}'" for t in WORDS) + "]"
    bonus = "least(0.26, list_sum(list_prepend(0.0, list_transform(held, lambda t: CASE WHEN length(t) <= 2 THEN 0.02 WHEN length(t) <= 4 THEN 0.05 ELSE 0.08 END))))"
    ranked = f"""SELECT *, round(score + {PRIOR_SQL} + {bonus} + CASE WHEN n > 1 THEN least(0.08, 0.02 * (n - 1)) ELSE 0 END - CASE WHEN recall_stage = 'second_pass_atom' THEN 0.015 ELSE 0 END, 9) AS r
        FROM (SELECT *, list_filter({listed}, lambda t: contains(text, t))[:8] AS held, count(*) OVER (PARTITION BY item_key) AS n FROM ({hits}))"""
    best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY r DESC, ord) AS nth FROM ({ranked})) WHERE nth <= 2 ORDER BY nth, r DESC, ord LIMIT {limit}"
    told = "CASE doc_type WHEN 'episode_card' THEN '命中节目摘要' WHEN 'scene_summary' THEN '命中节目片段摘要' WHEN 'evidence_atom' THEN '命中原始转录片段' END"
    return f"""SELECT doc_id, item_key, doc_type, recall_stage, round(r, 6) AS rerank_score, array_to_string(held, ',') AS matched,
        CASE WHEN a >= 0 THEN CASE WHEN a - 60 > 0 THEN '...' ELSE '' END || trim(substring(c, greatest(0, a - 60)::INT + 1, (least(length(c), a + 180) - greatest(0, a - 60))::INT)) || CASE WHEN a + 180 < length(c) THEN '...' ELSE '' END
        WHEN doc_type = 'evidence_atom' THEN CASE WHEN length(c) <= 180 THEN c ELSE rtrim(substring(c, 1, 180)) || '...' END END AS snippet,
        CASE WHEN len(held) > 0 THEN '提到了 ' || array_to_string(held[:3], '、') || '，' || {told} ELSE '语义命中，匹配到相近描述' END AS match_summary, {reason} AS degraded
        FROM (SELECT *, instr(c, list_filter(held, lambda t: contains(c, t))[1]) - 1 AS a FROM (SELECT *, {_CLEAN} AS c FROM ({best})))"""


_SCORE = " + ".join(f"CASE WHEN contains({LOW}, '{t.lower()}') THEN {retrieval.term_weight(t)} ELSE 0 END" for t in clues.recall_terms(WORDS))
_LEXICAL = f"""SELECT *, 0.42 + 0.40 * s / max(s) OVER () AS score, row_number() OVER (ORDER BY s DESC, doc_type, item_key, doc_id) - 1 AS ord, 'lexical_fallback' AS recall_stage
FROM (SELECT doc_id, {KIND_SQL} AS doc_type, source AS item_key, text, {_SCORE} AS s FROM documents WHERE lang IN ('en', 'de')) WHERE s > 0 ORDER BY s DESC, doc_type, item_key, doc_id LIMIT 150"""


class Broken:
    """An embedding service that is down."""

    def embed_queries(self, wanted: list[str]) -> list[list[float]]:
        raise ConnectionError("connection refused")

    embed_documents = embed_queries


class Fixed:
    """A service that answers every query with one vector."""

    def __init__(self, vector: list[float]) -> None:
        self.vector = vector

    def embed_queries(self, wanted: list[str]) -> list[list[float]]:
        return [self.vector for _ in wanted]

    embed_documents = embed_queries


@query(result_sql(_LEXICAL, "'semantic_recall_unavailable'"))
def degraded_search(spark, d):
    """The embedding service fails, so the lexical branch answers."""
    docs = memory_docs(texts(spark, d))
    found, how = Memory(docs, docs.select("doc_id", F.array(F.lit(1.0)).alias("embedding")), Broken()).search(ASKED)
    return result_columns(found, how["degraded_reason"])


@query(result_sql(_LEXICAL, "'semantic_recall_unavailable'"))
def degraded_by_vectors(spark, d):
    """The vector table fails while it is read: its vectors are of no use, which shows at execution only."""
    docs = memory_docs(texts(spark, d))
    broken = docs.select("doc_id", F.array(F.raise_error(F.lit("vector store lost")).cast("double")).alias("embedding"))
    found, how = Memory(docs, broken, Fixed([1.0])).search(ASKED)
    return result_columns(found, how["degraded_reason"])


_NEAR = "SELECT vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS cos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_RECALL = f"""WITH v AS ({_NEAR}), x AS (SELECT doc_id, {KIND_SQL} AS doc_type, source AS item_key, text, cos FROM documents JOIN v ON vec_id = doc_id),
one AS (SELECT *, 0 AS stage FROM x WHERE doc_type IN ('scene_summary', 'episode_card') ORDER BY cos DESC, doc_id LIMIT 150), two AS (SELECT *, 1 AS stage FROM x WHERE doc_type = 'evidence_atom' ORDER BY cos DESC, doc_id LIMIT 60)
SELECT *, cos AS score, CASE stage WHEN 0 THEN 'primary' ELSE 'second_pass_atom' END AS recall_stage, row_number() OVER (ORDER BY stage, cos DESC, doc_id) - 1 AS ord FROM (SELECT * FROM one UNION ALL SELECT * FROM two)"""


@query(result_sql(_RECALL, "NULL::VARCHAR"))
def semantic_search(spark, d):
    """Vectors of the table embeddings stand in for those of the documents of the same number, in a point table."""
    points = read(spark, d, "embeddings")
    asked = points.where("vec_id = 0").first()["embedding"]
    docs = memory_docs(texts(spark, d))
    known = docs.select("doc_id", "doc_type", "item_key", "category").join(points.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").withColumn("collection_name", F.lit("c"))
    table = PointTable.create(known, folder(spark))
    found, how = Memory(docs, table, Fixed([float(x) for x in asked]), collection="c").search(ASKED)
    return result_columns(found, how["degraded_reason"])


@query(
    """WITH a AS (SELECT conv_id, turn, turn * 10000 AS s, turn * 10000 + 8000 AS e FROM conversations), c AS (SELECT DISTINCT conv_id FROM conversations),
near AS (SELECT a.conv_id || ':atom:' || a.turn AS hit, b.conv_id || ':atom:' || b.turn AS id, b.turn AS place FROM a JOIN a b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.turn = 1
UNION ALL SELECT * FROM (SELECT c.conv_id || ':scene', a.conv_id || ':atom:' || a.turn AS id, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.conv_id || ':atom:' || a.turn) AS place FROM c JOIN a ON a.conv_id = c.conv_id AND a.turn < 8) WHERE place <= 6
UNION ALL SELECT * FROM (SELECT c.conv_id || ':note', a.conv_id || ':atom:' || a.turn AS id, row_number() OVER (PARTITION BY a.conv_id ORDER BY least(abs(s - 15000), abs(e - 15000)), s, a.conv_id || ':atom:' || a.turn) AS place FROM c JOIN a ON a.conv_id = c.conv_id
  AND s <= 39000 AND e >= 0 AND least(abs(s - 15000), abs(e - 15000)) <= 24000) WHERE place <= 4)
SELECT hit, string_agg(id, ',' ORDER BY place) AS neighbours FROM near GROUP BY hit"""
)
def search_context(spark, d):
    """Neighbours of three kinds of hits: atoms beside an atom, atoms of a scene, atoms around a note."""
    turns = read(spark, d, "conversations")
    item, none = F.col("conv_id").cast("string"), F.lit(None)
    name = lambda *parts: F.concat_ws(":", item, *parts)
    row = lambda rows, kind, doc_id, **more: rows.select(doc_id.alias("doc_id"), F.lit(kind).alias("doc_type"), item.alias("item_key"), *[more.get(c, none.cast(t)).alias(c) for c, t in (("doc_index", "int"), ("start_ms", "bigint"), ("end_ms", "bigint"), ("timeline_ms", "bigint"), ("text_raw", "string"), ("title", "string"), ("atom_ids", "array<string>"))])
    start = F.col("turn") * 10000
    atoms = row(turns, "evidence_atom", name(F.lit("atom"), "turn"), doc_index=F.col("turn").cast("int"), start_ms=start, end_ms=start + 8000, text_raw=F.col("text"))
    convs = turns.select("conv_id").distinct()
    scenes = row(convs, "scene_summary", name(F.lit("scene")), atom_ids=F.transform(F.sequence(F.lit(0), F.lit(9)), lambda t: name(F.lit("atom"), t.cast("string"))))
    notes = row(convs, "timeline_note", name(F.lit("note")), timeline_ms=F.lit(15000).cast("long"))
    memory = Memory(atoms.unionByName(scenes).unionByName(notes))
    hits = memory.docs.where("doc_type <> 'evidence_atom' OR doc_index = 1")
    return memory.neighbours(hits).select(F.col("hit_id").alias("hit"), F.array_join("neighbor_atoms.doc_id", ",").alias("neighbours"))


# States of jobs.

AT = "2024-05-01T00:00:00Z"
_KIND = "CASE event_type WHEN 'click' THEN 'audio' WHEN 'view' THEN 'speech' ELSE 'image' END"
_TRANSCRIPT = "CASE WHEN value > 66 THEN 'pending' WHEN value > 33 THEN 'error' ELSE 'submitted' END"
_STATUS = "CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'downloaded' END"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Events as media jobs."""
    kind = F.when(F.col("event_type") == "click", "audio").when(F.col("event_type") == "view", "speech").otherwise("image")
    spoken = F.when(F.col("value") > 66, "pending").when(F.col("value") > 33, "error").otherwise("submitted")
    part = lambda n: F.when(F.col("event_id") % n != 0, F.concat(F.lit("u"), F.col("event_id").cast("string")))
    message = F.when(F.col("event_id") % 3 == 0, "bad allocation").when(F.col("event_id") % 3 == 1, "CUDA error 7").otherwise("other trouble")
    return read(spark, d, "events").select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("item_key"), F.lit("radios").alias("content_type"), kind.alias("media_type"), F.when(F.col("event_id") % 4 == 0, "error").otherwise("downloaded").alias("status"), part(5).alias("media_url"), part(2).alias("local_relpath"), F.lit("direct").alias("provider"),
        F.lit("audio_url").alias("access_mode"), F.lit("direct").alias("download_method"), F.lit("old").alias("last_error"), F.col("event_id").alias("file_size"), part(3).alias("downloaded_path"), F.lit("t0").alias("downloaded_at"),
        spoken.alias("transcript_status"), message.alias("transcript_error"), part(7).alias("transcript_path"), F.lit(None).cast("string").alias("transcribed_at"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("duration"),
        F.date_format("ts", "yyyy-MM-dd").alias("published_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), F.when(F.col("event_id") % 2 == 0, "item").otherwise("chapter").alias("segment_type"),
    )


_ERROR = "CASE event_id % 3 WHEN 0 THEN 'bad allocation' WHEN 1 THEN 'CUDA error 7' ELSE 'other trouble' END"


def _u(n: int) -> str:
    return f"CASE WHEN event_id % {n} <> 0 THEN 'u' || event_id END"


@query(
    f"""SELECT event_id AS job_id, CASE WHEN event_id % 4 = 0 THEN 'downloaded' ELSE {_STATUS} END AS status, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'old' END AS last_error, CASE WHEN event_id % 4 = 0 THEN event_id * 2 ELSE event_id END AS file_size,
CASE WHEN event_id % 4 = 0 THEN 'd/' || event_id ELSE {_u(3)} END AS downloaded_path, CASE WHEN event_id % 4 = 0 THEN '{AT}' ELSE 't0' END AS downloaded_at FROM events"""
)
def mark_downloaded(spark, d):
    rows = jobs(spark, d)
    done = rows.where("job_id % 4 = 0").select("job_id", F.concat(F.lit("d/"), F.col("job_id").cast("string")).alias("downloaded_path"), (F.col("job_id") * 2).alias("file_size"))
    return states.downloaded(rows, done, AT).select("job_id", "status", "last_error", "file_size", "downloaded_path", "downloaded_at")


@query(
    f"""SELECT event_id AS job_id, CASE WHEN hit THEN 'new' ELSE {_u(5)} END AS media_url, CASE WHEN hit THEN st ELSE {_STATUS} END AS status, CASE WHEN hit THEN NULL ELSE event_id END AS file_size,
CASE WHEN hit AND st = 'pending' AND {_KIND} <> 'image' THEN 'pending' ELSE {_TRANSCRIPT} END AS transcript_status, CASE WHEN hit AND st = 'pending' AND {_KIND} <> 'image' THEN NULL ELSE {_ERROR} END AS transcript_error
FROM (SELECT *, event_id % 5 < 2 AS hit, CASE event_id % 5 WHEN 0 THEN 'pending' ELSE 'error' END AS st FROM events)"""
)
def update_media_job_source(spark, d):
    rows = jobs(spark, d)
    new = rows.where("job_id % 5 < 2").select("job_id", F.lit("new").alias("media_url"), F.lit("p").alias("local_relpath"), F.lit("other").alias("provider"), F.lit("audio_url").alias("access_mode"), F.lit("direct").alias("download_method"),
                                              F.when(F.col("job_id") % 5 == 0, "pending").otherwise("error").alias("status"), F.lit(None).cast("string").alias("last_error"))
    return states.resourced(rows, new, AT).select("job_id", "media_url", "status", "file_size", "transcript_status", "transcript_error")


@query(
    f"""SELECT event_id AS job_id, CASE event_id % 3 WHEN 0 THEN 'submitted' WHEN 1 THEN 'error' ELSE {_TRANSCRIPT} END AS transcript_status, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'lost' ELSE {_ERROR} END AS transcript_error,
CASE WHEN event_id % 6 = 0 THEN 'given' ELSE {_u(7)} END AS transcript_path, CASE WHEN event_id % 3 < 2 THEN '{AT}' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM events"""
)
def transcript_states(spark, d):
    """Jobs submitted, and others failed."""
    rows = jobs(spark, d)
    sent = rows.where("job_id % 3 = 0").select("job_id", F.when(F.col("job_id") % 6 == 0, "given").alias("transcript_path"))
    failed = rows.where("job_id % 3 = 1").select("job_id", F.lit("lost").alias("error"))
    return states.transcript_failed(states.submitted(rows, sent, AT), failed, AT).select("job_id", "transcript_status", "transcript_error", "transcript_path", "updated_at")


_SAVED = """SELECT 'transcript' AS part, event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS text, CASE WHEN event_id % 4 = 2 THEN '{AT}' ELSE 't0' END AS at, count(*) AS n FROM events WHERE event_id % 4 <> 1 GROUP BY ALL
UNION ALL SELECT 'chunk', event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END, '', CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END FROM events WHERE event_id % 4 <> 1
UNION ALL SELECT 'job', event_id, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE {T} END, CASE WHEN event_id % 2 = 0 THEN '{AT}' ELSE '' END, 1 FROM events"""


@query(_SAVED.replace("{AT}", AT).replace("{T}", _TRANSCRIPT))
def save_transcript(spark, d):
    """Transcripts with number 0 and 3 of four exist; those with even numbers are saved now."""
    rows = jobs(spark, d)
    shape = lambda df, word, at: df.select(F.col("job_id").alias("transcript_id"), "item_key", F.lit("zh").alias("language"), F.lit("m").alias("model_name"), F.lit(word).alias("text"), F.lit("[]").alias("segments_json"), F.lit("p").alias("transcript_path"), *([F.lit(at).alias("created_at"), F.lit(at).alias("updated_at")] if at else []))
    cut = lambda df, word, n: df.select(F.col("job_id").alias("transcript_id"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("chunk_index"), F.lit(word).alias("text"))
    there, now = rows.where("job_id % 4 in (0, 3)"), rows.where("job_id % 2 = 0")
    transcripts, chunks, done = states.save_transcripts(shape(there, "old", "t0"), cut(there, "old", 3), rows, shape(now, "new", None), cut(now, "new", 2), AT)
    one = transcripts.select(F.lit("transcript").alias("part"), F.col("transcript_id").alias("key"), "text", F.col("created_at").alias("at"), F.lit(1).cast("long").alias("n"))
    two = chunks.groupBy("transcript_id", "text").agg(F.count("*").alias("n")).select(F.lit("chunk").alias("part"), F.col("transcript_id").alias("key"), "text", F.lit("").alias("at"), "n")
    three = done.select(F.lit("job").alias("part"), F.col("job_id").alias("key"), F.col("transcript_status").alias("text"), F.coalesce("transcribed_at", F.lit("")).alias("at"), F.lit(1).cast("long").alias("n"))
    return one.unionByName(two).unionByName(three)


@query(
    """SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'error' ELSE 'running' END AS status, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS attempt_count,
CASE user_id % 3 WHEN 0 THEN '{"n":1}' WHEN 1 THEN '{"k":' || user_id || '}' ELSE '{"k":' || user_id || '}' END AS payload_json, CASE WHEN user_id % 3 = 1 THEN 'lost' END AS last_error, user_id % 3 = 0 AS completed FROM (SELECT DISTINCT user_id FROM events)"""
)
def enrichment_states(spark, d):
    """Jobs with even numbers have run before; all start, a third is completed, a third fails."""
    users = read(spark, d, "events").select("user_id").distinct()
    key, none = F.concat(F.lit("search:"), F.col("user_id").cast("string")), F.lit(None).cast("string")
    start = users.select(key.alias("job_key"), F.col("user_id").cast("string").alias("item_key"), none.alias("transcript_id"), F.lit("search_index").alias("job_type"), F.to_json(F.struct(F.col("user_id").alias("k"))).alias("payload_json"))
    old = start.where("item_key % 2 = 0").withColumns({"status": F.lit("error"), "attempt_count": F.lit(1), "last_error": F.lit("x"), "updated_at": F.lit("t0"), "completed_at": none})
    running = states.enrichment_started(old, start, AT)
    done = states.enrichment_completed(running, users.where("user_id % 3 = 0").select(key.alias("job_key"), F.lit('{"n":1}').alias("payload_json")), AT)
    out = states.enrichment_failed(done, users.where("user_id % 3 = 1").select(key.alias("job_key"), F.lit("lost").alias("error"), none.alias("payload_json")), AT)
    return out.select(F.col("item_key").cast("long").alias("user_id"), "status", "attempt_count", "payload_json", "last_error", F.col("completed_at").isNotNull().alias("completed"))


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'de'")
def clear_documents(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", F.col("lang").alias("collection_name"))
    return states.cleared(docs, "de").select("doc_id", "lang")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS owner_type, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 2 = 0 END AS option_is_official FROM customer")
def migrate_backfill(spark, d):
    """Columns that are added, then filled from files where they are NULL; customers 2 of 3 have no file."""
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    wide = states.migrated(rows, {"owner_type": "string", "option_is_official": "boolean"}).withColumn("owner_type", F.when(F.col("c_custkey") % 3 == 0, "kept"))
    files = rows.where("c_custkey % 3 < 2").select("c_custkey", F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("owner_type"), (F.col("c_custkey") % 2 == 0).alias("option_is_official"))
    return states.backfilled(wide, files, "c_custkey", ["owner_type", "option_is_official"]).select("c_custkey", "owner_type", "option_is_official")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 'given' ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 = 0 ELSE true END AS official FROM customer")
def item_defaults(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("title"), F.lit(True).alias("official"))
    over = rows.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise("given").alias("title"), (F.col("c_custkey") % 4 == 0).alias("official"))
    return states.defaults(rows, over, ["title"], ["official"], key="c_custkey")


@query(
    """SELECT p_partkey, coalesce(nullif(v, ''), w) AS vector_text, w AS keyword_text, coalesce(nullif(s, ''), w) AS text_search FROM (SELECT *, coalesce(nullif(k, ''), nullif(s, ''), nullif(n, ''), r) AS w
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'v' ELSE '' END AS v, CASE WHEN p_size % 3 = 0 THEN 'k' END AS k, CASE WHEN p_size % 5 = 0 THEN 's' ELSE '' END AS s, CASE WHEN p_size % 7 = 0 THEN p_brand END AS n, p_name AS r FROM part))"""
)
def search_texts(spark, d):
    size = F.col("p_size")
    every = lambda n, value, other: F.when(size % n == 0, value).otherwise(F.lit(other))
    vector, keyword, search = states.search_texts(every(2, "v", ""), every(3, "k", None), every(5, "s", ""), every(7, F.col("p_brand"), None), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", vector.alias("vector_text"), keyword.alias("keyword_text"), search.alias("text_search"))


# Queues.

_JOBS = f"""SELECT event_id AS job_id, user_id, {_KIND} AS media_type, {_STATUS} AS status, {_u(5)} AS media_url, {_TRANSCRIPT} AS transcript_status, {_ERROR} AS transcript_error, {_u(7)} AS transcript_path,
CASE WHEN event_id % 6 <> 0 THEN value END AS duration, strftime(ts, '%Y-%m-%d') AS published_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, CASE WHEN event_id % 2 = 0 THEN 'item' ELSE 'chapter' END AS segment_type FROM events"""


@query(
    f"""SELECT job_id FROM ({_JOBS}) ORDER BY transcript_status <> 'pending', segment_type <> 'item', media_type = 'image', published_at DESC, status <> 'pending', job_id LIMIT 50"""
)
def job_priority_queue(spark, d):
    return merges.by_priority(jobs(spark, d), *merges.download_order(), limit=50).select("job_id")


@query(f"SELECT job_id, duration FROM ({_JOBS}) WHERE transcript_status = 'pending' AND media_type = 'audio' ORDER BY duration IS NULL, duration, published_at DESC, job_id LIMIT 40")
def null_last_queue(spark, d):
    rows = jobs(spark, d).where("transcript_status = 'pending' AND media_type = 'audio'")
    return merges.by_priority(rows, *merges.transcription_order(), limit=40).select("job_id", "duration")


@query(f"SELECT job_id, status FROM ({_JOBS}) ORDER BY status <> 'error', duration IS NULL, duration, published_at DESC, job_id LIMIT 60")
def rescue_queue(spark, d):
    return merges.by_priority(jobs(spark, d), *merges.rescue_order(), limit=60).select("job_id", "status")


@query(f"SELECT job_id FROM ({_JOBS}) WHERE status = 'downloaded' AND media_type = 'audio' AND transcript_status = 'error' ORDER BY updated_at DESC, duration IS NULL, duration DESC, published_at DESC, job_id LIMIT 30")
def failed_queue(spark, d):
    return merges.failed_transcriptions(jobs(spark, d)).limit(30).select("job_id")


@query(
    f"""SELECT 'submitted' AS queue, job_id FROM (SELECT job_id FROM ({_JOBS}) WHERE transcript_status = 'submitted' ORDER BY published_at DESC, job_id LIMIT 20)
UNION ALL SELECT 'remote', job_id FROM (SELECT job_id FROM ({_JOBS}) WHERE media_type IN ('audio', 'speech') AND media_url IS NOT NULL AND transcript_status = 'pending' ORDER BY published_at DESC, job_id LIMIT 20)
UNION ALL SELECT 'remote_errors', job_id FROM (SELECT job_id FROM ({_JOBS}) WHERE media_type IN ('audio', 'speech') AND media_url IS NOT NULL AND transcript_status IN ('pending', 'error') ORDER BY published_at DESC, job_id LIMIT 20)"""
)
def remote_queues(spark, d):
    rows = jobs(spark, d)
    named = lambda queue, df: df.limit(20).select(F.lit(queue).alias("queue"), "job_id")
    return named("submitted", merges.submitted_transcriptions(rows)).unionByName(named("remote", merges.remote_transcriptions(rows))).unionByName(named("remote_errors", merges.remote_transcriptions(rows, include_errors=True)))


@query(
    f"""SELECT job_id, category, priority FROM (SELECT *, CASE category WHEN 'bad_allocation' THEN 0 WHEN 'cuda_error' THEN 2 ELSE CASE WHEN coalesce(duration, 0) >= 3600 THEN 1 ELSE 3 END END AS priority
FROM (SELECT *, CASE transcript_error WHEN 'bad allocation' THEN 'bad_allocation' WHEN 'CUDA error 7' THEN 'cuda_error' ELSE 'other' END AS category FROM ({_JOBS}) WHERE status = 'downloaded' AND media_type = 'audio' AND transcript_status = 'error'))
WHERE category IN ('bad_allocation', 'other') ORDER BY priority, coalesce(duration, 0) DESC, updated_at, job_id LIMIT 25"""
)
def second_attempts(spark, d):
    return merges.rescue_jobs(jobs(spark, d), 25, ["bad_allocation", "other"]).select("job_id", "category", "priority")


@query(f"SELECT job_id, user_id FROM ({_JOBS}) WHERE media_type = 'audio' AND transcript_status = 'error' AND transcript_path IS NOT NULL AND (transcript_error ILIKE 'bad alloc%' OR transcript_error ILIKE 'cuda%')")
def repair_candidates(spark, d):
    return merges.repairable(jobs(spark, d), ["Bad alloc", "cuda"]).select("job_id", F.substring("item_key", 2, 20).cast("long").alias("user_id"))


@query("SELECT event_id, row_number() OVER (ORDER BY epoch_ms(date_trunc('day', ts)) + event_id % 7 * 1000, event_id) AS nth FROM (SELECT * FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 100)")
def chronological_results(spark, d):
    best = read(spark, d, "events").where("event_type = 'purchase'").orderBy(F.desc("value"), "event_id").limit(100)
    shown = best.select(F.col("event_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("published_at"), F.lit(None).cast("string").alias("timeline_at"), (F.col("event_id") % 7 * 1000).alias("start_ms"), F.lit(None).cast("long").alias("timeline_ms"))
    order = merges.chronological(shown).select("doc_id").withColumn("nth", F.monotonically_increasing_id())  # one sorted task of 100 rows
    return order.coalesce(1).select(F.col("doc_id").alias("event_id"), (F.row_number().over(merges.Window.orderBy("nth"))).cast("long").alias("nth"))


# Crawling.

PAGE = 25


def list_pages(spark: SparkSession, d: str) -> crawl.Pages:
    """Events by day, newest first, as a list in pages."""
    events = read(spark, d, "events").where("event_type = 'purchase'").select(F.date_format("ts", "yyyy-MM-dd").alias("published_at"), "event_id")
    rows = crawl.numbered(events, F.desc("published_at"), F.desc("event_id")).select(F.floor(F.col("at") / PAGE).cast("int").alias("page"), (F.col("at") % PAGE).alias("nth"), F.col("event_id").cast("string").alias("item_id"), "published_at")
    shared_folder(spark)
    rows = rows.checkpoint(eager=True)
    return lambda a, b: rows.where((F.col("page") >= a) & (F.col("page") < b))


_LIST = f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS p, (row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) - 1) // {PAGE} AS page FROM events WHERE event_type = 'purchase'"
_OLD = "(SELECT strftime(max(ts) - INTERVAL 9 DAY, '%Y-%m-%d') FROM events)"


@query(
    f"""WITH l AS ({_LIST}), f AS (SELECT *, p < {_OLD} OR p = {_OLD} AND event_id % 2 = 0 AS b, p <= {_OLD} AND event_id % 41 <> 0 AS k FROM l), s AS (SELECT min(page) AS stop FROM (SELECT page FROM f WHERE page >= 2 GROUP BY page HAVING bool_and(b AND k)))
SELECT event_id, page, k AS known, NOT k OR page < 2 OR NOT b AS fetch FROM f, s WHERE stop IS NULL OR page <= stop"""
)
def sync_latest(spark, d):
    """Items up to a mark nine days back are known but for every 41st; pages go on until one holds nothing new."""
    pages = list_pages(spark, d)
    old = read(spark, d, "events").agg(F.date_format(F.max("ts") - F.expr("interval 9 days"), "yyyy-MM-dd").alias("p")).first()["p"]
    known = pages(0, 1 << 30).where((F.col("published_at") <= old) & (F.col("item_id").cast("long") % 41 != 0))
    ties = pages(0, 1 << 30).where((F.col("published_at") == old) & (F.col("item_id").cast("long") % 2 == 0)).select("item_id")  # one day's, which grow with the list
    out, _ = crawl.sync_latest(pages, known, crawl.Mark(old, ties), refresh_pages=2, block=4)
    return out.select(F.col("item_id").cast("long").alias("event_id"), F.col("page").cast("long").alias("page"), "known", "fetch")


@query(f"WITH l AS ({_LIST}), p AS (SELECT * FROM l WHERE page = 0) SELECT p AS published_at, event_id FROM p WHERE p = (SELECT max(p) FROM p)")
def page_watermark(spark, d):
    mark = crawl.page_mark(list_pages(spark, d)(0, 3))
    return spark.createDataFrame([(mark.published_at, int(i)) for i in mark.item_ids], "published_at string, event_id long")


@query(f"SELECT event_id, page, (SELECT least(8, max(page) + 1) FROM ({_LIST})) AS cursor FROM ({_LIST}) WHERE page BETWEEN 3 AND 7 AND event_id % 3 <> 0")
def backfill_pages(spark, d):
    pages = list_pages(spark, d)
    fresh, cursor, _ = crawl.backfill(pages, pages(0, 1 << 30).where("item_id % 3 = 0"), 3, 5)
    return fresh.select(F.col("item_id").cast("long").alias("event_id"), F.col("page").cast("long").alias("page"), F.lit(cursor).cast("long").alias("cursor"))


def served(rows: DataFrame, place: Column) -> str:
    """Rows as a service's files, one folder for each place (a page, or an item), by their JSON."""
    at = folder(rows.sparkSession)
    rows.select(place.alias("place"), F.to_json(F.struct("*")).alias("value")).repartition("place").write.partitionBy("place").text(at)
    return at.removeprefix("file:")


def files_of(at: str, place: object) -> list[dict]:
    """What a place holds; nothing where there is no such folder."""
    found = sorted(glob.glob(f"{at}/place={place}/*.txt"))
    return [json.loads(line) for name in found for line in open(name, encoding="utf-8")]  # noqa: SIM115


@query("SELECT page_id, url, (SELECT count(*) + 199 FROM pages) // 200 AS fetched FROM pages")
def list_page(spark, d):
    """Pages through a list of unknown length, as a stream whose offset is the cursor; each page of it is asked for once."""
    rows = crawl.numbered(read(spark, d, "pages").select("page_id", "url"), F.asc("page_id"), F.asc("url"))
    at, out = served(rows, F.floor(F.col("at") / 200)), folder(spark)
    asked = f"{folder(spark)}-asked".removeprefix("file:")

    def get(path: str, params: dict) -> tuple[int, str, str]:
        found = files_of(at, params["page[offset]"] // 200) if params["page[offset]"] % 200 == 0 else []
        if found:
            with open(asked, "a", encoding="utf-8") as log:
                log.write("page\n")
        return 200, "application/json", json.dumps({"data": sorted(found, key=lambda r: r["at"])})

    source = paged_stream.list_stream("tidepool_list", "page_id long, url string", paged_stream.Fetcher(get), lambda page: [(r["page_id"], r.get("url")) for r in page["data"]])
    spark.dataSource.register(source)
    stream = spark.readStream.format("tidepool_list").option("path", "pages").option("limit", 200).load()
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").start(out)
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(out).withColumn("fetched", F.lit(os.path.getsize(asked) // 5 if os.path.exists(asked) else 0).cast("long"))


@query("SELECT n_nationkey, n_name, 'region' AS included FROM nation WHERE n_nationkey IN (3, 7, 11)")
def get_items(spark, d):
    """Single items by id, each with what its type includes; one file is read for each."""
    at = served(read(spark, d, "nation"), F.col("n_nationkey"))

    def fetch(place: str, include: str) -> list[tuple]:
        return [(r["n_nationkey"], r["n_name"], include) for r in files_of(at, place.split("/")[1])]

    spark.dataSource.register(readers.item_source("tidepool_nations", "n_nationkey long, n_name string, included string", fetch, {"nations": "region"}))
    return spark.read.format("tidepool_nations").option("type", "nations").option("ids", "3,7,11").load()


# Files.


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS users, conv_id % 2 = 0 AS official, (SELECT count(DISTINCT conv_id) FROM conversations) AS files FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id")
def normalized_files(spark, d):
    """Record files written a type a folder, read back, counted, and narrowed to official ones."""
    at = folder(spark)
    turns = read(spark, d, "conversations")
    # One record, a conversation, a file's line; its users are its turns of that role.
    rows = turns.groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("n"))
    record = rows.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), (F.col("conv_id") % 2 == 0).alias("is_official"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.cast("string").alias("id"), F.lit(False).alias("is_official"))).alias("users"))).alias("value"))
    record.repartition(4).write.text(f"{at}/radios")
    back = spark.read.schema(readers.RECORD).option("recursiveFileLookup", "true").json(f"{at}/radios")
    found = readers.in_scope(back.withColumn("type", F.lit("radios")), ["radios"], official_only=True)
    return found.select(F.col("id").cast("long").alias("conv_id"), F.size("users").cast("long").alias("users"), F.col("is_official").alias("official"), F.lit(back.count()).cast("long").alias("files"))


@query("SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def transcript_files(spark, d):
    """Transcript payloads, JSON objects with segments and no text, parsed to text."""
    at = folder(spark)
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).where(F.size("t") > 1)
    payload = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["turn"].alias("start_ms"), (t["turn"] + 1).alias("end_ms"), t["text"].alias("text"))).alias("segments")))
    turns.select(F.col("conv_id").cast("string").alias("conv_id"), payload.alias("value")).write.parquet(at)
    raw = spark.read.parquet(at)
    return raw.select(F.col("conv_id").cast("long").alias("conv_id"), readers.payload_text(F.col("value")).alias("text"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def write_jsonl(spark, d):
    at = folder(spark)
    sinks.write_lines(read(spark, d, "documents").select("doc_id", "source", "n_chars", F.lit(None).cast("string").alias("none")), at)
    back = spark.read.schema("doc_id long, source string, n_chars long, none string").json(at)
    return back.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT lang AS collection, count(*) AS documents, count(*) FILTER (vec_id IS NOT NULL) AS vectors, '' AS faults FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE lang = 'fr' GROUP BY lang")
def export_bundle(spark, d):
    docs = memory_docs(read(spark, d, "documents")).withColumn("collection_name", F.col("category"))
    points = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    m = sinks.export_bundle(docs, points, "fr", at := folder(spark))
    held = readers.snapshot(spark, f"{at}/manifest")
    return spark.createDataFrame([(held["collection"], held["documents"], held["vectors"], ",".join(sinks.manifest_faults(m)))], "collection string, documents long, vectors long, faults string")


@query("SELECT o_custkey AS state_key, max(o_orderkey) AS last FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey")
def state_log(spark, d):
    """Key-value state as a log, its last entries read; NULL payloads delete their key."""
    at = folder(spark)
    rows = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("state_key"), F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("payload_json"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("updated_at"))
    gone = rows.where("state_key % 5 = 0").select("state_key", F.lit(None).cast("string").alias("payload_json"), F.lit("9" * 12).alias("updated_at")).distinct()
    rows.unionByName(gone).write.json(at)
    return sinks.read_state(spark, at).select(F.col("state_key").cast("long").alias("state_key"), F.get_json_object("payload_json", "$.k").cast("long").alias("last"))


# Records.


@query(
    """SELECT conv_id, coalesce(string_agg(role, ',' ORDER BY turn DESC) FILTER (role <> 'system'), '') AS speakers, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS notes, md5(string_agg(text, '|' ORDER BY turn)) AS told,
count(*) FILTER (turn % 3 = 0) + 2 AS jobs, 'https://img.example/c.png' AS cover FROM conversations GROUP BY conv_id"""
)
def json_records(spark, d):
    """Nested documents with included objects, built from conversations, parsed and normalised; an album has a chapter with a medium."""
    turns = read(spark, d, "conversations").where(F.col("conv_id").isNotNull())
    made = lambda kind, name, attributes, relations="{}": F.concat(F.lit(f'{{"type":"{kind}","id":"'), name, F.lit('","attributes":'), attributes, F.lit(',"relationships":'), relations if isinstance(relations, Column) else F.lit(relations), F.lit("}"))
    ref = lambda kind, name: F.concat(F.lit(f'{{"type":"{kind}","id":"'), name, F.lit('"}'))
    t = F.col("turn").cast("string")
    note = made("timelines", t, F.to_json(F.struct((F.col("turn") * 10).cast("string").alias("at"), F.col("role").alias("title"), F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a/"), t)).alias("asset"))))
    person = made("users", t, F.to_json(F.struct(F.when(F.col("role") != "system", F.col("role")).alias("nickname"))))
    # One document a conversation.
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("o"), t.alias("t"), note.alias("note"), person.alias("person")))).alias("x"))
    listed = lambda kind: F.concat(F.lit('{"data":['), F.array_join(F.transform("x", lambda e: ref(kind, e["t"])), ","), F.lit("]}"))
    medium = made("medias", F.lit("m"), F.lit('{"media-type":"audio","audio":"a.mp3"}'), F.concat(F.lit('{"timelines":'), listed("timelines"), F.lit("}")))
    chapter = made("radios", F.lit("c"), F.lit('{"title":"chapter"}'), F.lit('{"media":{"data":[{"type":"medias","id":"n"}]}}'))
    plain = made("medias", F.lit("n"), F.lit('{"media-type":"vod","playlist":"/p.m3u8"}'))
    relations = F.concat(F.lit('{"user":'), listed("users"), F.lit(',"media":{"data":{"type":"medias","id":"m"}},"published-radios":{"data":[{"type":"radios","id":"c"}]}}'))
    data = made("albums", F.col("conv_id").cast("string"), F.lit('{"title":"T","cover":"c.png"}'), relations)
    included = F.concat(F.lit("["), F.array_join(F.concat(F.transform("x", lambda e: e["note"]), F.transform("x", lambda e: e["person"]), F.array(medium, chapter, plain)), ","), F.lit("]"))
    raw = rows.select(records.parse_document(F.concat(F.lit('{"data":'), data, F.lit(',"included":'), included, F.lit("}"))).alias("document"))
    site = records.Site("https://site.example", "https://img.example", "https://audio.example")
    found = records.normalize_documents(raw, site=site)
    n_jobs = records.media_jobs(found).groupBy("item_key").agg(F.count("*").alias("jobs"))
    notes = F.col("media")[0]["timelines"]
    names = F.array_compact(F.transform("users", lambda u: u["nickname"]))
    return found.join(n_jobs, "item_key").select(
        F.col("id").cast("long").alias("conv_id"), F.array_join(names, ",").alias("speakers"), F.array_join(F.transform(notes, lambda n: n["id"]), ",").alias("notes"), F.md5(F.array_join(F.transform(notes, lambda n: n["content"]), "|")).alias("told"), "jobs", F.col("cover_url").alias("cover")
    )


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://site.example/radios/' || page_id WHEN page_id % 3 = 1 THEN 'https://site.example/videos/' || page_id END AS entry, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://img.example/' || page_id END AS asset,
CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://site.example/x/' || page_id END AS absolute, CASE WHEN page_id % 5 = 0 THEN 'unsupported asset authority' WHEN page_id % 5 = 1 THEN 'unsupported asset host' WHEN page_id % 5 = 2 THEN 'unsupported asset url' WHEN page_id % 5 = 3 THEN 'invalid asset url' END AS fault,
CASE WHEN page_id % 2 = 0 THEN 'd/a.b/c.m4a' ELSE 'd/a.b/c.mp3' END AS path, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS media FROM pages"""
)
def url_builders(spark, d):
    p = F.col("page_id").cast("string")
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "radios").when(k % 3 == 1, "videos").otherwise("other")
    odd = lambda x: F.when(k % 2 == 0, F.col("url")).otherwise(x)
    asked = F.when(k % 5 == 0, "https://u:p@cdn.site.example/a").when(k % 5 == 1, "http://evilsite.example/a").when(k % 5 == 2, "ftp://site.example/a").when(k % 5 == 3, "http://site.example:99999/a").otherwise("https://CDN.site.example:443/a")
    new = F.when(k % 2 == 0, "https://x.example/y.z/f.m4a?q=1.5").otherwise("https://x.example/y.z/f")
    return read(spark, d, "pages").select(
        "page_id", web.entry_url(kind, p, "https://site.example", ["radios", "videos"]).alias("entry"), web.asset_url(odd(p), "https://img.example").alias("asset"), web.absolute_url(odd(F.concat(F.lit("/x/"), p)), "https://site.example").alias("absolute"),
        web.media_url_fault(asked, "site.example").alias("fault"), web.with_suffix_of(F.lit("d/a.b/c.mp3"), new).alias("path"), web.media_id(F.when(k % 2 == 0, F.concat(F.lit("https://cdn/v/"), p, F.lit("_hd.mp3"))).otherwise("none"), r"/v/(\d+)_").alias("media"),
    )


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_ms(date_trunc('second', ts)) WHEN 1 THEN epoch_ms(date_trunc('second', ts)) - 28800000 WHEN 2 THEN epoch_ms(date_trunc('second', ts)) WHEN 3 THEN epoch_ms(date_trunc('day', ts)) END AS ms FROM events"""
)
def timestamps(spark, d):
    """Times with Z, with an offset, without either, days, and what is no time."""
    k, shown = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(k == 0, F.concat(shown, F.lit("Z"))).when(k == 1, F.concat(shown, F.lit("+08:00"))).when(k == 2, shown).when(k == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.concat(F.lit("at "), shown))
    return read(spark, d, "events").select("event_id", F.unix_millis(web.timestamp(given)).alias("ms"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id END AS k, CASE WHEN event_id % 4 = 0 THEN [1, event_id % 7, 0] ELSE [2, 0] END >= [1, 4] AS recent FROM events")
def loose_json(spark, d):
    """Objects alone, within prose, arrays and broken ones; versions compared by their numbers."""
    k, inner = F.col("event_id") % 4, F.to_json(F.struct(F.col("user_id").alias("k")))
    said = F.when(k == 0, inner).when(k == 1, F.concat(F.lit("Here: "), inner, F.lit(" done"))).when(k == 2, F.concat(F.lit("["), F.lit("1"), F.lit("]"))).otherwise(F.concat(inner, F.lit("} broken")))
    version = F.when(k == 0, F.concat(F.lit("1."), (F.col("event_id") % 7).cast("string"), F.lit(".x"))).otherwise("2.beta")
    return read(spark, d, "events").select("event_id", F.get_json_object(web.json_object(said), "$.k").cast("long").alias("k"), (web.version(version) >= web.version(F.lit("1.4"))).alias("recent"))


@query(
    """SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), 'tion', '<mark>tion</mark>'), 'the', '<mark>the</mark>')) AS marked,
array_to_string(list_filter(['ention', 'ment', 'heit'], lambda t: contains(regexp_replace(text, '\\s+', '', 'g'), t)), ',') AS whole FROM documents"""
)
def highlight(spark, d):
    docs = texts(spark, d)
    whole = F.filter(F.array(*map(F.lit, ("ention", "ment", "heit"))), lambda t: F.array_contains(F.concat(web.overlap_terms("ention", F.col("text"), sizes=(6,)), web.overlap_terms("ment", F.col("text"), sizes=(4,)), web.overlap_terms("heit", F.col("text"), sizes=(4,))), t))
    return docs.select("doc_id", F.md5(web.highlight(F.col("text"), ["the", "tion"])).alias("marked"), F.array_join(whole, ",").alias("whole"))


# Transcripts.


@query("SELECT conv_id, turn, turn * 10 AS start_ms, CASE WHEN turn % 2 = 0 THEN turn * 10 + 5 ELSE turn * 10 + 7 END AS end_ms, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS speaker, len(string_split(text, ' ')) AS words FROM conversations")
def remote_segments(spark, d):
    """Utterances of a remote recogniser as segments with their words; bounds come under several names."""
    said = read(spark, d, "conversations").select(
        "conv_id", "turn",
        F.struct((F.col("turn") * 10).alias("start_time"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 10 + 5).alias("end_time"), F.when(F.col("turn") % 2 != 0, F.col("turn") * 10 + 7).alias("stop_time"), F.col("text").alias("text"),
                 F.create_map(F.lit("speaker"), F.when(F.col("turn") % 3 != 0, F.col("role"))).alias("additions"), F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), F.lit(1).alias("start_time"), F.lit(2).alias("end_time"))).alias("words")).alias("u"),
    )
    rows = said.select("conv_id", "turn", segments.remote_segment(F.col("u")).alias("s"), segments.remote_words(F.array("u")).alias("w"))
    return rows.select("conv_id", "turn", F.coalesce("s.start_ms", F.lit(0)).cast("long").alias("start_ms"), F.col("s.end_ms").cast("long").alias("end_ms"), F.col("s.speaker_id").alias("speaker"), F.size("w").cast("long").alias("words"))


@query(
    """SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS text, sum(length(text))::BIGINT AS chars, count(*) AS chunks, min(turn * 1000) FILTER (turn > 0) AS second FROM conversations GROUP BY conv_id"""
)
def merge_chunks(spark, d):
    """Chunk payloads with offsets merged to one: texts joined, segments and words moved by their chunk's offset."""
    seg = F.struct(F.lit(0).cast("long").alias("start_ms"), F.length("text").cast("long").alias("end_ms"), F.col("text").alias("text"), F.lit(None).cast("string").alias("speaker_id"))
    part = F.struct("turn", "text", F.array(seg).alias("segments"), F.array(F.struct(F.lit(0).alias("segment_index"), F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"), F.col("text").alias("text"))).alias("words"), F.lit("m").alias("model_name"), F.lit("en").alias("language"), (F.col("turn") * 1000).cast("long").alias("offset_ms"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    one = rows.select("conv_id", segments.shifted(F.col("p")).alias("m"))
    chars = F.aggregate("m.segments", F.lit(0).cast("long"), lambda acc, s: acc + s["end_ms"] - s["start_ms"])
    second = F.array_min(F.filter(F.transform("m.words", lambda w: w["start_ms"]), lambda x: x > 0))
    return one.select("conv_id", F.nullif(F.col("m.text"), F.lit("")).alias("text"), chars.alias("chars"), F.col("m.chunk_count").cast("long").alias("chunks"), second.alias("second"))


@query("SELECT doc_id, md5(replace(text, 'tion', 'XX')) AS digest, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) * 2 AS n FROM documents")
def alias_segments(spark, d):
    """Aliases replaced in a transcript's text and in each of its segments, with one count for all."""
    docs = texts(spark, d).select("doc_id", "text", F.array(F.struct(F.col("text").alias("text"))).alias("segments"))
    whole, parts, counts = segments.aliased(F.col("text"), F.col("segments"), {"tion": "XX"})
    return docs.select("doc_id", whole.alias("w"), parts.alias("p"), counts["tion->XX"].cast("long").alias("n")).where(F.col("w") == F.col("p")[0]["text"]).select("doc_id", F.md5("w").alias("digest"), "n")


# Vectors and the index.


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("collection_name"), F.col("vec_id").cast("string").alias("doc_id"), F.col("label").cast("string").alias("doc_type"), (F.col("vec_id") % 10).cast("string").alias("item_key"), "embedding")


@query("SELECT CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS collection_name, vec_id FROM embeddings UNION ALL SELECT 'b', vec_id FROM embeddings WHERE vec_id % 2 = 0 AND label IN (0, 1) AND vec_id % 10 = 4")
def vector_copy(spark, d):
    out = vectors.copied(vector_table(spark, d), "a", "b", ["0", "1"], ["4"])
    return out.select("collection_name", F.col("doc_id").cast("long").alias("vec_id"))


@query("SELECT 'reset' AS part, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS name, count(*) AS n FROM embeddings WHERE vec_id % 2 <> 0 GROUP BY ALL UNION ALL SELECT 'misfit', CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END, count(*) FROM embeddings WHERE vec_id % 5 = 0 GROUP BY ALL UNION ALL SELECT 'scroll', 'b', count(*) FROM embeddings WHERE vec_id % 2 <> 0 AND label = 3")
def vector_upkeep(spark, d):
    rows = vector_table(spark, d)
    size = len(rows.first()["embedding"])
    cut = rows.withColumn("embedding", F.when(F.col("item_key").isin("0", "5"), F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    reset = vectors.reset(rows, "a").groupBy("collection_name").agg(F.count("*").alias("n")).select(F.lit("reset").alias("part"), F.col("collection_name").alias("name"), "n")
    odd = vectors.misfits(cut, size).select(F.lit("misfit").alias("part"), F.col("collection_name").alias("name"), "n")
    seen = vectors.scroll(rows, "b", ["3"]).agg(F.count("*").alias("n")).select(F.lit("scroll").alias("part"), F.lit("b").alias("name"), "n")
    return reset.unionByName(odd).unionByName(seen)


@query("SELECT item_key FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item_key FROM orders) WHERE item_key > '50' ORDER BY item_key LIMIT 30")
def resumable_items(spark, d):
    """The next items of a pass that stopped behind one."""
    return vectors.next_items(read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("item_key")), "50", 30)


@query(
    """WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT 'documents' AS part, conv_id AS key, CASE WHEN conv_id % 5 = 0 OR conv_id % 3 = 0 THEN 'old' ELSE 'new' END AS state FROM c WHERE conv_id % 3 = 0 OR conv_id % 5 <> 0 OR conv_id % 10 = 0
UNION ALL SELECT 'jobs', conv_id, CASE WHEN conv_id % 5 = 0 THEN 'no normalised record' ELSE 'completed' END FROM c WHERE conv_id % 3 <> 0 UNION ALL SELECT 'mark', -1, '2024-01-0' || max(1 + conv_id % 3) FROM c WHERE conv_id % 3 <> 0 AND conv_id % 5 <> 0"""
)
def sync_index(spark, d):
    """Conversations as items: every third is unchanged, every fifth has no record (the even ones among them an old document)."""
    from tidepool.plans.indexing import sync_index as sync

    turns = read(spark, d, "conversations")
    key, none = F.col("conv_id").cast("string").alias("item_key"), F.lit(None)
    ids = turns.select("conv_id").distinct()
    changed = F.when(F.col("conv_id") % 3 == 0, "2023-12-31").otherwise(F.concat(F.lit("2024-01-0"), (1 + F.col("conv_id") % 3).cast("string")))
    items = ids.select(key, F.lit("2023-01-01").alias("updated_at"))
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") * 9000).cast("long").alias("start_ms"), (F.col("turn") * 9000 + 8000).cast("long").alias("end_ms"), "text", F.col("role").alias("speaker_id")))).alias("segments"))
    transcripts = said.select(key, changed.alias("updated_at"), "segments")
    empty = lambda kind: none.cast(kind)
    whole = spark.createDataFrame([], readers.RECORD)
    record = ids.where("conv_id % 5 <> 0").select(key, F.col("conv_id").cast("string").alias("id"), *[F.lit("T").alias(f.name) if f.name == "title" else F.array().cast(f.dataType).alias(f.name) if f.name in ("users", "media", "tags", "chapters") else empty(f.dataType).alias(f.name) for f in whole.schema.fields if f.name != "id"])
    before = ids.where("conv_id % 3 = 0 OR conv_id % 10 = 0").select(key, F.concat(F.col("conv_id").cast("string"), F.lit(":title:0000")).alias("doc_id"), F.lit("item_title").alias("doc_type"), F.lit("old").alias("keyword_text"), F.lit("c").alias("collection_name"))
    unknown = spark.createDataFrame([], "job_key string, item_key string, transcript_id string, job_type string, payload_json string, attempt_count int, status string, last_error string, updated_at string, completed_at string")
    out = sync(before, unknown, items, record, transcripts, "c", AT, since="2024-01-01T00:00:00+00:00")
    fresh = out.documents.where("doc_type = 'item_title'").select(F.lit("documents").alias("part"), F.col("item_key").cast("long").alias("key"), F.when(F.col("keyword_text") == "old", "old").otherwise("new").alias("state"))
    ended = out.jobs.select(F.lit("jobs").alias("part"), F.col("item_key").cast("long").alias("key"), F.coalesce("last_error", "status").alias("state"))
    mark = spark.createDataFrame([("mark", -1, out.mark)], "part string, key long, state string")
    return fresh.unionByName(ended).unionByName(mark)


@query("SELECT count(*) AS queries, true AS enough, (SELECT count(*) FROM embeddings) AS indexed FROM embeddings WHERE vec_id % 50 = 0")
def vector_ann(spark, d):
    """The inverted-file index over all vectors: recall of the five nearest against brute force, for every 50th vector."""
    from tidepool.operators import ann

    points = read(spark, d, "embeddings")
    asked = points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    cells = ann.fit(points, key="vec_id")
    at = folder(spark)
    ann.indexed(spread(points), cells).hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(at)
    index = spark.read.parquet(at)
    probes, _ = ann.probes_for(index, cells, asked, 5, key="vec_id")
    got = ann.recall(index, cells, asked, 5, probes, key="vec_id")
    return spark.createDataFrame([(asked.count(), got >= 0.9, index.count())], "queries long, enough boolean, indexed long")


@query(
    f"""SELECT 'type' AS part, {KIND_SQL} AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'items', '', count(DISTINCT source) FROM documents
UNION ALL SELECT 'category', trim(lang), count(*) FROM documents WHERE lang = 'en' AND trim(lang) <> '' GROUP BY 2"""
)
def memory_meta(spark, d):
    """Counts of a memory: documents of each type, items, and categories of its title documents."""
    docs = memory_docs(read(spark, d, "documents"))
    meta = Memory(docs.withColumn("doc_type", F.when(F.col("doc_type") == "scene_summary", "item_title").otherwise(F.col("doc_type")))).meta()
    types = {"scene_summary" if k == "item_title" else k: n for k, n in meta["doc_types"].items()}
    rows = [("type", k, n) for k, n in types.items()] + [("items", "", meta["items"])] + [("category", c["category"], c["n"]) for c in meta["categories"]]
    return spark.createDataFrame(rows, "part string, name string, n long")


@query(
    f"""SELECT doc_id, item_key FROM (SELECT doc_id, source AS item_key, {KIND_SQL} AS t FROM documents) ORDER BY item_key, CASE t WHEN 'timeline_note' THEN 1 WHEN 'evidence_atom' THEN 2 WHEN 'scene_summary' THEN 3 WHEN 'episode_card' THEN 4 ELSE 99 END, doc_id LIMIT 300"""
)
def documents_in_order(spark, d):
    return memory_docs(read(spark, d, "documents")).orderBy("item_key", *merges.document_order()).limit(300).select("doc_id", "item_key")


_MARKED = "CASE doc_id % 4 WHEN 0 THEN text || ' 接下来' WHEN 1 THEN '“quoted  part” and \"' || text || '\"' WHEN 2 THEN '?!...' ELSE text || repeat('x', 12) END"


@query(
    f"""SELECT doc_id, contains(t, '接下来') AS anchor, doc_id % 4 = 2 OR len(list_filter(generate_series(1, length(c) - 11), lambda i: substring(c, i::INT, 12) = repeat(substring(c, i::INT, 1), 12))) > 0 AS low,
CASE WHEN doc_id % 4 = 1 THEN 'quoted part' ELSE '' END AS first_quote FROM (SELECT doc_id, t, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS c FROM (SELECT doc_id, {_MARKED} AS t FROM documents))"""
)
def text_marks(spark, d):
    """Anchor phrases, segments of no signal and quoted phrases, in texts that were given them."""
    k = F.col("doc_id") % 4
    marked = F.when(k == 0, F.concat("text", F.lit(" 接下来"))).when(k == 1, F.concat(F.lit("“quoted  part” and \""), "text", F.lit("\""))).when(k == 2, "?!...").otherwise(F.concat("text", F.lit("x" * 12)))
    docs = texts(spark, d).select("doc_id", marked.alias("t"))
    return docs.select("doc_id", text.has_anchor(F.col("t")).alias("anchor"), text.is_low_signal(F.col("t")).alias("low"), F.coalesce(F.get(text.quoted_phrases(F.col("t")), F.lit(0)), F.lit("")).alias("first_quote"))


@query(
    """WITH p AS (SELECT doc_id, list_transform(generate_series(0, greatest(0, length(text) - 1), 380), lambda i: trim(substring(text, i + 1, 400))) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(list_reduce(p, lambda a, b: CASE WHEN b = '' THEN a WHEN a = '' THEN b ELSE a || substring(b, coalesce(list_max(list_filter(generate_series(1, least(80, length(a), length(b))), lambda n: right(right(a, 80), n) = left(b, n))), 0)::INT + 1) END)) AS digest FROM p"""
)
def stitched(spark, d):
    """Whole texts cut into parts of 400 letters that overlap by twenty, joined again."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(380)), lambda i: F.substring("text", i + 1, F.lit(400)))
    return texts(spark, d).where("text is not null").select("doc_id", F.md5(text.stitch(parts)).alias("digest"))


@query(
    f"""{_WALK}, said AS (SELECT w.conv_id, w.idx, string_agg(s.text, ' ' ORDER BY w.rn) AS t FROM walk w JOIN s ON s.conv_id = w.conv_id AND s.rn = w.rn GROUP BY w.conv_id, w.idx)
SELECT conv_id || ':atom:' || lpad(CAST(idx AS VARCHAR), 4, '0') AS doc_id, 'evidence_atom' AS doc_type, md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS digest, a AS start_ms FROM said JOIN atoms USING (conv_id, idx)
UNION ALL SELECT DISTINCT conv_id || ':title:0000', 'item_title', md5('T' || conv_id), NULL FROM conversations"""
)
def built_documents(spark, d):
    """Title and atom documents that the builders make of conversations."""
    turns = read(spark, d, "conversations")
    said = spoken(turns).withColumn("item_key", F.col("item_key").cast("string"))
    ids = turns.select(F.col("conv_id").cast("string").alias("item_key")).distinct()
    shape = spark.createDataFrame([], readers.RECORD).schema.fields
    title = F.concat(F.lit("T"), "item_key")
    lists = ("users", "media", "tags", "chapters")
    record = ids.select("item_key", *[title.alias("title") if f.name == "title" else F.array().cast(f.dataType).alias(f.name) if f.name in lists else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])
    made = documents.title_documents(record).unionByName(documents.atom_documents(record, said))
    return made.select("doc_id", "doc_type", F.md5("keyword_text").alias("digest"), "start_ms")


_LOG = """SELECT user_id AS log, event_id AS tick, CASE WHEN event_id % 5 <> 0 THEN event_type END AS step, CASE WHEN event_id % 5 = 0 THEN CASE WHEN value > 30 THEN 'running' ELSE 'completed' END WHEN value > 66 THEN 'running' WHEN value > 33 THEN 'completed' WHEN value < 5 THEN 'skipped' END AS status,
event_id % 7 AS current, CASE WHEN event_id % 3 = 0 THEN 7 END AS total, event_id % 10 = 0 AND event_id % 3 = 0 AS new_run FROM events"""


@query(
    f"""WITH l AS ({_LOG}), p AS (SELECT *, last_value(CASE WHEN step IS NULL THEN status END IGNORE NULLS) OVER (PARTITION BY log ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l),
r AS (SELECT *, sum(CASE WHEN step IS NULL AND status = 'running' AND (new_run OR prev IS NULL OR prev <> 'running') THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY tick) AS run FROM p),
m AS (SELECT * FROM (SELECT *, max(run) OVER (PARTITION BY log) AS newest FROM r) WHERE run = newest AND step IS NOT NULL),
q AS (SELECT *, last_value(status IGNORE NULLS) OVER (PARTITION BY log, step ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sp FROM m),
e AS (SELECT *, sum(CASE WHEN status = 'running' AND (sp IS NULL OR sp <> 'running') OR status = 'skipped' THEN 1 ELSE 0 END) OVER (PARTITION BY log, step ORDER BY tick) AS era FROM q),
t AS (SELECT log, step, era, arg_max(status, tick) FILTER (status IS NOT NULL) AS status, arg_max(current, tick) AS current, arg_max(total, tick) FILTER (total IS NOT NULL) AS total FROM e WHERE (log, step, era) IN (SELECT (log, step, max(era)) FROM e GROUP BY log, step) GROUP BY ALL)
SELECT log, step, coalesce(status, 'pending') AS status, current, total, CASE WHEN status = 'completed' THEN 100.0 WHEN total > 0 THEN round(current * 100.0 / total, 2) END::DOUBLE AS percent FROM t"""
)
def run_progress(spark, d):
    from tidepool.streaming import progress

    k, v = F.col("event_id"), F.col("value")
    of_run = F.when(v > 30, "running").otherwise("completed")
    of_step = F.when(v > 66, "running").when(v > 33, "completed").when(v < 5, "skipped")
    log = read(spark, d, "events").select(
        F.col("user_id").alias("log"), k.alias("at"), F.when(k % 5 != 0, F.col("event_type")).alias("step"), F.when(k % 5 == 0, of_run).otherwise(of_step).alias("status"),
        (k % 7).alias("current"), F.when(k % 3 == 0, 7).alias("total"), ((k % 10 == 0) & (k % 3 == 0)).alias("new_run"),
    )
    return progress.steps(log)


@query(
    f"""SELECT event_id AS job_id, CASE WHEN hit THEN 'https://new.example/' || event_id || '.m4a' ELSE CASE WHEN event_id % 3 = 0 THEN 'https://old.example/v/' || event_id || '_hd.mp3' ELSE 'https://other.example/x.mp3' END END AS media_url,
CASE WHEN hit THEN 'd/' || event_id || '.m4a' ELSE 'd/' || event_id || '.mp3' END AS local_relpath, CASE WHEN hit THEN 'pending' ELSE {_STATUS} END AS status FROM (SELECT *, event_id % 3 = 0 AND event_id % 2 = 0 AS hit FROM events)"""
)
def replaced_media(spark, d):
    """Media under an old address, every third, resolved to new ones, of which the odd ones are not found."""
    from tidepool.operators import rescue

    k = F.col("job_id").cast("string")
    rows = jobs(spark, d).withColumns({"media_url": F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("https://old.example/v/"), k, F.lit("_hd.mp3"))).otherwise("https://other.example/x.mp3"), "local_relpath": F.concat(F.lit("d/"), k, F.lit(".mp3"))})
    found = rescue.replacements(rows, r"old\.example/v/(\d+)_", lambda ids: [f"https://new.example/{i}.m4a" if int(i) % 2 == 0 else None for i in ids])
    return rescue.replaced(rows, found, AT).select("job_id", "media_url", "local_relpath", "status")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ' scene' WHEN 1 THEN 'F' WHEN 2 THEN '' ELSE '' END AS title, CASE WHEN doc_id % 4 = 0 THEN 'a,b' ELSE '' END AS clues, CASE doc_id % 2 WHEN 0 THEN source ELSE coalesce(nullif(trim(substring(trim(text), 1, 18)), ''), 'T片段') END AS by_rule,
CASE WHEN doc_id % 4 = 1 THEN '3,5' ELSE '' END AS ends FROM documents"""
)
def summaries(spark, d):
    """A writer's answers cleaned, and summaries by rule."""
    from tidepool.functions import summaries as s

    k = F.col("doc_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit('Sure: {"scene_title": " '), "lang", F.lit(' scene ", "summary": "s", "memory_clues": [" a ", "b", "a", ""], "entities": "none"}')))
        .when(k == 1, '{"summary": 1, "boundaries": [3, 5]}').when(k == 2, "no object").otherwise("[1, 2]")
    )
    made = s.sanitized(answer, F.lit("F"))
    rule = s.fallback_scene(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.array("source")), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit("T"))
    return texts(spark, d).select("doc_id", F.coalesce(made["scene_title"], F.lit("")).alias("title"), F.coalesce(F.array_join(made["memory_clues"], ","), F.lit("")).alias("clues"), F.trim(rule["scene_title"]).alias("by_rule"), F.array_join(s.boundaries(answer).cast("array<string>"), ",").alias("ends"))


@query(f"SELECT doc_id, source, lang, lexical_score FROM ({TOP50})")
def lexical_indexed_topk(spark, d):
    """The lexical top-k by an index of letter trigrams."""
    from tidepool.operators import gram_index

    docs = texts(spark, d)
    gram_index.write_index(docs, at := folder(spark), item="source", part_docs=500)
    return gram_index.indexed_topk(docs, gram_index.read_index(spark, at), TERMS, 50, order=("lang", "source", "doc_id")).select("doc_id", "source", "lang", "lexical_score")
