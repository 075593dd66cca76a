"""All queries over the shared tables, by name, and their SQL twins.

Tables stand in for those of a memory search: documents for search documents (source: item, lang: category), embeddings
for vector points, events for jobs and timelines, conversations for transcripts, labels for what has a transcript.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import embed, text
from tidepool.operators import context, merges, retrieval, segments, stats
from tidepool.session import shared_folder, spread
from tidepool.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TERMS = ["heit", "tion", "ment", "the", "ciónes"]
LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, for work that costs more on each row than reading it."""
    return spread(read(spark, sf_dir, "documents"))


def score_sql(terms: list[str] = TERMS) -> str:
    return " + ".join(f"CASE WHEN contains({LOW}, '{t}') THEN {retrieval.term_weight(t)} ELSE 0 END" for t in terms)


SCORED = f"SELECT doc_id, source, lang, text, n_chars, {score_sql()} AS lexical_score FROM documents"
TOP50 = f"SELECT * FROM ({SCORED}) WHERE lexical_score > 0 ORDER BY lexical_score DESC, lang, source, doc_id LIMIT 50"
HITS = f"SELECT *, 0.42 + 0.40 * lexical_score / max(lexical_score) OVER () AS score, row_number() OVER (ORDER BY lexical_score DESC, lang, source, doc_id) - 1 AS ord FROM ({TOP50})"
PRIOR = "CASE lang WHEN 'en' THEN 0.18 WHEN 'de' THEN 0.16 WHEN 'fr' THEN 0.12 ELSE 0.06 END"
BONUS = "least(0.26, " + " + ".join(f"CASE WHEN contains(text, '{t}') THEN {0.02 if len(t) <= 2 else 0.05 if len(t) <= 4 else 0.08} ELSE 0 END" for t in TERMS) + ")"
RANKED = f"SELECT *, round(score + {PRIOR} + {BONUS} + CASE WHEN n > 1 THEN least(0.08, 0.02 * (n - 1)) ELSE 0 END, 6) AS rerank_score FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM ({HITS}))"


def top50(docs: DataFrame) -> DataFrame:
    return retrieval.lexical_topk(docs, TERMS, 50, order=("lang", "source", "doc_id"))


def hits(docs: DataFrame) -> DataFrame:
    """At most 50 rows: windows over all of them are small by construction."""
    top = top50(docs)
    place = F.row_number().over(Window.orderBy(F.desc("lexical_score"), "lang", "source", "doc_id")) - 1
    return top.withColumns({"score": retrieval.hit_score(F.col("lexical_score"), F.max("lexical_score").over(Window.partitionBy())), "ord": place})


def ranked(docs: DataFrame) -> DataFrame:
    types = F.create_map(*[F.lit(x) for p in (("en", "item_title"), ("de", "episode_card"), ("fr", "scene_summary")) for x in p])
    none = F.lit(None).cast("string")
    shaped = hits(docs).withColumns(
        {"doc_type": F.coalesce(F.try_element_at(types, F.col("lang")), F.lit("timeline_note")), "item_key": F.col("source"), "keyword_text": F.col("text"), "title": none, "item_title": none,
         "timeline_title": none, "users": F.array().cast("array<string>"), "recall_stage": F.lit("primary")}
    )
    return retrieval.rerank(shaped, TERMS, digits=6)


# Ranked retrieval.


@query(f"SELECT doc_id, source, lang, lexical_score FROM ({TOP50})")
def lexical_topk(spark, d):
    return top50(read(spark, d, "documents")).select("doc_id", "source", "lang", "lexical_score")


@query(f"SELECT doc_id, lexical_score, round(score, 6) AS hit_score FROM ({HITS})")
def lexical_hit_score(spark, d):
    return hits(read(spark, d, "documents")).select("doc_id", "lexical_score", F.round("score", 6).alias("hit_score"))


@query(f"SELECT doc_id, lang, lexical_score FROM ({SCORED}) WHERE lang IN ('de', 'fr') AND lexical_score > 0 ORDER BY lexical_score DESC, lang, source, doc_id LIMIT 20")
def lexical_filtered_topk(spark, d):
    docs = read(spark, d, "documents").where(F.col("lang").isin("de", "fr"))
    return retrieval.lexical_topk(docs, TERMS, 20, order=("lang", "source", "doc_id")).select("doc_id", "lang", "lexical_score")


@query(f"SELECT doc_id, source, rerank_score FROM ({RANKED})")
def rerank_docs(spark, d):
    return ranked(read(spark, d, "documents")).select("doc_id", "source", "rerank_score")


DIVERSE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rerank_score DESC, ord) AS nth FROM ({RANKED})) WHERE nth <= 2 ORDER BY nth, rerank_score DESC, ord LIMIT 10"


@query(f"SELECT doc_id, source, nth, rerank_score FROM ({DIVERSE})")
def diversify_docs(spark, d):
    return retrieval.diversify(ranked(read(spark, d, "documents")), 10).select("doc_id", "source", F.col("nth").cast("long").alias("nth"), "rerank_score")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d)
    named = read(spark, d, "labels").select("doc_id").distinct()
    best = retrieval.diversify(ranked(docs.join(named, "doc_id", "left_semi")), 10)
    shown = text.excerpt(F.col("text"), F.array(*[F.lit(t) for t in TERMS]))
    return best.select("doc_id", F.col("source").alias("item_key"), F.col("lang").alias("category"), "rerank_score", F.array_join("matched_terms", ",").alias("matched_terms"), shown.alias("excerpt"))


_FLAG = DIVERSE.replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_MATCHED = "array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in TERMS) + "], lambda t: contains(text, t)), ',')"
_AT = f"instr({_CLEAN}, list_filter([" + ", ".join(f"'{t}'" for t in TERMS) + f"], lambda t: contains({_CLEAN}, t))[1]) - 1"
_SHOWN = f"""CASE WHEN a - 60 > 0 THEN '...' ELSE '' END || trim(substring(c, greatest(0, a - 60)::INT + 1, (least(length(c), a + 180) - greatest(0, a - 60))::INT))
    || CASE WHEN a + 180 < length(c) THEN '...' ELSE '' END"""
FLAG_SQL = f"SELECT doc_id, source AS item_key, lang AS category, rerank_score, {_MATCHED} AS matched_terms, {_SHOWN} AS excerpt FROM (SELECT *, {_CLEAN} AS c, {_AT} AS a FROM ({_FLAG}))"


@query(FLAG_SQL)
def search_flagship(spark, d):
    return flagship(spark, d)


@query(f"SELECT doc_id, {_SHOWN} AS excerpt FROM (SELECT *, {_CLEAN} AS c, {_AT} AS a FROM documents WHERE contains(text, 'tion'))".replace(str(_AT), f"instr({_CLEAN}, 'tion') - 1"))
def excerpt(spark, d):
    docs = texts(spark, d).where(F.contains("text", F.lit("tion")))
    return docs.select("doc_id", text.excerpt(F.col("text"), F.array(F.lit("tion"))).alias("excerpt"))


VECTORS = "SELECT e.vec_id, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def probe(points: DataFrame, vec_id: int = 0) -> list[float]:
    return points.where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"SELECT * FROM ({VECTORS}) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    points = read(spark, d, "embeddings")
    return retrieval.vector_topk(points, probe(points), 10, key="vec_id", digits=5).select("vec_id", "label", "score")


@query(f"SELECT * FROM ({VECTORS}) WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 10")
def vector_filtered_topk(spark, d):
    points = read(spark, d, "embeddings")
    return retrieval.vector_topk(points.where(F.col("label").isin(1, 3)), probe(points), 10, key="vec_id", digits=5).select("vec_id", "label", "score")


@query(
    f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS ord FROM (SELECT * FROM ({VECTORS}) ORDER BY score DESC, vec_id LIMIT 15)),
b AS (SELECT vec_id, label, score - 0.015 AS score, 14 + row_number() OVER (ORDER BY score DESC, vec_id) AS ord FROM (SELECT * FROM ({VECTORS}) WHERE label IN (0, 1, 2) ORDER BY score DESC, vec_id LIMIT 15))
SELECT vec_id, min(ord) AS ord, round(max(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id"""
)
def vector_second_pass(spark, d):
    points = read(spark, d, "embeddings")
    place = F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))  # over 15 rows
    one = retrieval.vector_topk(points, probe(points), 15, key="vec_id", digits=5).withColumn("ord", place - 1)
    two = retrieval.vector_topk(points.where(F.col("label").isin(0, 1, 2)), probe(points), 15, key="vec_id", digits=5).withColumn("ord", place + 14)
    both = one.unionByName(two.withColumn("score", F.col("score") - 0.015)).withColumnRenamed("vec_id", "doc_id")
    out = retrieval.dedupe_hits(both, ["score"])
    return out.select(F.col("doc_id").alias("vec_id"), F.col("ord").cast("long").alias("ord"), F.round("score", 5).alias("score"))


@query(
    """SELECT query_id, vec_id, nth FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) DESC, e.vec_id) AS nth
FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE nth <= 5"""
)
def vector_knn_per_query(spark, d):
    points = read(spark, d, "embeddings")
    wanted = points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    best = retrieval.nearest(points, wanted, 5, vector="embedding", key="vec_id", digits=9)
    return best.select("query_id", "vec_id", F.col("nth").cast("long").alias("nth"))


# Filters and joins.


@query("SELECT event_id, event_type, CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events WHERE props::JSON->>'$.k' IN ('1', '2', '3')")
def json_category_filter(spark, d):
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").where(k.isin("1", "2", "3")).select("event_id", "event_type", k.cast("long").alias("k"))


@query("SELECT event_id FROM events WHERE list_contains([event_type, 'user' || CAST(user_id % 5 AS VARCHAR)], 'click') AND list_contains([event_type, 'user' || CAST(user_id % 5 AS VARCHAR)], 'user3')")
def json_array_contains_all(spark, d):
    payload = F.to_json(F.struct(F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 5).cast("string"))).alias("users")))
    users = read(spark, d, "events").select("event_id", retrieval.json_users(payload).alias("users"))
    return retrieval.payload_filter(users, participants=("click", "user3")).select("event_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_ready(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_missing(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT doc_id FROM documents d WHERE n_chars > 3000 OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def exists_or_not_exists(spark, d):
    known = read(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("least"))
    docs = read(spark, d, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    return docs.where((F.col("n_chars") > 3000) | (F.col("least") == 0) | F.col("least").isNull()).select("doc_id")


@query(
    """SELECT c_custkey, CAST(max(o_orderdate) AS VARCHAR) AS last_order, CAST(max(l_shipdate) AS VARCHAR) AS last_ship FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey"""
)
def left_join_max(spark, d):
    ship = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    last = read(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.max("o_orderdate").alias("o"), F.max("ship").alias("s"))
    out = read(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("c_custkey", shown("o").alias("last_order"), shown("s").alias("last_ship"))


@query("SELECT pos, doc_id, source FROM (SELECT unnest(range(4)) AS pos, unnest([7, 3, 99, 12]) AS id) JOIN documents ON doc_id = id")
def lookup_by_ids_ordered(spark, d):
    return context.lookup_ordered(read(spark, d, "documents").select("doc_id", "source"), [7, 3, 99, 12]).select(F.col("pos").cast("long").alias("pos"), "doc_id", "source")


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS a, epoch_ms(ts) + CAST(floor(value * 1000) AS BIGINT) AS b FROM events)
SELECT x.event_id, count(y.event_id) AS overlaps FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id <> y.event_id AND y.a <= x.b AND y.b >= x.a GROUP BY x.event_id"""
)
def interval_overlap(spark, d):
    pairs = context.overlapping(intervals(read(spark, d, "events")), ["user_id"], "event_id", "a", "b")
    return pairs.groupBy("event_id").agg(F.count("*").alias("overlaps"))


def ms(c: str = "ts") -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def intervals(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", ms().alias("a"), (ms() + F.floor(F.col("value") * 1000).cast("long")).alias("b"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS a, epoch_ms(ts) + CAST(floor(value * 1000) AS BIGINT) AS b FROM events)
SELECT p.event_id, string_agg(CAST(n.event_id AS VARCHAR), ',' ORDER BY n.a, n.event_id) AS note_ids FROM e p JOIN e n ON p.user_id = n.user_id
WHERE p.event_type = 'purchase' AND n.event_type = 'error' AND (abs(p.a - n.a) <= 36000000 OR abs(p.b - n.a) <= 36000000) GROUP BY p.event_id"""
)
def timeline_hints(spark, d):
    e = intervals(read(spark, d, "events"))
    atoms = e.where("event_type = 'purchase'").select(F.col("event_id").alias("atom_id"), F.col("user_id").alias("item_key"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
    notes = e.where("event_type = 'error'").select(F.col("event_id").alias("note_id"), F.col("user_id").alias("item_key"), F.col("a").alias("anchor_ms"), F.lit("").alias("title"))
    out = context.timeline_hints(atoms, notes, reach=36_000_000)
    return out.select(F.col("atom_id").alias("event_id"), F.array_join(F.col("note_ids").cast("array<string>"), ",").alias("note_ids"))


@query("SELECT h.conv_id, h.turn, a.turn AS neighbour, length(a.text) AS chars FROM conversations h JOIN conversations a ON h.conv_id = a.conv_id AND a.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.role = 'user'")
def neighbor_index(spark, d):
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("item_key"), F.col("turn").alias("doc_index"), "role", "text")
    hit = turns.where("role = 'user'").select(F.concat_ws(":", "item_key", "doc_index").alias("hit_id"), "item_key", "doc_index")
    out = context.neighbours_by_index(hit, turns)
    return out.select(F.col("item_key").alias("conv_id"), F.col("doc_index").alias("turn"), F.col("neighbour_index").alias("neighbour"), F.length("neighbour_text").cast("long").alias("chars"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS a, epoch_ms(ts) + CAST(floor(value * 1000) AS BIGINT) AS b FROM events)
SELECT event_id, near_id, nth FROM (SELECT h.event_id, c.event_id AS near_id, row_number() OVER (PARTITION BY h.event_id ORDER BY least(abs(c.a - h.a), abs(c.b - h.a)), c.a, c.event_id) AS nth
FROM e h JOIN e c ON h.user_id = c.user_id WHERE h.event_type = 'purchase' AND c.event_type = 'click' AND c.a <= h.a + 36000000 AND c.b >= h.a - 36000000 AND least(abs(c.a - h.a), abs(c.b - h.a)) <= 36000000) WHERE nth <= 4"""
)
def neighbor_time_top4(spark, d):
    e = intervals(read(spark, d, "events"))
    hit = e.where("event_type = 'purchase'").select(F.col("event_id").alias("hit_id"), F.col("user_id").alias("item_key"), F.col("a").alias("anchor_ms"))
    atoms = e.where("event_type = 'click'").select(F.col("event_id").alias("atom_id"), F.col("user_id").alias("item_key"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
    out = context.neighbours_by_time(hit, atoms, reach=36_000_000)
    return out.select(F.col("hit_id").alias("event_id"), F.col("atom_id").alias("near_id"), F.col("nth").cast("long").alias("nth"))


@query(
    """SELECT c.conv_id, t.turn FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE turn < 8) t
ON c.conv_id = t.conv_id WHERE nth <= 6"""
)
def neighbor_by_ids(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("doc_id"))
    wanted = turns.select("conv_id").distinct().select(F.col("conv_id").alias("hit_id"), F.transform(F.sequence(F.lit(9), F.lit(0), F.lit(-1)), lambda t: F.struct(F.col("conv_id").alias("conv_id"), t.cast("long").alias("turn"))).alias("ids"))
    wanted = wanted.select("hit_id", F.reverse("ids").alias("atom_ids"))
    return context.neighbours_by_ids(wanted, turns.drop("conv_id", "turn")).select(F.col("doc_id.conv_id").alias("conv_id"), F.col("doc_id.turn").alias("turn"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE upper(source) END, ''), source) AS source FROM documents")
def display_merge(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    files = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.upper("source")).alias("source"))
    return context.display_merge(docs, files, ["source"], key="doc_id")


# Aggregates, reports and queues.


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def grouped_status_counts(spark, d):
    return stats.grouped_counts(read(spark, d, "events"), "event_type")


@query("SELECT event_type, round(coalesce(sum(value), 0) / 3600.0, 2) AS hours FROM events GROUP BY event_type")
def sum_hours(spark, d):
    return stats.hours(read(spark, d, "events"), "value", "event_type")


@query("SELECT trim(lang) AS lang, count(*) AS n FROM documents WHERE trim(lang) <> '' GROUP BY 1")
def category_counts(spark, d):
    return stats.trimmed_counts(read(spark, d, "documents"), "lang")


@query("SELECT name, count(*) AS n FROM (SELECT trim(unnest([role, ' ' || role || CAST(turn % 3 AS VARCHAR)])) AS name FROM conversations) GROUP BY name")
def participant_counts(spark, d):
    turns = read(spark, d, "conversations")
    return stats.member_counts(turns, F.array("role", F.concat(F.lit(" "), "role", (F.col("turn") % 3).cast("string"))))


@query(
    """SELECT count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'click')) AS download_done, count(*) FILTER (event_type IN ('view', 'error')) AS download_remaining,
round(100.0 * count(*) FILTER (event_type IN ('purchase', 'click')) / count(*), 2) AS download_percent, count(*) FILTER (value > 50) AS transcript_done,
count(*) FILTER (value <= 50) AS transcript_remaining, round(100.0 * count(*) FILTER (value > 50) / count(*), 2) AS transcript_percent FROM events"""
)
def progress_report(spark, d):
    status = F.when(F.col("event_type") == "purchase", "downloaded").when(F.col("event_type") == "click", "unsupported").when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "error")
    jobs = read(spark, d, "events").select(status.alias("status"), F.when(F.col("value") > 50, "completed").otherwise("pending").alias("transcript_status"))
    return stats.pipeline_report(jobs)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10")
def pipeline_failures_topn(spark, d):
    return merges.by_priority(read(spark, d, "events").where("event_type = 'error'"), F.desc("ts"), F.asc("event_id"), limit=10).select("event_id", "user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, d):
    return merges.latest(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT doc_id, count(*) OVER (PARTITION BY source) AS frequency FROM documents")
def item_multi_hit(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    # Counts are joined, not windowed: a hot item never stands in one task.
    return docs.join(docs.groupBy("source").agg(F.count("*").alias("frequency")), "source").select("doc_id", "frequency")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def distinct_first(spark, d):
    # Equal texts meet by a hash instead of travelling whole; no text is not an empty one.
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(
    """SELECT source, lang, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (nth <= 8) AS first_ids
FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS nth FROM documents) GROUP BY source, lang"""
)
def documents_grouped(spark, d):
    # Counts are aggregated and the first rows ranked, so no group is ever collected whole.
    docs = read(spark, d, "documents").select("source", "lang", "doc_id")
    first = docs.withColumn("nth", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))).where("nth <= 8")
    named = first.groupBy("source", "lang").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first_ids"))
    return stats.grouped_counts(docs, "source", "lang").join(named, ["source", "lang"])


@query(
    """SELECT doc_id, md5(replace(replace(text, 'tion', 'XX'), 'the', 'YYYY')) AS digest, CAST((length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS a,
CAST((length(replace(text, 'tion', 'XX')) - length(replace(replace(text, 'tion', 'XX'), 'the', ''))) / 3 AS BIGINT) AS b FROM documents"""
)
def alias_replace(spark, d):
    out, counts = text.replace_aliases(F.col("text"), {"tion": "XX", "the": "YYYY"})
    return texts(spark, d).select("doc_id", F.md5(out).alias("digest"), counts["tion->XX"].cast("long").alias("a"), counts["the->YYYY"].cast("long").alias("b"))


@query(f"SELECT doc_id, md5({_CLEAN}) AS digest FROM documents")
def normalize_ws(spark, d):
    return texts(spark, d).select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


@query("SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]{2,23}')) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 50")
def hotwords_top(spark, d):
    return stats.document_frequency(texts(spark, d), F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9]{2,23}"), F.lit(0)), 50)


@query(
    """SELECT item_id, n, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM (SELECT item_id, n, substring(w, i, n) AS g FROM (SELECT item_id, w, n, unnest(generate_series(1, length(w) - n + 1)) AS i
FROM (SELECT item_id, w, unnest([2, 3, 4]) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)) WHERE length(w) >= n)) GROUP BY item_id, n"""
)
def query_ngrams(spark, d):
    words = read(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    grams = words.select("item_id", F.explode(text.letter_grams(F.col("w"), (2, 3, 4))).alias("g"))
    return grams.groupBy("item_id", F.length("g").alias("n")).agg(F.count("*").alias("grams"), F.count_distinct("g").alias("distinct_grams"))


# Text shapes.


_UNITS = r"list_filter(string_split_regex(regexp_replace(text, '([!?;])', '\1' || chr(10), 'g'), '\s*\n\s*'), lambda u: trim(u, ' ' || chr(9) || chr(10) || chr(13)) <> '')"


@query(
    f"""SELECT doc_id, CASE WHEN len(u) = 0 THEN 0 ELSE r.done + CASE WHEN r.run > 0 THEN 1 ELSE 0 END END::BIGINT AS chunks FROM (SELECT doc_id, u, list_reduce(u, lambda a, x: CASE
WHEN x.run > 800 THEN {{'done': a.done + CASE WHEN a.run > 0 THEN 1 ELSE 0 END + (x.run + 799) // 800, 'run': 0::BIGINT}}
WHEN a.run = 0 THEN {{'done': a.done, 'run': x.run}} WHEN a.run + 1 + x.run <= 800 THEN {{'done': a.done, 'run': a.run + 1 + x.run}}
ELSE {{'done': a.done + 1, 'run': x.run}} END, {{'done': 0::BIGINT, 'run': 0::BIGINT}}) AS r
FROM (SELECT doc_id, list_transform({_UNITS}, lambda u: {{'done': 0::BIGINT, 'run': length(trim(u, ' ' || chr(9) || chr(10) || chr(13)))::BIGINT}}) AS u FROM documents))"""
)
def chunk_count(spark, d):
    return texts(spark, d).select("doc_id", F.size(text.text_chunks(F.col("text"))).cast("long").alias("chunks"))


@query("SELECT doc_id, i AS nth, trim(substring(text, i * 800 + 1, 800)) AS chunk FROM (SELECT doc_id, text, unnest(range((length(text) - 1) // 800 + 1)) AS i FROM documents) WHERE trim(substring(text, i * 800 + 1, 800)) <> ''")
def hard_wrap(spark, d):
    return texts(spark, d).select("doc_id", F.posexplode(text.hard_wrap(F.col("text"), 800)).alias("nth", "chunk")).select("doc_id", F.col("nth").cast("long").alias("nth"), "chunk")


@query(
    r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([!?;])', '\1' || chr(10), 'g'), '\s*\n\s*'), lambda u: trim(u, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS units FROM documents"""
)
def sentence_units(spark, d):
    return texts(spark, d).select("doc_id", F.size(text.sentence_units(F.col("text"))).cast("long").alias("units"))


def run_sql(of: str, n: int) -> str:
    """Whether a character stands n times in a row; DuckDB's patterns have no back references."""
    return f"len(list_filter(generate_series(1, length({of}) - {n - 1}), lambda i: substring({of}, i::INT, {n}) = repeat(substring({of}, i::INT, 1), {n}))) > 0"


@query(
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN c = '' THEN 'empty' END, CASE WHEN {run_sql('c', 12)} THEN 'repeated_chars' END, CASE WHEN length(c) < 20 THEN 'short' END,
CASE WHEN contains(c, repeat('哈', 14)) THEN 'laughter_run' END], lambda f: f IS NOT NULL), ',') AS flags FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)"""
)
def low_signal_flags(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(text.quality_flags(F.col("text")), ",").alias("flags"))


@query(
    rf"""SELECT doc_id, round(u, 6) AS unique_ratio, round(t, 6) AS token_ratio, CASE WHEN c = '' THEN 'empty' WHEN length(c) >= 180 AND u < 0.02 THEN 'low_unique_ratio' WHEN length(c) >= 180 AND {run_sql('c', 24)} THEN 'char_run'
WHEN n >= 40 AND t > 0.45 THEN 'token_ratio' END AS reason FROM (SELECT doc_id, c, len(list_distinct(string_split(c, ''))) / length(c) AS u, top / n AS t, n FROM (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS c FROM documents)
JOIN (SELECT doc_id, max(k)::DOUBLE AS top, sum(k)::DOUBLE AS n FROM (SELECT doc_id, t, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN\pM_]+')) AS t FROM documents) GROUP BY ALL) GROUP BY doc_id) USING (doc_id))"""
)
def repetition_check(spark, d):
    return texts(spark, d).select("doc_id", F.round(text.unique_char_ratio(F.col("text")), 6).alias("unique_ratio"), F.round(text.top_token_ratio(F.col("text")), 6).alias("token_ratio"), text.repetition_reason(F.col("text")).alias("reason"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN t >= 3600 THEN printf('%02d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%02d:%02d', t // 60, t % 60) END AS shown
FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS t FROM lineitem)"""
)
def format_ms(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.format_ms(F.floor("l_extendedprice") * 1000).alias("shown"))


@query(
    r"""SELECT page_id, url LIKE 'https://%' AS secure, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
coalesce(nullif(lower(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '[^/](\.[^./]{1,7})$', 1)), ''), '.mp3') AS extension FROM pages"""
)
def url_parts(spark, d):
    return read(spark, d, "pages").select(
        "page_id", F.startswith("url", F.lit("https://")).alias("secure"), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), text.guess_extension(F.col("url"), F.lit("audio_url"), F.lit("audio")).alias("extension")
    )


_MESSAGE = "CASE event_id % 5 WHEN 0 THEN 'Bad allocation at ' || user_id WHEN 1 THEN 'x: CUDA error 7' WHEN 2 THEN 'a/(''b'', 1.5, 2)' WHEN 3 THEN 'output did not contain text' ELSE event_type END"


@query(
    f"""SELECT event_id, CASE WHEN starts_with(m, 'bad allocation') THEN 'bad_allocation' WHEN contains(m, 'cuda error') THEN 'cuda_error' WHEN regexp_matches(m, '^[a-z]/\\(''.*'',\\s*[0-9.]+,\\s*[0-9.]+\\)$') THEN 'hallucinated_repeat_token'
WHEN contains(m, 'did not contain text') THEN 'empty_output' ELSE 'other' END AS category FROM (SELECT event_id, lower({_MESSAGE}) AS m FROM events)"""
)
def error_classify(spark, d):
    return read(spark, d, "events").withColumn("m", F.expr(_MESSAGE)).select("event_id", text.classify_error(F.col("m")).alias("category"))


@query(
    """SELECT event_id, CASE WHEN c = 0 THEN 0 WHEN c = 1 THEN 2 WHEN c = 2 THEN 1 WHEN s >= 3600 THEN 1 ELSE 3 END AS priority, CASE WHEN c = 0 OR c = 2 AND s >= 1800 OR c > 2 AND s >= 3600 THEN 'chunked' ELSE 'isolated' END AS strategy
FROM (SELECT event_id, event_id % 5 AS c, value * 60 AS s FROM events)"""
)
def rescue_plan(spark, d):
    events = read(spark, d, "events").withColumn("m", F.expr(_MESSAGE))
    plan = text.rescue_plan(text.classify_error(F.col("m")), F.col("value") * 60)
    return events.select("event_id", plan["priority"].alias("priority"), plan["strategy"].alias("strategy"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'audio_url' WHEN p_size % 4 = 1 THEN NULL WHEN p_size % 8 = 2 THEN 'original_src' WHEN p_size % 4 = 2 THEN 'playlist_url' END AS access_mode FROM part"""
)
def media_source_case(spark, d):
    size, none = F.col("p_size"), F.lit(None).cast("string")
    audio = F.when(size % 4 == 0, F.col("p_name"))
    source = text.media_source(audio, F.when(size % 4 == 1, "protected_audio").otherwise("audio"), none, none, none, F.when(size % 8 == 2, F.col("p_name")), F.when(size % 4 == 2, F.col("p_name")))
    return read(spark, d, "part").select("p_partkey", source["access_mode"].alias("access_mode"))


@query(
    r"""WITH p AS (SELECT doc_id, idx, sum(w) AS w FROM (SELECT doc_id, CAST(('0x' || substring(h, 1, 8))::BIGINT % 256 AS INT) AS idx,
CASE WHEN ('0x' || substring(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE * (1 + ('0x' || substring(h, 11, 2))::BIGINT / 255.0::DOUBLE) AS w
FROM (SELECT doc_id, sha256(unnest(regexp_extract_all(text, '[A-Za-z0-9_:+./-]+|[\x{4e00}-\x{9fff}]'))) AS h FROM documents)) GROUP BY doc_id, idx)
SELECT doc_id, idx, round((w / sqrt(n))::FLOAT::DOUBLE, 6) AS w FROM p JOIN (SELECT doc_id, sum(w * w) AS n FROM p GROUP BY doc_id) USING (doc_id) WHERE n > 0 AND abs(w) > 1e-9"""
)
def hash_embed(spark, d):
    vectors = embed.hash_embed(texts(spark, d), 256)
    return vectors.select("doc_id", F.posexplode("embedding").alias("idx", "w")).where(F.abs("w") > 1e-9).select("doc_id", "idx", F.round(F.col("w").cast("double"), 6).alias("w"))


# Transcripts.


def spoken(turns: DataFrame) -> DataFrame:
    """Conversations as timed segments: 40 ms a letter, one after the other; a conversation is one item."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.length("text") * 40).over(w)
    s = turns.select("conv_id", F.struct((end - F.length("text") * 40).alias("start_ms"), end.alias("end_ms"), "text", F.col("role").alias("speaker_id")).alias("s"))
    return s.groupBy(F.col("conv_id").alias("item_key")).agg(F.array_sort(F.collect_list("s")).alias("segments"))


_SPOKEN = "SELECT conv_id, turn, text, role, (sum(length(text)) OVER w - length(text)) * 40 AS a, sum(length(text)) OVER w * 40 AS b, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"


#: Turns with the atom that each belongs to, by the same rules walked turn by turn.
_WALK = f"""WITH RECURSIVE s AS MATERIALIZED ({_SPOKEN}),
walk AS (SELECT conv_id, rn, 0 AS idx, a AS first, a, b, role, b - a >= 30000 AS closed FROM s WHERE rn = 1
UNION ALL SELECT n.conv_id, n.rn, w.idx + CASE WHEN cut THEN 1 ELSE 0 END, CASE WHEN cut THEN n.a ELSE w.first END, n.a, n.b, n.role, n.b - CASE WHEN cut THEN n.a ELSE w.first END >= 30000
FROM walk w JOIN s n ON n.conv_id = w.conv_id AND n.rn = w.rn + 1, LATERAL (SELECT w.closed OR n.b - w.first > 25000 AND w.b - w.first >= 12000 OR w.role <> n.role AND w.role <> '' AND n.role <> '' AND w.b - w.first >= 12000 AS cut)),
atoms AS (SELECT conv_id, idx, min(a)::BIGINT AS a, max(b)::BIGINT AS b, count(*) AS n FROM walk GROUP BY conv_id, idx)"""


@query(f"{_WALK} SELECT conv_id AS item_key, idx AS doc_index, a AS start_ms, b AS end_ms, n AS n_segments FROM atoms")
def atoms_fold(spark, d):
    return segments.atom_rows(spoken(read(spark, d, "conversations"))).select("item_key", "doc_index", "start_ms", "end_ms", F.col("n_segments").cast("long").alias("n_segments"))


_GROUP = "STRUCT(s BIGINT, e BIGINT, ids BIGINT[])"
_BEGIN = "CASE WHEN len(a.g.ids) = 0 THEN x.g.s ELSE a.g.s END"


@query(
    f"""{_WALK}, listed AS (SELECT conv_id, list({{'done': []::{_GROUP}[], 'g': {{'s': a, 'e': b, 'ids': [idx::BIGINT]}}}} ORDER BY idx) AS steps, list(idx::BIGINT ORDER BY idx) AS every FROM atoms GROUP BY conv_id),
folded AS (SELECT conv_id, every, list_reduce(steps, lambda a, x: CASE WHEN len(a.g.ids) >= 7 OR x.g.e - {_BEGIN} >= 180000
    THEN {{'done': list_append(a.done, {{'s': {_BEGIN}, 'e': x.g.e, 'ids': list_concat(a.g.ids, x.g.ids)}}), 'g': {{'s': 0::BIGINT, 'e': 0::BIGINT, 'ids': []::BIGINT[]}}}}
    ELSE {{'done': a.done, 'g': {{'s': {_BEGIN}, 'e': x.g.e, 'ids': list_concat(a.g.ids, x.g.ids)}}}} END, {{'done': []::{_GROUP}[], 'g': {{'s': 0::BIGINT, 'e': 0::BIGINT, 'ids': []::BIGINT[]}}}}) AS r FROM listed),
closed AS (SELECT conv_id, every, CASE WHEN len(r.g.ids) = 0 THEN r.done WHEN len(r.done) > 0 AND len(r.g.ids) < 4
    THEN list_append(r.done[1:len(r.done) - 1], {{'s': r.done[-1].s, 'e': r.g.e, 'ids': list_concat(r.done[-1].ids, r.g.ids)}}) ELSE list_append(r.done, r.g) END AS groups FROM folded),
merged AS (SELECT conv_id, every, list_reduce(list_transform(groups, lambda g: [g]), lambda a, x: CASE WHEN len(a) > 0 AND x[1].e - x[1].s < 45000 AND x[1].e - a[-1].s <= 300000
    THEN list_append(a[1:len(a) - 1], {{'s': a[-1].s, 'e': x[1].e, 'ids': list_concat(a[-1].ids, x[1].ids)}}) ELSE list_append(a, x[1]) END, []::{_GROUP}[]) AS m FROM closed),
chosen AS (SELECT conv_id, CASE WHEN len(list_filter(m, lambda g: g.e - g.s > 300000)) = 0 AND len(list_filter(m[2:len(m) - 1], lambda g: g.e - g.s < 45000)) = 0 THEN list_transform(m, lambda g: g.ids) ELSE [every] END AS c FROM merged)
SELECT conv_id AS item_key, i - 1 AS scene, array_to_string(c[i], ',') AS ids FROM (SELECT conv_id, c, unnest(generate_series(1, len(c))) AS i FROM chosen)"""
)
def scene_groups(spark, d):
    atoms = segments.atom_rows(spoken(read(spark, d, "conversations"))).groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_index").alias("idx"), "start_ms", "end_ms"))).alias("atoms"))
    return atoms.select("item_key", F.posexplode(segments.fallback_scenes(F.col("atoms"))).alias("scene", "ids")).select("item_key", F.col("scene").cast("long").alias("scene"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT source, s AS start, least(s + 14, n) AS stop FROM (SELECT source, n, unnest(generate_series(0, n - 1, 11)) AS s FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) WHERE s = 0 OR s + 3 < n")
def sliding_windows(spark, d):
    n = read(spark, d, "documents").groupBy("source").agg(F.count("*").cast("int").alias("n"))
    return n.select("source", F.explode(segments.windows(F.col("n"))).alias("w")).select("source", F.col("w.start").cast("long").alias("start"), F.col("w.stop").cast("long").alias("stop"))


@query(
    """WITH v AS (SELECT user_id, hour(ts) AS boundary, count(*) AS votes FROM events GROUP BY ALL), m AS (SELECT user_id, max(votes) AS m FROM v GROUP BY user_id)
SELECT user_id, boundary, votes FROM v JOIN m USING (user_id) WHERE votes >= 2 OR m < 2"""
)
def boundary_votes(spark, d):
    votes = read(spark, d, "events").select(F.col("user_id").alias("item_key"), F.hour("ts").cast("long").alias("boundary"))
    return segments.boundary_votes(votes, F.lit(2)).withColumnRenamed("item_key", "user_id")


# Merges and increments.

_OLD_NEW = """SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.price, o.price) AS price, CASE WHEN n.o_orderkey IS NULL THEN o.state ELSE coalesce(o.state, 'pending') END AS state
FROM (SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 <> 0) o"""


@query(_OLD_NEW + " FULL JOIN (SELECT o_orderkey, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 2 = 0) n ON o.o_orderkey = n.o_orderkey")
def upsert_merge(spark, d):
    orders = read(spark, d, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"))
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"), F.lit("pending").alias("state"))
    return merges.upsert(old, merges.merge_keeping(old, new, ["o_orderkey"], ["state"]), ["o_orderkey"])


@query(
    """SELECT n.o_orderkey, n.o_totalprice + 1 AS price, CASE WHEN n.o_orderkey % 3 <> 0 THEN n.o_orderstatus ELSE 'pending' END AS state FROM orders n WHERE n.o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)"""
)
def snapshot_replace(spark, d):
    orders = read(spark, d, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"))
    new = orders.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey", (F.col("o_totalprice") + 1).alias("price"), F.lit("pending").alias("state"))
    return merges.merge_keeping(old, new, ["o_custkey", "o_orderkey"], ["state"], scope=["o_custkey"]).drop("o_custkey")


@query("SELECT doc_id, lang, source FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, 'de2', source FROM documents WHERE lang = 'de' AND doc_id % 2 = 0")
def replace_documents(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    scope = docs.where("lang = 'de'").select("lang").distinct()
    new = docs.where("lang = 'de' AND doc_id % 2 = 0").withColumn("lang", F.lit("de2"))
    return merges.replace_scope(docs, new, scope, ["lang"])


_SEEN = "event_id % 10 < 7 AND ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events)"
MARK = f"SELECT max(ts) FROM events WHERE {_SEEN}"


def seen_events(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    cut = events.agg((F.max("ts") - F.expr("interval 1 day")).alias("cut")).first()["cut"]
    return events.where((F.col("event_id") % 10 < 7) & (F.col("ts") < F.lit(cut)))


def mark_of(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """The mark that the seen events leave, and the ids that share it."""
    row = incremental.next_mark(seen_events(spark, d), "ts", "event_id").first()
    return str(row["mark"]), row["ties"]


@query(f"SELECT event_id, user_id FROM events WHERE ts > ({MARK}) OR ts = ({MARK}) AND NOT ({_SEEN})")
def incremental_since(spark, d):
    return incremental.since(read(spark, d, "events"), "ts", "event_id", *mark_of(spark, d)).select("event_id", "user_id")


@query(ORACLES["incremental_since"])
def stream_incremental(spark, d):
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    mark, schema = mark_of(spark, d), read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    new = incremental.since(stream, "ts", "event_id", *mark).select("event_id", "user_id")
    new.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(f"{at}/rows")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1 AND n_chars % 2 = 0")
def signature_skip(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.concat_ws(":", "doc_id", "n_chars")).alias("signature"))
    seen = read(spark, d, "documents").where("doc_id % 4 <> 0").select("doc_id", F.md5(F.concat_ws(":", "doc_id", F.when((F.col("doc_id") % 4 == 1) & (F.col("n_chars") % 2 == 0), 0).otherwise(F.col("n_chars")))).alias("signature"))
    return incremental.changed(docs, seen, ["doc_id"]).select("doc_id")


@query("SELECT c_custkey, o.last FROM customer JOIN (SELECT o_custkey, max(o_orderdate)::DATE::VARCHAR AS last FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey % 7 = 0 OR o.last > '1998-01-01'")
def index_candidates(spark, d):
    items = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_key"), F.lit("1990-01-01").alias("updated_at"))
    transcripts = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("item_key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    titled = items.where("cast(item_key as long) % 7 <> 0")
    out = merges.index_candidates(items, transcripts, titled, since="1998-01-01")
    return out.select(F.col("item_key").cast("long").alias("c_custkey"), F.col("transcript_updated_at").alias("last"))


@query("SELECT o_orderkey % 50 AS job, count(*) + 1 AS attempts FROM orders WHERE o_orderkey % 50 < 25 GROUP BY 1 UNION ALL SELECT k, 1 FROM (SELECT unnest(range(50, 55)) AS k)")
def enrichment_attempts(spark, d):
    old = read(spark, d, "orders").where("o_orderkey % 50 < 25").groupBy((F.col("o_orderkey") % 50).alias("job_key")).agg(F.count("*").alias("attempt_count")).withColumn("status", F.lit("error"))
    started = old.select("job_key").unionByName(spark.range(50, 55).select(F.col("id").alias("job_key")))
    return merges.bump_attempts(old, started).select(F.col("job_key").alias("job"), F.col("attempt_count").alias("attempts"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unsupported' ELSE 'downloaded' END AS status, CASE WHEN event_id % 3 = 0 AND event_type IN ('click', 'view') AND value > 50 THEN 'skipped' WHEN value > 50 THEN 'pending' ELSE 'completed' END AS transcript_status FROM events"""
)
def job_state_machine(spark, d):
    media = F.when(F.col("event_type").isin("click", "view"), "audio").otherwise("image")
    jobs = read(spark, d, "events").select(F.col("event_id").alias("job_id"), media.alias("media_type"), F.lit("downloaded").alias("status"), F.lit(None).cast("string").alias("error"), F.when(F.col("value") > 50, "pending").otherwise("completed").alias("transcript_status"), F.lit(None).cast("string").alias("transcript_error"))
    failed = jobs.where("job_id % 3 = 0").select("job_id", F.lit("unsupported").alias("status"), F.lit("no audio").alias("error"))
    return merges.download_failed(jobs, failed).select(F.col("job_id").alias("event_id"), "status", "transcript_status")


@query(
    """SELECT count(*) AS documents, count(DISTINCT source) AS items, count(DISTINCT lang) AS categories, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents"""
)
def ui_meta_snapshot(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("items"), F.count_distinct("lang").alias("categories"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("SELECT c, a, b FROM (SELECT p_partkey AS c, unnest(generate_series(0, p_size * 60 - 1, 57)) AS a, p_size * 60 AS t, least(a + 60, t) AS b FROM part) WHERE a = 0 OR a + 3 < t")
def chunk_windows(spark, d):
    n = read(spark, d, "part").select(F.col("p_partkey").alias("c"), (F.col("p_size") * 60).alias("n"))
    return n.select("c", F.explode(segments.windows(F.col("n"), 60, 3)).alias("w")).select("c", F.col("w.start").cast("long").alias("a"), F.col("w.stop").cast("long").alias("b"))
