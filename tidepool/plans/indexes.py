"""Queries over indexes and tables that change in place, by name with their SQL twins; they join the catalogue's."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.functions.embed import HashProvider
from tidepool.operators import gram_index, records, retrieval, stats
from tidepool.plans import writing
from tidepool.plans.catalogue import TERMS, query, read, score_sql, texts
from tidepool.plans.collection import Collection
from tidepool.plans.config import IndexConfig
from tidepool.plans.upkeep import folder
from tidepool.sources import library, readers
from tidepool.sources.points import PointTable
from tidepool.streaming import audit

# Vectors beside what searches filter by.

_PAYLOAD = "SELECT vec_id, embedding, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS collection_name, vec_id % 10 AS item, label, vec_id % 3 AS category, vec_id % 7 AS person FROM embeddings"
_COSINE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as points of two collections: label is the type, and remainders of the number stand for the rest."""
    n = F.col("vec_id")
    return read(spark, d, "embeddings").select(
        F.when(n % 2 == 0, "a").otherwise("b").alias("collection_name"), n.alias("doc_id"), (n % 10).cast("string").alias("item_key"), F.col("label").cast("string").alias("doc_type"), (n % 3).cast("string").alias("category"),
        F.array(F.lit("everyone"), (n % 7).cast("string")).alias("users"), "embedding",
    )


def probe(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


SCOPES = {
    "collection": {"collection": "a"},
    "type": {"collection": "a", "doc_types": ["1", "3"]},
    "narrow": {"collection": "b", "doc_types": ["0", "2"], "categories": ["0", "2"], "participants": ["everyone", "3"]},
}


@query(
    f"""SELECT e.vec_id, label::VARCHAR AS doc_type, round({_COSINE}, 5) AS score FROM ({_PAYLOAD}) e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE collection_name = 'a' AND label IN (1, 3) AND category IN (0, 2) AND person IN (2, 3) ORDER BY {_COSINE} DESC, e.vec_id LIMIT 10"""
)
def vector_payload_topk(spark, d):
    """The exact top-k under filters on collection, type, category and participants, by a point table."""
    table = PointTable.create(points(spark, d).withColumn("users", F.when(F.element_at("users", 2).isin("2", "3"), F.array(F.lit("x"), F.lit("y"))).otherwise(F.col("users"))), folder(spark))
    found = table.search(probe(spark, d), 10, collection="a", doc_types=["1", "3"], categories=["0", "2"], participants=["x", "y"])
    return found.select(F.col("doc_id").alias("vec_id"), "doc_type", F.round("score", 5).alias("score"))


@query(
    f"""WITH p AS ({_PAYLOAD}) SELECT scope, n AS queries, true AS enough, rows FROM (SELECT count(*) AS n FROM embeddings WHERE vec_id % 50 = 0),
(SELECT 'collection' AS scope, count(*) AS rows FROM p WHERE collection_name = 'a' UNION ALL SELECT 'type', count(*) FROM p WHERE collection_name = 'a' AND label IN (1, 3)
UNION ALL SELECT 'narrow', count(*) FROM p WHERE collection_name = 'b' AND label IN (0, 2) AND category IN (0, 2) AND person = 3)"""
)
def vector_filtered_ann(spark, d):
    """Recall of approximate searches under three filters against brute force, for every 50th vector, with probes set without a filter."""
    asked = read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    table = PointTable.create(points(spark, d), folder(spark)).tuned(asked, 5, 0.95)
    out = [(name, asked.count(), table.recall(asked, 5, table.probes, **scope) >= 0.9, table.rows(**scope).count()) for name, scope in SCOPES.items()]
    return spark.createDataFrame(out, "scope string, queries long, enough boolean, rows long")


@query(
    f"""SELECT collection_name, vec_id, CASE WHEN item = 4 AND collection_name = 'a' THEN 'turned' ELSE 'old' END AS state FROM ({_PAYLOAD})
WHERE NOT (collection_name = 'a' AND item = 6) AND NOT (collection_name = 'b' AND item = 3 AND label = 1)"""
)
def vector_upserts(spark, d):
    """Items replaced, dropped, and replaced in some types only; only the cells they touch are written."""
    rows = points(spark, d)
    table = PointTable.create(rows, folder(spark))
    turned = rows.where("collection_name = 'a' AND item_key = '4'").withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("text_key", F.lit("turned"))
    table.upsert(turned)
    table.replace(rows.limit(0), rows.where("collection_name = 'a' AND item_key = '6'"))
    table.replace(rows.limit(0), rows.where("collection_name = 'b' AND item_key = '3'"), ["1"])
    return table.rows().select("collection_name", F.col("doc_id").alias("vec_id"), F.coalesce("text_key", F.lit("old")).alias("state"))


_SYNCED = "SELECT doc_id, CASE WHEN doc_id % 97 = 3 THEN 'the price ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 97 <> 5"


@query(
    f"""WITH s AS (SELECT doc_id, {score_sql()} AS score FROM ({_SYNCED})), top AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)
SELECT 'lexical' AS part, doc_id, score::BIGINT AS n FROM top UNION ALL SELECT 'points', -1, count(*) FROM s UNION ALL SELECT 'documents', -1, count(*) FROM s
UNION ALL SELECT 'embedded', 1, count(*) FROM documents WHERE doc_id % 97 = 3 UNION ALL SELECT 'embedded', 2, 0"""
)
def collection_syncs(spark, d):
    """An index of documents after two syncs: one item gets new texts, one stays, one goes; texts that were embedded before aren't again."""
    docs = texts(spark, d).select(F.lit("c").alias("collection_name"), "doc_id", (F.col("doc_id") % 97).cast("string").alias("item_key"), F.lit("evidence_atom").alias("doc_type"), F.col("text").alias("text_raw"), F.col("text").alias("vector_text"))
    index = Collection.create(docs, folder(spark), lambda: HashProvider(64), part_docs=300)
    new = docs.where("item_key IN ('3', '13')")
    for c in ("text_raw", "vector_text"):
        new = new.withColumn(c, F.when(F.col("item_key") == "3", F.concat(F.lit("the price "), F.coalesce(c, F.lit("")))).otherwise(F.col(c)))
    one = index.sync(new, new.select("collection_name", "item_key"))
    two = index.sync(new.where("item_key = '3'"), docs.where("item_key IN ('3', '5')").select("collection_name", "item_key"))
    found = gram_index.indexed_topk(index.documents(), index.postings(), TERMS, 50, text="text_raw", order=("doc_id",))
    counts = [("points", -1, index.points().rows(collection="c").count()), ("documents", -1, index.documents().count()), ("embedded", 1, one.embedded), ("embedded", 2, two.embedded)]
    return found.select(F.lit("lexical").alias("part"), "doc_id", F.col("lexical_score").cast("long").alias("n")).unionByName(spark.createDataFrame(counts, "part string, doc_id long, n long"))


# A catalogue's items with their jobs and chunks.


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 5 = 0 AS hit FROM orders)
SELECT 'item' AS kind, c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'old' END AS value FROM customer
UNION ALL SELECT 'job', k, CASE WHEN hit THEN 'new ' ELSE 'old ' END || CASE WHEN k % 2 = 0 THEN 'downloaded' ELSE 'pending' END FROM o WHERE NOT (hit AND k % 3 = 0)
UNION ALL SELECT 'job', -k - 1, 'new pending' FROM o WHERE hit AND k % 11 = 0
UNION ALL SELECT 'chunk', k, CASE WHEN hit AND k % 2 = 1 THEN 'new' ELSE 'old' END FROM o WHERE NOT (hit AND k % 2 = 1 AND k % 7 <> 0)"""
)
def library_snapshot(spark, d):
    """Customers as items, their orders as jobs and as chunks: a snapshot of every fifth item replaces all three in one write.

    Every third order of theirs is gone as a job, every eleventh comes as a new one; content chunks (odd orders) shrink to a
    seventh, transcript chunks stay; jobs that are still there keep their state.
    """
    items = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_key"), F.lit("old").alias("title"))
    orders = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("item_key"), F.col("o_orderkey").alias("k"))
    jobs = orders.select("item_key", F.col("k").cast("string").alias("job_id"), F.lit("old").alias("media_title"), F.when(F.col("k") % 2 == 0, "downloaded").otherwise("pending").alias("status"))
    chunks = orders.select("item_key", F.col("k").cast("string").alias("chunk_id"), F.when(F.col("k") % 2 == 1, "content").otherwise("transcript").alias("source"), F.lit("old").alias("text"))
    held = library.Library.create(items, jobs, chunks, folder(spark), ("status",), bucket_items=400)
    hit = F.col("item_key").cast("long") % 5 == 0
    fresh = jobs.where(hit).withColumn("media_title", F.lit("new")).withColumn("status", F.lit("pending"))
    more = fresh.where(F.col("job_id").cast("long") % 11 == 0).withColumn("job_id", (-F.col("job_id").cast("long") - 1).cast("string"))
    new_chunks = chunks.where(hit & (F.col("source") == "content") & (F.col("chunk_id").cast("long") % 7 == 0)).withColumn("text", F.lit("new"))
    held.replace(items.where(hit).withColumn("title", F.lit("new")), fresh.where(F.col("job_id").cast("long") % 3 != 0).unionByName(more), new_chunks)
    rows = held.items().select(F.lit("item").alias("kind"), F.col("item_key").alias("key"), F.col("title").alias("value"))
    rows = rows.unionByName(held.jobs().select(F.lit("job").alias("kind"), F.col("job_id").alias("key"), F.concat_ws(" ", "media_title", "status").alias("value")))
    rows = rows.unionByName(held.chunks().select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), F.col("text").alias("value")))
    return rows.withColumn("key", F.col("key").cast("long"))


# A writer's answers.


class Told:
    """A writer that tells a text's first letters and its length, and fails on every third length."""

    def complete(self, prompt: str) -> str:
        text = prompt.split("\n\n", 2)[2]
        if len(text) % 3 == 0:
            raise TimeoutError("no answer in time")
        return "Sure: " + json.dumps({"scene_title": text[:12], "summary": str(len(text))}, ensure_ascii=False)


_TRIMMED = "regexp_replace(regexp_replace(text, '^ +', ''), ' +$', '')"


@query(
    f"""WITH d AS (SELECT doc_id, source, text, length(text) % 3 <> 0 AS told FROM documents WHERE text IS NOT NULL)
SELECT 'scene' AS part, doc_id, CASE WHEN told AND trim(text[1:12]) <> '' THEN trim(text[1:12]) WHEN told THEN '片段 1' WHEN {_TRIMMED} <> '' THEN {_TRIMMED}[1:18] ELSE source || '片段' END AS title, CASE WHEN told THEN length(text)::VARCHAR ELSE {_TRIMMED}[1:280] END AS summary FROM d
UNION ALL SELECT 'asked', 1, count(DISTINCT source || chr(10) || text)::VARCHAR, NULL FROM d UNION ALL SELECT 'asked', 2, count(DISTINCT source || chr(10) || text)::VARCHAR, NULL FROM d WHERE NOT told"""
)
def writer_summaries(spark, d):
    """Documents as scenes, summarised by a writer that sometimes fails; a second run asks for what failed and nothing else."""
    none = F.array().cast("array<string>")
    rows = texts(spark, d).where("text is not null").select("doc_id", F.lit(0).alias("scene"), F.col("source").alias("item_title"), "text", none.alias("note_titles"), none.alias("words"), none.alias("tags"))
    answers = writing.Answers(spark, folder(spark), Told)
    _, first = writing.scene_summaries(answers, rows)
    out, second = writing.scene_summaries(answers, rows)
    asked = spark.createDataFrame([("asked", 1, str(first), None), ("asked", 2, str(second), None)], "part string, doc_id long, title string, summary string")
    return out.select(F.lit("scene").alias("part"), "doc_id", F.col("summary.scene_title").alias("title"), F.col("summary.summary").alias("summary")).unionByName(asked)


# Words, options, logs, times.


@query(
    """WITH l AS (SELECT user_id AS job_id, event_id % 2 AS list, event_id AS nth, CASE WHEN event_id % 5 = 0 THEN '12' WHEN event_id % 2 = 1 THEN event_type || '  ' || event_id % 3 ELSE event_type END AS term FROM events),
f AS (SELECT job_id, regexp_replace(term, ' +', ' ') AS term, min({'list': list, 'nth': nth}) AS place FROM l WHERE term <> '12' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY place) AS r FROM f)
SELECT job_id, string_agg(term, ',' ORDER BY r) AS terms FROM r WHERE r <= 6 GROUP BY job_id"""
)
def hotword_merge(spark, d):
    """Two ranked lists of terms for each user, the first six terms of their union; numbers alone are no terms."""
    n, kind = F.col("event_id"), F.col("event_type")
    term = F.when(n % 5 == 0, "12").when(n % 2 == 1, F.concat(kind, F.lit("  "), (n % 3).cast("string"))).otherwise(kind)
    lists = read(spark, d, "events").select(F.col("user_id").alias("job_id"), (n % 2).alias("list"), n.alias("nth"), term.alias("term"))
    return records.merged_terms(lists, 6).select("job_id", F.array_join("terms", ",").alias("terms"))


@query(
    """SELECT row_number() OVER (ORDER BY name IN ('Brand#2', 'Brand#17') DESC, n DESC, name) AS nth, name, n, name IN ('Brand#2', 'Brand#17') AS selected
FROM (SELECT p_brand AS name, (count(*) % 4)::BIGINT AS n FROM part GROUP BY p_brand)"""
)
def filter_options(spark, d):
    """Brands as options of a filter, with counts that tie: the selected first, then by count, then by name."""
    counts = read(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg((F.count("*") % 4).alias("n"))
    listed = stats.filter_options(counts, ["Brand#2", "Brand#17"]).collect()  # as many as options
    return spark.createDataFrame([(k, r["name"], r["n"], r["selected"]) for k, r in enumerate(listed, 1)], "nth long, name string, n long, selected boolean")


@query("SELECT event_id % 3 AS batch, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def audit_replay(spark, d):
    """Events as audited queries in three batches, of which one is run twice."""
    rows = read(spark, d, "events")
    at = folder(spark)
    log = audit.append(at, most_bytes=1 << 40)
    for number in (0, 1, 1, 2):
        log(rows.where(F.col("event_id") % 3 == number).select(F.col("event_id").cast("string").alias("query"), F.col("user_id").cast("string").alias("client_ip"), F.lit("ok").alias("status")), number)
    return audit.entries(spark, at).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("client_ip").alias("users"))


@query("SELECT max(o_orderdate)::VARCHAR AS updated_at FROM orders")
def library_updated(spark, d):
    """When a library changed last, by the second key of the first report that is there."""
    at = folder(spark)
    last = read(spark, d, "orders").agg(F.max("o_orderdate").cast("string").alias("dataset_published_at"), F.lit(" ").alias("library_updated_at"))
    last.coalesce(1).write.json(f"{at}/written")
    text = spark.read.text(f"{at}/written").first()["value"]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{readers.UPDATED_FILES[0]}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(text, "utf-8"))
    out.close()
    return spark.createDataFrame([(readers.library_updated_at(spark, at),)], "updated_at string")


_FAULTS = ["HTTP 429 Too Many Requests", "Read timed out", "database is LOCKED", "CUDA error: out of memory", "bad allocation", "file not found", "Service Unavailable", "cublas failure"]


@query(
    f"""WITH m AS (SELECT event_id, [{', '.join(f"'{m}'" for m in _FAULTS)}][event_id % 9 + 1] AS m FROM events), l AS (SELECT event_id, coalesce(lower(m), '') AS m FROM m)
SELECT regexp_matches(m, '429|too many|timed out|unavailable') AS later, regexp_matches(m, '429|too many|timed out|unavailable|locked') AS later_or_busy, regexp_matches(m, 'cuda error|out of memory|cublas') AS fresh_runner, count(*) AS n FROM l GROUP BY ALL"""
)
def error_classes(spark, d):
    """Messages of events by whether a later try, another table state or a fresh runner may do better; some events have none."""
    listed = F.array(*[F.lit(m) for m in _FAULTS])
    rows = read(spark, d, "events").select(F.get(listed, (F.col("event_id") % 9).cast("int")).alias("m"))
    each = rows.select(text.may_pass(F.col("m")).alias("later"), text.may_pass(F.col("m"), busy=True).alias("later_or_busy"), text.is_recoverable(F.col("m")).alias("fresh_runner"))
    return each.groupBy("later", "later_or_busy", "fresh_runner").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS transcript_status, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus IS NOT NULL GROUP BY ALL")
def filtered_counts(spark, d):
    """Counts by two states of the jobs of one kind."""
    jobs = read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("transcript_status"), (F.col("o_custkey") % 3).alias("kind"))
    return stats.grouped_counts(jobs.where("kind = 0"), "status", "transcript_status")


@query("SELECT count(DISTINCT o_custkey) FILTER (o_custkey % 2 = 0 AND o_custkey % 5 <> 0) AS eligible, count(DISTINCT o_custkey) FILTER (o_custkey % 5 <> 0) AS with_others, (SELECT count(*) FROM customer) AS without_transcript FROM orders JOIN customer ON o_custkey = c_custkey")
def eligible_items(spark, d):
    """Customers as items, those with orders but for every fifth as items with transcripts: how many an index takes in by its settings."""
    items = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_key"), F.lit("2024-01-01").alias("updated_at"), F.lit("official").alias("owner_type"), (F.col("c_custkey") % 2 == 0).alias("option_is_official"))
    said = read(spark, d, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").cast("string").alias("item_key"), F.lit("2024-01-02").alias("updated_at"))
    count = lambda **settings: IndexConfig(**settings).count_eligible(items, said, items.limit(0).select("item_key"))
    row = (count(), count(eligible_only=False), count(eligible_only=False, require_transcript=False))
    return spark.createDataFrame([row], "eligible long, with_others long, without_transcript long")
