"""Builders of the five kinds of search documents, with one schema, from records and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import normalize
from tidepool.operators.segments import atom_rows, fallback_scenes

LEAD_MS, WINDOW_MS, SHORT_ATOM = 8_000, 12_000, 30


def envelope(rows: DataFrame, doc_type: str, suffix: Column, **columns: Column) -> DataFrame:
    none, no_ids = F.lit(None).cast("string"), F.array().cast("array<string>")
    made = {"title": none, "text_raw": none, "keyword_text": none, "vector_text": none, "start_ms": F.lit(None).cast("long"), "end_ms": F.lit(None).cast("long"), "doc_index": F.lit(0), "atom_ids": no_ids}
    made |= {"timeline_ms": F.lit(None).cast("long")} | dict.fromkeys(("summary", "timeline_content", "timeline_at", "asset_url", "quote_href"), none) | columns
    of_item = {"item_id": F.col("id"), "item_url": F.col("url"), "tags": F.col("tags")}
    return rows.select(
        F.concat_ws(":", "item_key", suffix).alias("doc_id"), F.lit(doc_type).alias("doc_type"), "item_key", F.col("item_title"), "category", "users", "published_at", *[c.alias(k) for k, c in (of_item | made).items()]
    )


def lines(*parts: Column) -> Column:
    """Distinct non-empty parts, one a line."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[normalize(p) for p in parts]), lambda p: p != "")), "\n")


def headed(records: DataFrame) -> DataFrame:
    return records.withColumn("item_title", F.col("title")).withColumn("users", F.transform("users", lambda u: u["nickname"]))


def title_documents(records: DataFrame) -> DataFrame:
    text = lines(F.col("title"), F.col("excerpt"), F.col("desc"), F.col("category"), F.array_join("tags", " "), F.array_join("users", " "))
    return envelope(headed(records), "item_title", F.lit("title:0000"), title=F.col("title"), text_raw=text, keyword_text=text, vector_text=text)


def note_documents(records: DataFrame) -> DataFrame:
    """A document for each timeline note; its interval leads by 8 s and follows by 12 s."""
    rows = headed(records).select("*", F.explode("media").alias("m")).select("*", F.posexplode("m.timelines").alias("nth", "t"))
    at = F.coalesce((F.col("t.at").try_cast("double") * 1000).cast("bigint"), F.lit(0))
    text = lines(F.col("t.title"), F.col("t.content"))
    return envelope(
        rows, "timeline_note", F.concat(F.lit("timeline:"), F.col("t.id")), title=F.col("t.title"), text_raw=text, keyword_text=text, vector_text=lines(F.col("item_title"), F.col("t.title"), F.col("t.content")),
        start_ms=F.greatest(F.lit(0), at - LEAD_MS).cast("long"), end_ms=at + WINDOW_MS, doc_index=F.col("nth"), timeline_ms=at,
        timeline_content=F.col("t.content"), timeline_at=F.col("t.at"), asset_url=F.col("t.asset_url"), quote_href=F.col("t.quote_href"),
    )


def atom_documents(records: DataFrame, transcripts: DataFrame) -> DataFrame:
    """transcripts: (item_key, segments). Short atoms carry the item's title in their vector text."""
    atoms = atom_rows(transcripts).withColumnRenamed("text", "atom_text")
    rows = headed(records).drop("doc_index", "start_ms", "end_ms").join(atoms, "item_key")
    text = normalize(F.col("atom_text"))
    vector = F.when(F.length(text) < SHORT_ATOM, lines(F.col("item_title"), text)).otherwise(text)
    return envelope(rows, "evidence_atom", F.format_string("atom:%04d", F.col("doc_index")), text_raw=text, keyword_text=text, vector_text=vector, start_ms=F.col("start_ms"), end_ms=F.col("end_ms"), doc_index=F.col("doc_index"))


def scene_documents(atoms: DataFrame) -> DataFrame:
    """Rule-based scenes over atom documents: the texts of up to eight atoms, and a summary of their first letters."""
    packed = atoms.withColumnsRenamed({"item_id": "id", "item_url": "url"}).groupBy("item_key", "item_title", "category", "users", "published_at", "id", "url", "tags").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_index").alias("idx"), "start_ms", "end_ms", "doc_id", "text_raw"))).alias("a"))
    groups = fallback_scenes(F.transform("a", lambda x: F.struct(x["idx"].alias("idx"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))))
    rows = packed.select("*", F.posexplode(groups).alias("scene", "ids")).withColumn("mine", F.filter("a", lambda x: F.array_contains("ids", x["idx"])))
    text = F.array_join(F.transform("mine", lambda x: x["text_raw"]), " ")
    return envelope(
        rows, "scene_summary", F.format_string("scene:%04d", F.col("scene")), title=F.substring(text, 1, 24), text_raw=text, keyword_text=text, vector_text=lines(F.col("item_title"), F.substring(text, 1, 280)),
        start_ms=F.array_min(F.transform("mine", lambda x: x["start_ms"])), end_ms=F.array_max(F.transform("mine", lambda x: x["end_ms"])), doc_index=F.col("scene"), atom_ids=F.transform("mine", lambda x: x["doc_id"]),
        summary=F.substring(text, 1, 280),
    )


def card_documents(records: DataFrame, scenes: DataFrame) -> DataFrame:
    """One card for each item that has scenes: its title, excerpt and its scenes' titles."""
    told = scenes.groupBy("item_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_index", "title"))), lambda s: s["title"]).alias("told"))
    rows = headed(records).join(told, "item_key")
    text = lines(F.col("title"), F.col("excerpt"), F.array_join("told", "，"))
    return envelope(rows, "episode_card", F.lit("episode:0000"), title=F.col("title"), text_raw=text, keyword_text=text, vector_text=F.substring(text, 1, 280), summary=F.substring(text, 1, 280))


def build_documents(records: DataFrame, transcripts: DataFrame) -> DataFrame:
    """All five kinds; items without a transcript have titles and notes only."""
    atoms = atom_documents(records, transcripts)
    scenes = scene_documents(atoms)
    parts = [title_documents(records), note_documents(records), atoms, scenes, card_documents(records, scenes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
