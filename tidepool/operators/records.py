"""Normalisation of API documents (data and included objects) to flat records, and media jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.terms import LONGEST_FRAGMENT, LONGEST_TERM, STOP_PARTS, STOP_TERMS
from tidepool.functions.text import guess_extension, media_source
from tidepool.functions.web import absolute_url, asset_url, entry_url

ATTRIBUTES = "map<string,string>"
REF = "struct<type:string,id:string>"
OBJECT = f"struct<type:string,id:string,attributes:{ATTRIBUTES},relationships:map<string,array<{REF}>>>"
#: An API document: relationships are read as lists of references, a single one being a list of one.
DOCUMENT = f"data {OBJECT}, included array<{OBJECT}>"


def parse_document(raw: Column) -> Column:
    """A JSON:API document as DOCUMENT; malformed input gives NULLs."""
    loose = "struct<data:struct<type:string,id:string,attributes:map<string,string>,relationships:map<string,string>>,included:array<struct<type:string,id:string,attributes:map<string,string>,relationships:map<string,string>>>>"

    def refs(value: Column) -> Column:
        data = F.get_json_object(value, "$.data")
        return F.when(F.startswith(data, F.lit("[")), F.from_json(data, f"array<{REF}>")).when(data.isNotNull(), F.array(F.from_json(data, REF)))

    def shaped(o: Column) -> Column:
        return F.struct(o["type"].alias("type"), o["id"].alias("id"), o["attributes"].alias("attributes"), F.transform_values(o["relationships"], lambda k, v: F.coalesce(refs(v), F.array().cast(f"array<{REF}>"))).alias("relationships"))

    doc = F.from_json(raw, loose)
    return F.struct(F.when(doc["data"].isNotNull(), shaped(doc["data"])).alias("data"), F.transform(F.coalesce(doc["included"], F.array().cast("array<struct<type:string,id:string,attributes:map<string,string>,relationships:map<string,string>>>")), shaped).alias("included"))


def related(owner: Column, included: Column, name: str) -> Column:
    """Included objects that a relationship names, in its order; missing ones are dropped."""
    refs = F.coalesce(F.try_element_at(owner["relationships"], F.lit(name)), F.array().cast(f"array<{REF}>"))
    hit = F.transform(refs, lambda r: F.get(F.filter(included, lambda o: (o["type"] == r["type"]) & (o["id"] == r["id"])), F.lit(0)))
    return F.filter(hit, lambda o: o.isNotNull())


def attribute(o: Column, name: str) -> Column:
    return F.try_element_at(o["attributes"], F.lit(name))


def rich_text(content: Column) -> Column:
    """Texts of the blocks of a rich-text JSON string, joined by newlines; empty for malformed input."""
    blocks = F.from_json(content, "struct<blocks:array<struct<text:string>>>")["blocks"]
    texts = F.filter(F.transform(blocks, lambda b: F.trim(F.coalesce(b["text"], F.lit("")))), lambda t: t != "")
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


@dataclass(frozen=True)
class Site:
    """Where a site's pages and assets are; without bases addresses stay as they are given."""

    base: str | None = None
    images: str | None = None
    audio: str | None = None
    kinds: tuple[str, ...] = ("articles", "radios", "videos", "albums", "talks", "topics", "games")
    official_flag: str = "is-official"


#: What providers answered for protected media, by medium; unknown until a connector has asked them.
RESOLVED = "struct<provider:string,m3u8:string,play_auth:string>"


def timelines(medium: Column, included: Column, site: Site = Site()) -> Column:
    made = F.transform(
        related(medium, included, "timelines"),
        lambda t: F.struct(
            F.coalesce(attribute(t, "at").try_cast("double").cast("bigint"), F.lit(0)).alias("order"), t["id"].alias("id"), attribute(t, "at").alias("at"), attribute(t, "title").alias("title"),
            attribute(t, "content").alias("content"), asset_url(attribute(t, "asset"), site.images).alias("asset_url"), attribute(t, "quote-href").alias("quote_href"), attribute(t, "comments-count").try_cast("bigint").alias("comments_count"),
        ),
    )
    return F.transform(F.array_sort(made, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)), lambda t: t.dropFields("order"))


def label(o: Column) -> Column:
    """An included object's name, or else its title."""
    given = lambda name: F.nullif(attribute(o, name), F.lit(""))
    return F.coalesce(given("name"), given("title"))


def media_of(owner: Column, included: Column, site: Site = Site(), resolved: Column | None = None) -> Column:
    """Media of a record or chapter; ``resolved`` is a map from a medium's id to RESOLVED."""
    answer = lambda m: F.lit(None).cast(RESOLVED) if resolved is None else F.try_element_at(resolved, m["id"])
    return F.transform(
        F.concat(related(owner, included, "media"), related(owner, included, "medias")),
        lambda m: F.struct(
            m["id"].alias("id"), m["type"].alias("type"), attribute(m, "media-type").alias("media_type"), attribute(m, "title").alias("title"), attribute(m, "duration").try_cast("double").alias("duration"),
            attribute(m, "created-at").alias("created_at"), asset_url(attribute(m, "audio"), site.audio).alias("audio_url"), absolute_url(attribute(m, "original-src"), site.base).alias("original_src"),
            absolute_url(attribute(m, "playlist"), site.base).alias("playlist_url"), attribute(m, "vod-file-id").alias("vod_file_id"), attribute(m, "process-state").alias("process_state"),
            timelines(m, included, site).alias("timelines"), answer(m).alias("resolved"),
        ),
    )


def chapters_of(owner: Column, included: Column, site: Site = Site(), resolved: Column | None = None) -> Column:
    """An album's chapters with their media."""
    given = lambda o, name: attribute(o, name)
    listed = related(owner, included, "published-radios")
    return F.transform(
        F.when(F.size(listed) > 0, listed).otherwise(related(owner, included, "radios")),
        lambda c: F.struct(
            c["id"].alias("id"), c["type"].alias("type"), (entry_url(F.lit("radios"), c["id"], site.base, site.kinds) if site.base else F.lit(None).cast("string")).alias("url"), given(c, "title").alias("title"),
            given(c, "excerpt").alias("excerpt"), given(c, "published-at").alias("published_at"), given(c, "duration").try_cast("double").alias("duration"), given(c, "is-free").try_cast("boolean").alias("is_free"),
            rich_text(given(c, "content")).alias("content_text"), media_of(c, included, site, resolved).alias("media"),
        ),
    )


def named_records(owner: Column, included: Column, name: str) -> Column:
    """(id, type, title, name) of related objects."""
    return F.transform(related(owner, included, name), lambda o: F.struct(o["id"].alias("id"), o["type"].alias("type"), attribute(o, "title").alias("title"), attribute(o, "name").alias("name")))


def normalize_documents(rows: DataFrame, column: str = "document", site: Site = Site(), resolved: str | None = None) -> DataFrame:
    """Records of parsed documents: attributes as columns, relationships resolved within the row.

    ``resolved`` names a column of rows, a map from a medium's id to what its provider answered.
    """
    data, included = F.col(f"{column}.data"), F.col(f"{column}.included")
    a = lambda name: attribute(data, name)
    flag = lambda name: a(name).try_cast("boolean")
    names = lambda rel: F.array_compact(F.transform(related(data, included, rel), label))
    people = F.concat(related(data, included, "user"), related(data, included, "djs"))
    users = F.array_distinct(F.transform(people, lambda u: F.struct(u["id"].alias("id"), attribute(u, "nickname").alias("nickname"), F.coalesce(attribute(u, site.official_flag).try_cast("boolean"), F.lit(False)).alias("is_official"))))
    answers = None if resolved is None else F.col(resolved)
    url = entry_url(data["type"], data["id"], site.base, site.kinds) if site.base else F.lit(None).cast("string")
    return rows.where(data.isNotNull()).select(
        F.concat_ws(":", data["type"], data["id"]).alias("item_key"), data["id"].alias("id"), data["type"].alias("type"), url.alias("url"), a("title").alias("title"), a("excerpt").alias("excerpt"), a("desc").alias("desc"),
        a("published-at").alias("published_at"), a("created-at").alias("created_at"), a("duration").try_cast("double").alias("duration"), flag("is-free").alias("is_free"), a("owner-type").alias("owner_type"),
        flag("option-is-official").alias("option_is_official"), flag("is-official").alias("is_official"), asset_url(a("cover"), site.images).alias("cover_url"), asset_url(a("thumb"), site.images).alias("thumb_url"),
        asset_url(a("speech-path"), site.audio).alias("speech_audio_url"), rich_text(a("content")).alias("content_text"), F.get(names("category"), F.lit(0)).alias("category"), names("tags").alias("tags"), users.alias("users"),
        named_records(data, included, "albums").alias("albums"), named_records(data, included, "djs").alias("djs"), media_of(data, included, site, answers).alias("media"), chapters_of(data, included, site, answers).alias("chapters"),
    )


def media_jobs(records: DataFrame, include_speech: bool = True) -> DataFrame:
    """A job for each speech, medium and timeline asset of records and their chapters, with its source and its place on disk."""
    none = F.lit(None).cast("string")
    whole = ["item_key", "type", "id"]
    names = [*whole, "item_title", "published_at", "url", "duration"]
    owned = records.withColumn("item_title", F.col("title"))
    job = lambda *rest: F.concat_ws(":", *whole[1:], *rest)
    of_item = owned.select(*names, F.lit("item").alias("kind"), F.col("id").alias("part_id"), F.col("title").alias("part_title"), F.col("url").alias("part_url"), none.alias("part_published"), F.lit(None).cast("double").alias("part_duration"), F.lit(None).cast("int").alias("chapter_index"), "media")
    parts = of_item
    if "chapters" in records.columns:
        c = owned.select(*names, F.posexplode("chapters").alias("nth", "c"))
        parts = parts.unionByName(
            c.select(*names, F.lit("chapter").alias("kind"), F.col("c.id").alias("part_id"), F.col("c.title").alias("part_title"), F.col("c.url").alias("part_url"),
                     F.col("c.published_at").alias("part_published"), F.col("c.duration").cast("double").alias("part_duration"), (F.col("nth") + 1).alias("chapter_index"), F.col("c.media").alias("media"))
        )
    parts = parts.withColumns({"published_at": F.coalesce("part_published", "published_at"), "part_url": F.coalesce("part_url", "url")})
    each = parts.withColumn("m", F.explode("media")).drop("media")
    resolved = F.col("m.resolved")
    source = media_source(F.col("m.audio_url"), F.col("m.media_type"), resolved["provider"], resolved["m3u8"], resolved["play_auth"], F.col("m.original_src"), F.col("m.playlist_url"))
    shared = [*whole, "item_title", "published_at", "chapter_index"]
    media = each.withColumn("s", source).where(F.col("s").isNotNull()).select(
        *shared, job("kind", "part_id", F.lit("media"), F.col("m.id")).alias("job_id"), F.col("kind").alias("segment_type"), F.col("part_id").alias("segment_id"), F.col("part_title").alias("segment_title"), F.col("part_url").alias("segment_url"), F.col("m.id").alias("media_id"), F.col("m.title").alias("media_title"),
        F.col("m.media_type").alias("media_type"), F.col("s.provider"), F.col("s.access_mode"), F.col("s.media_url"), F.col("m.playlist_url").alias("playlist_url"), F.col("s.play_auth"), F.col("s.download_method"), F.coalesce("m.duration", "part_duration", F.when(F.col("kind") == "item", F.col("duration"))).alias("duration"), F.lit("pending").alias("transcript_status"),
    )
    assets = each.withColumn("t", F.explode("m.timelines")).where(F.coalesce("t.asset_url", F.lit("")) != "").select(
        *shared, job("kind", "part_id", F.lit("timeline"), F.col("t.id"), F.lit("asset")).alias("job_id"), F.lit("timeline").alias("segment_type"), F.col("t.id").alias("segment_id"), F.coalesce("t.title", "m.title", "part_title").alias("segment_title"), F.coalesce("t.quote_href", "part_url").alias("segment_url"),
        F.concat("t.id", F.lit("_asset")).alias("media_id"), F.coalesce("t.title", "m.title").alias("media_title"), F.lit("timeline_asset").alias("media_type"), F.lit("direct").alias("provider"), F.lit("asset_url").alias("access_mode"), F.col("t.asset_url").alias("media_url"), none.alias("playlist_url"),
        none.alias("play_auth"), F.lit("direct").alias("download_method"), F.lit(None).cast("double").alias("duration"), F.lit("skipped").alias("transcript_status"),
    )
    jobs = media.unionByName(assets)
    if include_speech:
        jobs = jobs.unionByName(
            owned.withColumn("chapter_index", F.lit(None).cast("int")).where(F.coalesce("speech_audio_url", F.lit("")) != "").select(
                *shared, job(F.lit("item"), "id", F.lit("speech")).alias("job_id"), F.lit("item").alias("segment_type"), F.col("id").alias("segment_id"), F.col("item_title").alias("segment_title"), F.col("url").alias("segment_url"), F.lit("speech").alias("media_id"), F.col("item_title").alias("media_title"),
                F.lit("speech").alias("media_type"), F.lit("direct").alias("provider"), F.lit("audio_url").alias("access_mode"), F.col("speech_audio_url").alias("media_url"), none.alias("playlist_url"), none.alias("play_auth"), F.lit("direct").alias("download_method"), "duration", F.lit("pending").alias("transcript_status"),
            )
        )
    place = F.concat_ws("/", F.lit("downloads"), "type", "id", "segment_type", "segment_id", F.concat("media_id", guess_extension(F.col("media_url"), F.col("access_mode"), F.col("media_type"))))
    return jobs.withColumns({"status": F.lit("pending"), "relpath": place})


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def is_term(t: Column, longest: int, stop: Sequence[str] = ()) -> Column:
    """Whether a squeezed text can be an index term, as ``terms.term`` has it."""
    stops = F.array(*[F.lit(s) for s in sorted({*STOP_TERMS, *stop})])
    return (
        F.length(t).between(2, longest) & ~F.array_contains(stops, t) & ~F.rlike(t, F.lit("|".join(STOP_PARTS))) & ~F.rlike(t, F.lit(r"(?U)^(?:[0-9]+|[\W_]+)$")) & ~F.rlike(t, F.lit("https?://"))
    )


def hot_words_of(records: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(item_key, terms): tags, category, nicknames, titles and short fragments of a record's texts."""
    kept = lambda terms, longest=LONGEST_TERM: F.filter(F.transform(terms, squeezed), lambda t: is_term(t, longest, stop))
    texts = F.array_compact(F.array("title", "excerpt", "desc"))
    quotes = F.flatten(F.transform(texts, lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(f"{a}([^{b}]{{1,24}}){b}"), F.lit(1)) for a, b in (("《", "》"), ("“", "”"), ("【", "】"), ("（", "）"), (r"\(", r"\)"))])))
    latin = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"\b[A-Za-z][A-Za-z0-9+._:-]{1,31}\b"), F.lit(0))))
    fragments = F.flatten(F.transform(texts, lambda t: F.split(F.regexp_replace(t, "[《》“”【】（）()]", " "), r"[，。！？；：、/\n\r\t|]+")))
    names = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("category"), F.transform("users", lambda u: u["nickname"]), F.transform("media", lambda m: m["title"]))
    return records.select("item_key", F.array_distinct(F.concat(kept(names), kept(texts), kept(quotes), kept(latin), kept(fragments, LONGEST_FRAGMENT))).alias("terms"))


def merged_terms(lists: DataFrame, limit: int, key: str = "job_id", order: str = "nth") -> DataFrame:
    """(key, terms): the union of ranked lists of terms for each key, those that are no index terms left out, the first of equal ones kept, at most ``limit``.

    lists: (key, list, nth, term); lists go by their number. By aggregates alone: each term's first place is found before
    a key's terms are put together, so what is collected for a key are its distinct terms.
    """
    wanted = squeezed(F.col("term"))
    first = lists.where(is_term(wanted, LONGEST_TERM)).groupBy(key, wanted.alias("term")).agg(F.min(F.struct("list", order)).alias("place"))
    ranked = first.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("__r") <= limit)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "term"))), lambda t: t["term"]).alias("terms"))


def job_terms(dynamic: DataFrame, everywhere: Sequence[str], limit: int, key: str = "job_id") -> DataFrame:
    """(key, terms): a job's own terms (key, terms), then those of a list for all jobs, each once, at most ``limit``."""
    given = F.array(*[F.lit(t) for t in everywhere]).cast("array<string>")  # a word list is small
    whole = F.transform(F.concat(F.coalesce("terms", F.array().cast("array<string>")), given), squeezed)
    return dynamic.select(key, F.slice(F.array_distinct(F.filter(whole, lambda t: is_term(t, LONGEST_TERM))), 1, limit).alias("terms"))
