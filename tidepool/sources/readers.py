"""Sources: nested record files, transcripts, word lists, paged interfaces."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidepool.functions.terms import keep_first, term

TIMELINE = "struct<id:string,type:string,at:string,title:string,content:string,asset_url:string,quote_href:string,comments_count:bigint>"
MEDIUM = f"struct<id:string,type:string,media_type:string,title:string,duration:double,created_at:string,audio_url:string,original_src:string,playlist_url:string,vod_file_id:string,process_state:string,timelines:array<{TIMELINE}>,resolved:struct<provider:string,m3u8:string,play_auth:string>>"
USER = "struct<id:string,nickname:string,is_official:boolean>"
CHAPTER = f"struct<id:string,type:string,url:string,title:string,excerpt:string,desc:string,published_at:string,duration:double,content_text:string,media:array<{MEDIUM}>>"
RECORD = (
    "id string, type string, url string, title string, excerpt string, desc string, published_at string, created_at string, duration double, is_free boolean, owner_type string, option_is_official boolean, "
    f"is_official boolean, cover_url string, thumb_url string, speech_audio_url string, content_text string, category string, tags array<string>, users array<{USER}>, media array<{MEDIUM}>, chapters array<{CHAPTER}>"
)


def normalized_records(spark: SparkSession, root: str, types: Sequence[str] = ()) -> DataFrame:
    """Normalised record files below ``root``/<type>/*.json; malformed files give rows of NULLs."""
    rows = spark.read.schema(RECORD).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    rows = rows.withColumn("type", F.coalesce("type", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)))
    return rows.where(F.col("type").isin(*types)) if types else rows


def count_candidates(spark: SparkSession, root: str, types: Sequence[str] = ()) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("type"))
    return (files.where(F.col("type").isin(*types)) if types else files).count()


def in_scope(rows: DataFrame, types: Sequence[str] = (), official_only: bool = False, official_owner: str = "official") -> DataFrame:
    """Rows of the types; official by owner where one is given, else by flags or any official user."""
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if not official_only:
        return rows
    flagged = F.coalesce("option_is_official", F.lit(False)) | F.coalesce("is_official", F.lit(False)) | F.coalesce(F.exists("users", lambda u: u["is_official"]), F.lit(False))
    return rows.where(F.when(F.coalesce("owner_type", F.lit("")) != "", F.col("owner_type") == official_owner).otherwise(flagged))


def parsed_payload(value: Column) -> Column:
    """A transcript payload's object (text, segments); NULL for a JSON string or plain text."""
    shape = "struct<text:string,segments:array<struct<start_ms:bigint,end_ms:bigint,text:string,speaker_id:string>>>"
    return F.when(F.rlike(value, F.lit(r"(?s)^\s*\{.*\}\s*$")), F.from_json(value, shape))


def payload_text(value: Column) -> Column:
    """A transcript payload's text: an object's own or its segments', a JSON string, or the payload itself."""
    parsed, is_string = parsed_payload(value), F.rlike(value, F.lit(r'(?s)^\s*".*"\s*$'))
    joined = F.array_join(F.transform(parsed["segments"], lambda s: F.trim(s["text"])), "\n")
    plain = F.when(is_string, F.get_json_object(F.concat(F.lit('{"t":'), value, F.lit("}")), "$.t")).when(~F.rlike(value, F.lit(r"(?s)^\s*\{.*\}\s*$")), value)
    return F.coalesce(F.nullif(F.trim(parsed["text"]), F.lit("")), F.nullif(joined, F.lit("")), plain, F.lit(""))


def transcript_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, segments): a JSON object, a JSON string or plain text; text falls back to the segments' texts."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return raw.select("path", payload_text(F.col("value")).alias("text"), parsed_payload(F.col("value"))["segments"].alias("segments"))


def hot_word_list(spark: SparkSession, path: str) -> list[str]:
    """Terms of a word list: one a line, what follows `|` left off, first of equal ones kept. Lists are small."""
    return keep_first(t for r in spark.read.text(path).collect() if (t := term(r["value"].split("|")[0])))


def alias_map(text: str | None, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """Aliases of a JSON object over the defaults, both sides normalised, empty and equal ones left out."""
    given = json.loads(text) if text else {}
    both = {" ".join(str(a).split()): " ".join(str(b).split()) for a, b in ((defaults or {}) | given).items()}
    return {a: b for a, b in both.items() if a and b and a != b}


class _Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class _PageReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[int, int], Sequence[tuple]]) -> None:
        self.limit, self.total, self.fetch = int(options.get("limit", 50)), int(options.get("total", 0)), fetch

    def partitions(self) -> Sequence[InputPartition]:
        return [_Page(k) for k in range(0, self.total, self.limit)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield from self.fetch(partition.offset, min(self.limit, self.total - partition.offset))


def item_source(name: str, fields: str, fetch: Callable[[str, str], Sequence[tuple]], includes: dict[str, str] | None = None) -> type[DataSource]:
    """A data source of single items: options ``type`` and ``ids`` (comma-joined); each id is a partition.

    ``fetch`` gets a path `type/id` and what to include with items of that type.
    """

    class Items(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            kind, ids = self.options["type"], [i for i in self.options["ids"].split(",") if i]
            return _ItemReader(ids, lambda i: fetch(f"{kind}/{i}", (includes or {}).get(kind, "")))

    return Items


class _ItemReader(DataSourceReader):
    def __init__(self, ids: list[str], fetch: Callable[[str], Sequence[tuple]]) -> None:
        self.ids, self.fetch = ids, fetch

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(i) for i in self.ids]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value)


def bridge_results(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, signature, item_key, payload) of result files, oldest first, by a signature of time and length."""
    from tidepool.streaming.incremental import file_signature

    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    signed = file_signature(spark, path, pattern)
    rows = signed.join(raw, "path").withColumn("item_key", F.get_json_object("payload", "$.item_key"))
    return rows.orderBy("modificationTime", "path").select("path", "signature", "item_key", "payload")


def snapshot(spark: SparkSession, path: str) -> dict | None:
    """A small JSON object that a text file or folder holds; None for none or for anything else."""
    from pyspark.errors import AnalysisException

    try:
        text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # one small document
        found = json.loads(text)
    except (AnalysisException, ValueError):
        return None
    return found if isinstance(found, dict) else None


def paged_source(name: str, fields: str, fetch: Callable[[int, int], Sequence[tuple]]) -> type[DataSource]:
    """A data source over an interface with offset and limit: each page is a partition, fetched by an executor."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            return _PageReader(self.options, fetch)

    return Paged


# Where the time of a library's last change is looked for, in this order.
UPDATED_KEYS = ("library_updated_at", "dataset_published_at", "built_at")
UPDATED_FILES = ("reports/search_release_meta.json", "reports/daily_incremental_summary.json", "catalog.sqlite")


def library_updated_at(spark: SparkSession, root: str, manifest: dict | None = None, files: Sequence[str] = UPDATED_FILES) -> str | None:
    """When a library changed last: what its manifest says, else the first of the files that is there, by a key or its own time.

    Files are small; a file that holds no JSON object, or none of the keys, counts by when it was written.
    """
    for key in UPDATED_KEYS:
        if value := str((manifest or {}).get(key) or "").strip():
            return value
    for name in files:
        rows = _small_file(spark, f"{root}/{name}")
        if rows is None:
            continue
        said = [F.nullif(F.trim(F.get_json_object("value", f"$.{key}")), F.lit("")) for key in UPDATED_KEYS]
        found = rows.select(F.coalesce(*said).alias("said"), F.date_format("written", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("written")).first()
        if found is not None:
            return (found["said"] if name.endswith(".json") else None) or found["written"]
    return None


def _small_file(spark: SparkSession, path: str) -> DataFrame | None:
    """(value, written) of a file, None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return None
    text = F.when(F.endswith("path", F.lit(".json")), F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""))
    return raw.select(text.alias("value"), F.col("modificationTime").alias("written"))
