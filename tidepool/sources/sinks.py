"""Sinks: document tables by collection, key-value state, bundles, JSON lines."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.merges import latest, replace_scope


def write_documents(docs: DataFrame, path: str) -> None:
    """Overwrites the collections that docs has, and no others."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_name").parquet(path)


def replace_documents(old: DataFrame, new: DataFrame, doc_types: Sequence[str] = ()) -> DataFrame:
    """New documents in place of the old of the same collection and item (and of the given types only)."""
    keys = ["collection_name", "item_key"]
    if not doc_types:
        return replace_scope(old, new, new, keys)
    touched = old.where(F.col("doc_type").isin(*doc_types))
    return old.where(~F.col("doc_type").isin(*doc_types)).unionByName(replace_scope(touched, new, new, keys))


def append_state(spark: SparkSession, path: str, key: str, payload: dict, updated_at: str) -> None:
    """State is a log; the last entry of a key counts, and a NULL payload deletes it."""
    row = [(key, None if payload is None else json.dumps(payload, ensure_ascii=False, sort_keys=True), updated_at)]
    spark.createDataFrame(row, "state_key string, payload_json string, updated_at string").coalesce(1).write.mode("append").json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema("state_key string, payload_json string, updated_at string").json(path)
    return latest(log, ["state_key"], ["updated_at", "payload_json"]).where(F.col("payload_json").isNotNull())


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines; Spark's commit protocol keeps half-written output out of sight."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def point_id(doc_id: Column) -> Column:
    """UUID version 5 of a document id in the URL namespace."""
    # Fixed value: the namespace's 16 bytes.
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(doc_id, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, in place of the one before."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def export_bundle(docs: DataFrame, vectors: DataFrame, collection: str, path: str, version: int = 1, ui_meta: dict | None = None, **more: object) -> dict:
    """One collection's documents and vectors, its UI meta, and a manifest with their counts and what ``more`` says.

    The manifest is written last: a bundle without one is unfinished.
    """
    mine = docs.where(F.col("collection_name") == collection)
    mine.write.mode("overwrite").parquet(f"{path}/documents")
    vectors.join(mine.select("doc_id"), "doc_id", "left_semi").write.mode("overwrite").parquet(f"{path}/vectors")
    spark = docs.sparkSession
    held = spark.read.parquet(f"{path}/documents")
    manifest = {"version": version, "collection": collection, "documents": held.count(), "vectors": spark.read.parquet(f"{path}/vectors").count(), "doc_types": {r["doc_type"]: r["count"] for r in held.groupBy("doc_type").count().orderBy("doc_type").collect()}}
    manifest |= more
    if ui_meta is not None:
        write_text(spark, f"{path}/ui_meta.json", json.dumps(ui_meta, ensure_ascii=False, indent=2))
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


# What the manifest of a bundle for viewers says.
VIEWER_KEYS = ("app_min_version", "data_version", "built_at", "collection_name", "query_only", "doc_type_counts", "eligible_items", "embedding_provider", "embedding_model", "target_platform")


def version_parts(version: object) -> tuple[int, ...]:
    """A dotted version's numbers; what is none counts 0."""
    return tuple(int(p) if p.strip().isdecimal() else 0 for p in str(version or "").split("."))


def viewer_faults(manifest: dict, app_version: str, platform: str) -> list[str]:
    """What keeps a viewer of a version, on a platform, from using a bundle."""
    missing = [f"missing {k}" for k in VIEWER_KEYS if k not in manifest]
    if missing:
        return missing
    out = []
    if version_parts(app_version) < version_parts(manifest["app_min_version"]):
        out.append(f"version {app_version} is below {manifest['app_min_version']}")
    target = str(manifest["target_platform"] or "").strip().lower()
    if target and target != platform:
        out.append(f"made for {target}, not for {platform}")
    return out


def manifest_faults(manifest: dict, least_version: int = 1, needed: Sequence[str] = ("version", "collection", "documents", "vectors")) -> list[str]:
    """What keeps a bundle from being used."""
    missing = [f"missing {k}" for k in needed if k not in manifest]
    return missing or ([f"version {manifest['version']} is below {least_version}"] if manifest["version"] < least_version else [])
