"""Command line: build, sync, search, upkeep and catalogue queries over Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidepool")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *places: str, **options: object) -> None:
        p = sub.add_parser(name, help=about)
        for place in places:
            p.add_argument(place)
        for option, default in options.items():
            flag = f"--{option.replace('_', '-')}"
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            elif default == []:
                p.add_argument(flag, nargs="*", default=[])
            else:
                p.add_argument(flag, type=str if default is None else type(default), default=default)

    command("normalize", "records from raw API documents, one a line", "documents", "out")
    command("build-index", "documents and hash vectors from normalised records and transcripts", "records", "transcripts", "out", collection="main")
    command("sync-index", "builds and merges what changed; prints the mark to go on from", "index", "items", "records", "transcripts", "out", collection="main", since=None, at="")
    command("search", "ranked results as JSON", "index", "query", limit=10, scope="content", doc_types=[], categories=[], participants=[])
    command("episode", "an item's documents by type", "index", "item_key")
    command("categories", "categories and their counts", "index", limit=200)
    command("participants", "participants and their counts", "index", limit=200)
    command("status", "counts of an index", "index")
    command("clear", "an index without a collection, or empty", "index", "out", collection=None)
    command("export-bundle", "one collection's documents and vectors with a manifest", "index", "out", collection="main", version=1)
    command("copy-vectors", "vectors with one collection's copied to another", "vectors", "out", "source", "target", doc_types=[], item_keys=[])
    command("count-vectors", "vectors of a collection, types and items", "vectors", collection=None, doc_types=[], item_keys=[])
    command("media-jobs", "media jobs of normalised records", "records", "out", no_speech=False)
    command("queue", "jobs in the order of a queue", "jobs", "name", limit=50, categories=[])
    command("report", "how far downloads and transcripts are", "jobs")
    command("repair", "transcripts cleaned, their chunks cut anew, and why a repair is refused", "transcripts", "out")
    command("build-lexicon", "the most frequent index terms of normalised records", "records", "out", limit=2000)
    command("state", "a key's last state", "log", "key")
    command("set-state", "adds a key's state to the log; no payload deletes it", "log", "key", "at", payload=None)
    command("create-collection", "an index in a folder that syncs by item, from documents", "documents", "out", dimension=256)
    command("sync-collection", "documents in place of all of some items, in documents, points and postings", "path", "documents", "items", dimension=256)
    command("find", "ranked results of a collection as JSON; with probes by the nearest cells", "path", "collection", "query", limit=10, scope="content", doc_types=[], categories=[], participants=[], dimension=256, probes=0)
    command("options", "categories and participants as options of a filter, the selected first", "index", selected=[])
    command("ui-meta", "what a viewer shows before any search, as a JSON file", "index", "out", root=None, participants=0)
    command("library-updated", "when a library changed last", "root")
    command("poll-results", "appends the listing of a result folder to a log that the bridge streams", "results", "log")
    command("audit", "the last entries of an audit log", "log", rows=20)
    command("run", "a catalogue query over a folder of tables", "name", "tables", rows=20)
    return out


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import functions as F

    from tidepool.functions.embed import HashProvider, hash_embed
    from tidepool.operators import documents, merges, records, states, stats
    from tidepool.plans import catalogue, indexes, indexing, upkeep  # noqa: F401
    from tidepool.plans.collection import Collection
    from tidepool.plans.search import Memory
    from tidepool.session import session
    from tidepool.sources import sinks, vectors
    from tidepool.sources.readers import library_updated_at, normalized_records
    from tidepool.streaming import audit, bridge

    args, spark = parser().parse_args(argv), session()
    command = args.command
    read = spark.read.parquet
    keyed = lambda: normalized_records(spark, args.records).withColumn("item_key", F.concat_ws(":", "type", "id"))
    memory = lambda: Memory(read(f"{args.index}/documents"), read(f"{args.index}/vectors"), HashProvider())
    show = lambda rows: [print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str)) for r in rows.collect()]
    save = lambda rows, at: rows.write.mode("overwrite").parquet(at)

    def write_index(docs, at: str) -> None:
        sinks.write_documents(docs, f"{at}/documents")
        held = read(f"{at}/documents")
        save(hash_embed(held, text="vector_text").join(held.select("doc_id", "collection_name", "doc_type", "item_key"), "doc_id"), f"{at}/vectors")

    if command == "normalize":
        raw = spark.read.text(args.documents).select(records.parse_document(F.col("value")).alias("document"))
        save(records.normalize_documents(raw), args.out)
    elif command == "build-index":
        write_index(documents.build_documents(keyed(), read(args.transcripts)).withColumn("collection_name", F.lit(args.collection)), args.out)
    elif command == "sync-index":
        jobs = spark.createDataFrame([], "job_key string, item_key string, transcript_id string, job_type string, payload_json string, attempt_count int, status string, last_error string, updated_at string, completed_at string")
        done = indexing.sync_index(read(f"{args.index}/documents"), jobs, read(args.items), keyed(), read(args.transcripts), args.collection, args.at, args.since)
        write_index(done.documents, args.out)
        save(done.jobs, f"{args.out}/jobs")
        print(json.dumps({"indexed": done.indexed, "mark": done.mark, "errors": [r.asDict() for r in done.errors.collect()]}, ensure_ascii=False))
    elif command == "search":
        print(memory().answer(args.query, limit=args.limit, scope=args.scope, doc_types=args.doc_types, categories=args.categories, participants=args.participants))
    elif command == "episode":
        show(memory().episode_details(args.item_key))
    elif command == "categories":
        show(memory().categories(args.limit))
    elif command == "participants":
        show(memory().participants(args.limit))
    elif command == "status":
        print(json.dumps(memory().meta(), ensure_ascii=False))
    elif command == "clear":
        write_index(states.cleared(read(f"{args.index}/documents"), args.collection), args.out)
    elif command == "export-bundle":
        print(json.dumps(sinks.export_bundle(read(f"{args.index}/documents"), read(f"{args.index}/vectors"), args.collection, args.out, args.version), ensure_ascii=False))
    elif command == "copy-vectors":
        save(vectors.copied(read(args.vectors), args.source, args.target, args.doc_types, args.item_keys), args.out)
    elif command == "count-vectors":
        print(vectors.count(read(args.vectors), collection=args.collection, doc_types=args.doc_types, item_keys=args.item_keys))
    elif command == "media-jobs":
        save(records.media_jobs(keyed(), include_speech=not args.no_speech), args.out)
    elif command == "queue":
        rows = read(args.jobs)
        queues = {
            "download": lambda: merges.by_priority(rows, *merges.download_order()),
            "transcribe": lambda: merges.by_priority(rows, *merges.transcription_order()),
            "rescue": lambda: merges.by_priority(rows, *merges.rescue_order()),
            "failed": lambda: merges.failed_transcriptions(rows),
            "submitted": lambda: merges.submitted_transcriptions(rows),
            "remote": lambda: merges.remote_transcriptions(rows),
            "second": lambda: merges.rescue_jobs(rows, args.limit, args.categories),
        }
        show(queues[args.name]().limit(args.limit))
    elif command == "report":
        show(stats.pipeline_report(read(args.jobs)))
    elif command == "repair":
        saved, chunks, refused = states.repaired_transcripts(read(args.transcripts))
        for name, rows in (("transcripts", saved), ("chunks", chunks), ("refused", refused)):
            save(rows, f"{args.out}/{name}")
    elif command == "build-lexicon":
        stats.document_frequency(records.hot_words_of(keyed()), F.col("terms"), args.limit).write.mode("overwrite").json(args.out)
    elif command == "state":
        show(sinks.read_state(spark, args.log).where(F.col("state_key") == args.key))
    elif command == "set-state":
        sinks.append_state(spark, args.log, args.key, None if args.payload is None else json.loads(args.payload), args.at)
    elif command == "create-collection":
        Collection.create(read(args.documents), args.out, lambda: HashProvider(args.dimension))
    elif command == "sync-collection":
        done = Collection(spark, args.path, lambda: HashProvider(args.dimension)).sync(read(args.documents), read(args.items))
        print(json.dumps(done.__dict__))
    elif command == "find":
        found = Collection(spark, args.path, lambda: HashProvider(args.dimension)).memory(args.collection, args.probes or None)
        print(found.answer(args.query, limit=args.limit, scope=args.scope, doc_types=args.doc_types, categories=args.categories, participants=args.participants))
    elif command == "options":
        show(stats.filter_options(memory().categories().withColumnRenamed("category", "name").select(F.lit("category").alias("kind"), "name", "n").unionByName(memory().participants().select(F.lit("participant").alias("kind"), "name", "n")), args.selected))
    elif command == "ui-meta":
        meta = memory().ui_meta(library_updated_at(spark, args.root) if args.root else None, args.participants or None)
        sinks.write_text(spark, args.out, json.dumps(meta, ensure_ascii=False, indent=2))
    elif command == "library-updated":
        print(json.dumps(library_updated_at(spark, args.root)))
    elif command == "poll-results":
        bridge.poll(spark, args.results, args.log)
    elif command == "audit":
        show(audit.entries(spark, args.log).orderBy(F.desc("batch"), F.desc("timestamp")).limit(args.rows))
    elif command == "run":
        catalogue.QUERIES[args.name](spark, args.tables).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
