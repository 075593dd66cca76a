"""The search interface: documents and vectors in, ranked results with context out."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import terms as clues
from tidepool.functions.embed import Provider
from tidepool.functions.text import excerpt, format_ms, or_else, replace_aliases
from tidepool.operators import context, gram_index, retrieval, stats
from tidepool.operators.retrieval import Tuning
from tidepool.session import shared_folder
from tidepool.sources.points import PointTable

#: Columns that a hit carries from its document, and their types where documents lack them.
CARRIED = {
    "doc_type": "string", "item_key": "string", "item_id": "string", "item_title": "string", "item_url": "string", "category": "string", "users": "array<string>", "tags": "array<string>", "published_at": "string",
    "title": "string", "keyword_text": "string", "text_raw": "string", "summary": "string", "start_ms": "bigint", "end_ms": "bigint", "timeline_ms": "bigint", "doc_index": "int", "atom_ids": "array<string>",
    "timeline_title": "string", "timeline_content": "string", "timeline_at": "string", "asset_url": "string", "quote_href": "string",
}
HIT = [*CARRIED, "recall_stage", "score"]
#: Columns of an item's display record.
DISPLAY = {"cover_url": "string", "thumb_url": "string", "excerpt": "string", "desc": "string", "duration": "double", "url": "string"}
#: The fields of a result, in order.
RESULT = (
    "doc_id doc_type score rerank_score item_key item_id item_title title published_at category users tags cover_url thumb_url excerpt desc duration start_ms end_ms timeline_ms display_timestamp display_text "
    "timeline_title timeline_content timeline_at timeline_asset_url timeline_quote_href recall_stage why_matched matched_terms match_details match_summary source_url neighbor_atoms"
).split()
NEIGHBOUR = "struct<doc_id:string,start_ms:bigint,end_ms:bigint,text:string,display_timestamp:string>"
#: How far around a note its atoms may be.
NOTE_REACH_MS = 24_000


def searched() -> Column:
    """The text that the lexical branch searches."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "item_title", "keyword_text", "text_raw")])


class Memory:
    """A collection: ``docs`` as the builders make them, a provider for queries, and ``items``, the display records (item_key
    and any of DISPLAY).

    ``vectors`` is a point table, whose rows carry what searches filter by (all of ``collection``, where one is named), or
    plain rows (doc_id, embedding), which are filtered by a join with docs. ``postings`` is a trigram index of the texts that
    the lexical branch searches (as ``searched`` gives them); without one that branch scans them.
    """

    def __init__(
        self, docs: DataFrame, vectors: DataFrame | PointTable | None = None, provider: Provider | None = None, aliases: dict[str, str] | None = None, items: DataFrame | None = None, collection: str | None = None,
        postings: DataFrame | None = None,
    ) -> None:
        whole = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in CARRIED.items() if c not in docs.columns})
        self.docs = whole.withColumn("timeline_title", F.when(F.col("doc_type") == "timeline_note", F.col("title")))
        self.vectors, self.provider, self.aliases, self.items, self.collection, self.postings = vectors, provider, aliases or {}, items, collection, postings
        self.embed = lru_cache(maxsize=256)(self._embed)

    def _embed(self, query: str) -> tuple[float, ...]:
        if self.provider is None or self.vectors is None:
            raise RuntimeError("no vectors")
        return tuple(self.provider.embed_queries([query])[0])

    def _recall(self, query: str, types: Sequence[str], categories: Sequence[str], users: Sequence[str], k: int, stage: str) -> DataFrame:
        """The k nearest documents: rows are filtered, vectors ranked, and only the k documents that are left looked up by id."""
        if isinstance(self.vectors, PointTable):
            top = self.vectors.search(self.embed(query), k, collection=self.collection, doc_types=types, categories=categories, participants=users)
        else:
            rows = retrieval.payload_filter(self.docs, types, categories, users)
            top = retrieval.vector_topk(self.vectors.select("doc_id", "embedding").join(rows.select("doc_id"), "doc_id", "left_semi"), self.embed(query), k)
        found = [(r["doc_id"], r["score"]) for r in top.select("doc_id", "score").collect()]  # k rows
        scores = self.docs.sparkSession.createDataFrame(found, f"doc_id {self.docs.schema['doc_id'].dataType.simpleString()}, score double")
        return self.docs.where(F.col("doc_id").isin(*[i for i, _ in found])).join(F.broadcast(scores), "doc_id").withColumn("recall_stage", F.lit(stage))

    def _lexical(self, wanted: Sequence[str], types: Sequence[str], categories: Sequence[str], users: Sequence[str], k: int) -> DataFrame:
        rows, terms = retrieval.payload_filter(self.docs, types, categories, users), clues.recall_terms(wanted)
        near = None if self.postings is None else gram_index.candidates(self.postings, terms)
        if near is not None:
            rows = rows.join(near, "doc_id", "left_semi")
        top = retrieval.lexical_topk(rows, terms, k, text=searched())
        return top.withColumn("score", retrieval.hit_score(F.col("lexical_score"), F.max("lexical_score").over(Window.partitionBy()))).withColumn("recall_stage", F.lit("lexical_fallback"))

    def normalized(self, query: str) -> tuple[str, dict[str, int]]:
        """The query with its aliases replaced, and how often each was."""
        spark = self.docs.sparkSession
        text, counts = replace_aliases(F.lit(query), self.aliases)
        row = spark.range(1).select(text.alias("text"), *[c.alias(str(k)) for k, c in enumerate(counts.values())]).first()
        return row["text"], {name: row[str(k)] for k, name in enumerate(counts) if row[str(k)]}

    def candidates(self, query: str, limit: int = 10, scope: str = "content", doc_types: Sequence[str] = (), categories: Sequence[str] = (), participants: Sequence[str] = (), tuning: Tuning = Tuning()) -> tuple[DataFrame, str | None, list[str]]:
        """Hits with their position, the reason if vectors couldn't be used, and the query's terms.

        Recall runs here, its some hundred rows checkpointed, so that a failure of the vectors at any point, the reading of
        their table included, leads to the lexical branch.
        """
        query, _ = self.normalized(query)
        wanted, types, reason = clues.query_terms(query), clues.scope_doc_types(scope, doc_types), None
        shared_folder(self.docs.sparkSession)
        try:
            hits = self._recall(query, types, categories, participants, tuning.primary_limit(limit), "primary")
            order = [F.col("stage"), F.desc("score"), F.col("doc_id")]
            hits = hits.withColumn("stage", F.lit(0))
            if (scope or "content").strip().lower() == "content" and tuning.second_pass_atom_enabled:
                second = self._recall(query, ["evidence_atom"], categories, participants, tuning.second_limit(limit), "second_pass_atom")
                hits = hits.unionByName(second.withColumn("stage", F.lit(1)))
            hits = hits.checkpoint(eager=True)
        except (AnalysisException, TypeError):  # a fault of the plan, not of a service
            raise
        except Exception as error:  # the embedding service and the vector table may fail in any way; the lexical branch answers
            reason = retrieval.degrade_reason(error)
            hits = self._lexical(wanted, types, categories, participants, tuning.primary_limit(limit)).withColumn("stage", F.lit(0)).checkpoint(eager=True)
            order = [F.desc("lexical_score"), F.col("doc_type"), F.col("item_key"), F.col("doc_index")]
        # Recall limits bound what this window sees: some hundred rows.
        placed = hits.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)
        return retrieval.dedupe_hits(placed, HIT), reason, wanted

    def neighbours(self, hits: DataFrame) -> DataFrame:
        """(hit_id, neighbor_atoms): the atoms beside an atom, those of a scene, and those around a note in time."""
        told = lambda start, text: F.struct(F.col("doc_id"), F.col("start_ms"), F.col("end_ms"), F.col(text).alias("text"), F.when(F.col(start).isNotNull(), format_ms(F.col(start))).alias("display_timestamp"))
        named = [r["item_key"] for r in hits.select("item_key").distinct().collect()]  # as many as results
        atoms = self.docs.where((F.col("doc_type") == "evidence_atom") & F.col("item_key").isin(*named)).select("doc_id", "item_key", "doc_index", "start_ms", "end_ms", "text_raw").checkpoint(eager=True)  # read once for the three kinds
        of = lambda kind: hits.where(F.col("doc_type") == kind).select(F.col("doc_id").alias("hit_id"), "item_key", "doc_index", "atom_ids", F.coalesce("timeline_ms", "start_ms", F.lit(0)).alias("anchor_ms"))
        beside = context.neighbours_by_index(of("evidence_atom"), atoms.withColumn("text", F.struct("doc_id", "start_ms", "end_ms", "text_raw")))
        beside = beside.select("hit_id", F.col("neighbour_index").cast("long").alias("place"), "neighbour_text.*")
        inside = context.neighbours_by_ids(of("scene_summary"), atoms).select("hit_id", F.col("nth").cast("long").alias("place"), "doc_id", "start_ms", "end_ms", "text_raw")
        around = context.neighbours_by_time(of("timeline_note"), atoms.withColumn("atom_id", F.col("doc_id")), reach=NOTE_REACH_MS).select("hit_id", F.col("nth").cast("long").alias("place"), "doc_id", "start_ms", "end_ms", "text_raw")
        rows = beside.unionByName(inside).unionByName(around).select("hit_id", F.struct("place", told("start_ms", "text_raw").alias("a")).alias("n"))
        return rows.groupBy("hit_id").agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["a"]).alias("neighbor_atoms"))  # six at most

    def results(self, hits: DataFrame) -> DataFrame:
        """The fields of RESULT for reranked hits, in their order."""
        packed = self.neighbours(hits)
        shown = hits.join(packed, hits["doc_id"] == packed["hit_id"], "left").drop("hit_id")
        items = self.items
        display = {c: F.lit(None).cast(kind) for c, kind in DISPLAY.items()}
        if items is not None:
            named = items.select("item_key", *[F.col(c).cast(kind).alias(f"__{c}") for c, kind in DISPLAY.items() if c in items.columns]).dropDuplicates(["item_key"])
            shown = shown.join(named, "item_key", "left")
            display |= {c: F.col(f"__{c}") for c in DISPLAY if c in items.columns}
        head = (F.col("recall_stage") == "second_pass_atom") | (F.col("doc_type") == "evidence_atom")
        body = or_else("keyword_text", "text_raw", "summary", "timeline_content", "title")
        at = F.coalesce("start_ms", "timeline_ms")
        stamp = F.when(at.isNotNull(), format_ms(at))
        made = {
            "users": F.coalesce("users", F.array().cast("array<string>")), "tags": F.coalesce("tags", F.array().cast("array<string>")), **{c: display[c] for c in DISPLAY if c != "url"},
            "display_timestamp": stamp, "display_text": F.when(F.col("doc_type") == "item_title", "").otherwise(F.coalesce(or_else("text_raw", "summary", "timeline_content"), F.lit(""))),
            "timeline_asset_url": F.col("asset_url"), "timeline_quote_href": F.col("quote_href"), "source_url": or_else(F.col("item_url"), display["url"]),
            "match_details": retrieval.match_details(F.col("matched_terms"), excerpt(body, F.col("matched_terms"), head=head)), "match_summary": retrieval.match_summary(F.col("doc_type"), F.col("matched_terms"), stamp),
            "neighbor_atoms": F.coalesce("neighbor_atoms", F.array().cast(f"array<{NEIGHBOUR}>")),
        }
        return shown.select(*[made[c].alias(c) if c in made else F.col(c) for c in RESULT], *[c for c in ("nth", "ord") if c in shown.columns])

    def search(self, query: str, limit: int = 10, **options) -> tuple[DataFrame, dict]:
        """Ranked results, and how they came about. Options as for ``candidates``."""
        tuning = options.get("tuning", Tuning())
        hits, reason, wanted = self.candidates(query, limit, **options)
        best = retrieval.diversify(retrieval.rerank(hits, wanted, tuning), limit, enabled=tuning.diversify_enabled)
        out = self.results(best.checkpoint(eager=True))  # ``limit`` rows
        order = ["nth", F.desc("rerank_score"), "ord"] if tuning.diversify_enabled else [F.desc("rerank_score"), "ord"]
        normalized, replaced = self.normalized(query)
        how = {"query": query, "normalized_query": normalized, "alias_replacements": replaced, "terms": wanted, "degraded": reason is not None, "degraded_reason": reason, "limit": limit, "tuning": tuning.__dict__}
        return out.orderBy(*order).drop("nth", "ord"), how

    def episode_details(self, item_key: str) -> DataFrame:
        """(doc_type, documents): an item's documents in order, by type."""
        mine = self.docs.where(F.col("item_key") == item_key)
        return mine.groupBy("doc_type").agg(F.array_sort(F.collect_list(F.struct("doc_index", "doc_id", "title", "start_ms", "end_ms"))).alias("documents"))

    def participants(self, limit: int = 0) -> DataFrame:
        items = self.docs.where(F.col("doc_type") == "item_title")
        return stats.member_counts(items, F.col("users"), limit)

    def categories(self, limit: int | None = None) -> DataFrame:
        return stats.trimmed_counts(self.docs.where(F.col("doc_type") == "item_title"), "category", limit)

    def meta(self) -> dict:
        counts = {r["doc_type"]: r["n"] for r in stats.grouped_counts(self.docs, "doc_type").collect()}
        return {"doc_types": counts, "items": self.docs.select("item_key").distinct().count(), "categories": [r.asDict() for r in self.categories(200).collect()]}

    def ui_meta(self, updated_at: str | None = None, participants_limit: int | None = None) -> dict:
        """What a viewer shows before any search: counts, participants and categories of the collection."""
        titles = self.docs.where(F.col("doc_type") == "item_title")
        people, kinds = stats.member_counts(titles, F.col("users")), stats.trimmed_counts(titles, "category")
        listed = people if participants_limit is None else people.limit(participants_limit)
        return {
            "library_updated_at": updated_at, "eligible_items": titles.select("item_key").distinct().count(), "doc_type_counts": {r["doc_type"]: r["n"] for r in stats.grouped_counts(self.docs, "doc_type").collect()},
            "participants_count": people.count(), "participants": [r.asDict() for r in listed.collect()], "participants_limit": participants_limit, "program_types_count": kinds.count(),
            "program_types": [r.asDict() for r in kinds.collect()],
        }

    def answer(self, query: str, **options) -> str:
        """Results as JSON."""
        rows, how = self.search(query, **options)
        return json.dumps(how | {"results": [r.asDict(recursive=True) for r in rows.collect()]}, ensure_ascii=False, default=str)
