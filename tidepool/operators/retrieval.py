"""Ranked retrieval: recall, deduplication, reranking, diversification. Filters always come before a top-k."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.embed import cosine
from tidepool.functions.text import fold_ascii, folded, folds_plainly, lowered
from tidepool.operators.products import block_best
from tidepool.session import shared_folder

# What a hit's document type adds.
TYPE_PRIORS = {"item_title": 0.18, "episode_card": 0.16, "scene_summary": 0.12, "timeline_note": 0.06, "evidence_atom": 0.0}


@dataclass(frozen=True)
class Tuning:
    """Knobs of a search; weights multiply what the reranking adds."""

    candidate_limit: int = 150
    second_pass_atom_enabled: bool = True
    second_pass_limit: int = 60
    rerank_enabled: bool = True
    diversify_enabled: bool = True
    type_prior_weight: float = 1.0
    overlap_weight: float = 1.0
    title_weight: float = 1.0
    timeline_title_weight: float = 1.0
    participant_weight: float = 1.0
    multi_hit_weight: float = 1.0

    def primary_limit(self, limit: int) -> int:
        return max(limit, self.candidate_limit)

    def second_limit(self, limit: int) -> int:
        return self.second_pass_limit if self.second_pass_limit > 0 else max(24, 6 * limit)


def term_weight(term: str) -> int:
    return min(12, max(2, len(term)))


def lexical_score(text: Column, terms: Sequence[str]) -> Column:
    """Sum of the weights of the terms that stand in the text, ASCII case folded; the text is folded once."""

    def summed(held: Column, mine: Sequence[str]) -> Column:
        out = F.lit(0)
        for t in mine:
            out = out + F.when(F.contains(held, F.lit(folded(t))), F.lit(term_weight(t))).otherwise(F.lit(0))
        return out

    plain, others = [t for t in terms if folds_plainly(t)], [t for t in terms if not folds_plainly(t)]
    # An element of an array is worked out once, however often it is named.
    once = lambda held, mine: F.get(F.transform(F.array(held), lambda h: summed(h, mine)), F.lit(0)) if mine else F.lit(0)
    return once(lowered(text), plain) + once(fold_ascii(F.coalesce(text, F.lit(""))), others)


def lexical_topk(docs: DataFrame, terms: Sequence[str], k: int, text: Column | None = None, order: Sequence[str] = ("doc_type", "item_key", "doc_index")) -> DataFrame:
    """The k documents of the highest positive lexical_score; ``docs`` is filtered already.

    Scores of zero come last, so they are dropped behind the top-k: before it the score would be worked out twice.
    """
    scored = docs.withColumn("lexical_score", lexical_score(F.col("text") if text is None else text, terms))
    return scored.orderBy(F.desc("lexical_score"), *order).limit(k).where("lexical_score > 0")


def hit_score(score: Column, over: Column) -> Column:
    """Lexical scores as hit scores: 0.42 to 0.82 by the share of the largest; 1 for a score of zero."""
    return F.when(score > 0, 0.42 + 0.40 * score / over).otherwise(F.lit(1.0))


def vector_topk(points: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """The k points of the highest cosine with the query; ties by key."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    score = cosine(F.col(vector), wanted)
    return points.withColumn("score", score if digits is None else F.round(score, digits)).orderBy(F.desc("score"), key).limit(k)


#: Queries, and points, of a block.
QUERY_BLOCK, POINT_BLOCK = 8192, 8192


def nearest(points: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "doc_id", digits: int = 9, on: Sequence[str] = ()) -> DataFrame:
    """(query_id, key, score, nth): for each of queries (query_id, q) the k points of the highest dot product, ties by key.

    Queries meet the points of equal columns ``on``, in pairs of blocks of bounded size: one product of matrices finds which
    points may be among the k, these are scored as ``dot`` does it, and some k rows of each query leave a pair. Without
    ``on`` all pairs meet, so the work grows with points times queries; the memory of a task doesn't.
    """
    shared_folder(points.sparkSession)
    n, cores = points.count(), points.sparkSession.sparkContext.defaultParallelism
    block = min(POINT_BLOCK, max(256, -(-n // cores)))  # few points still make blocks for all cores
    # A row for each value of on: how many rows it has, and into how many blocks they are dealt.
    held, wanted = points.groupBy(*on).agg(F.count("*").alias("__n")), queries.groupBy(*on).agg(F.count("*").alias("__m"))
    sizes = (held.join(wanted, list(on)) if on else held.crossJoin(wanted)).withColumns({"__points": F.ceil(F.col("__n") / block), "__queries": F.ceil(F.col("__m") / QUERY_BLOCK)}).checkpoint(eager=True)
    met = sizes.agg(F.greatest(F.sum(F.col("__n") * F.col("__queries")), F.sum(F.col("__m") * F.col("__points")))).first()[0] or 0
    own = lambda key, blocks: F.pmod(F.xxhash64(key), blocks)
    each = lambda blocks: F.explode(F.when(F.col(blocks) > 0, F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    dealt = lambda rows: rows.join(F.broadcast(sizes), list(on)) if on else rows.crossJoin(F.broadcast(sizes))
    left = dealt(points.select(*on, key, vector)).select(*on, key, vector, own(key, "__points").alias("__point"), each("__queries").alias("__query"))
    right = dealt(queries.select(*on, "query_id", "q")).select(*on, "query_id", "q", own("query_id", "__queries").alias("__query"), each("__points").alias("__point"))
    by, tasks = [*on, "__point", "__query"], max(cores, -(-met // block))
    left, right = (rows.repartition(tasks, *by).groupBy(*by) for rows in (left, right))
    fields = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {points.schema[key].dataType.simpleString()}, score double"
    best = left.cogroup(right).applyInArrow(lambda some, asked: block_best(some, asked, k, vector, key, digits), fields)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return best.withColumn("score", F.round("score", digits)).withColumn("nth", nth).where(F.col("nth") <= k)


def payload_filter(points: DataFrame, doc_types: Sequence[str] = (), categories: Sequence[str] = (), participants: Sequence[str] = ()) -> DataFrame:
    """Type and category among the given, and all participants present; empty lists don't filter."""
    if doc_types:
        points = points.where(F.col("doc_type").isin(*doc_types))
    if categories:
        points = points.where(F.col("category").isin(*categories))
    for name in participants:
        points = points.where(F.array_contains("users", name))
    return points


def json_users(payload: Column) -> Column:
    """Users of a JSON payload: an array, or a single value as one; NULL for none or malformed JSON."""
    raw = F.get_json_object(payload, "$.users")
    return F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)))


def dedupe_hits(hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each doc_id: the best score (of equal ones the earliest) at the first position it was seen at."""
    best = F.max_by(F.struct(*columns), F.struct(F.col("score"), -F.col("ord"))).alias("best")
    kept = hits.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "").groupBy("doc_id").agg(F.min("ord").alias("ord"), best)
    return kept.select("doc_id", "ord", *[F.col(f"best.{c}").alias(c) for c in columns])


def overlap_bonus(text: Column, terms: Sequence[str]) -> tuple[Column, Column]:
    """Bonus for the first eight terms that the text holds (case-sensitive), and those terms."""
    held = F.slice(F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(text, t)), 1, 8)
    each = lambda t: F.when(F.length(t) <= 2, 0.02).when(F.length(t) <= 4, 0.05).otherwise(0.08)
    return F.least(F.lit(0.26), F.aggregate(held, F.lit(0.0), lambda acc, t: acc + each(t))), held


def rerank(hits: DataFrame, terms: Sequence[str], tuning: Tuning = Tuning(), digits: int = 9) -> DataFrame:
    """Adds rerank_score, matched_terms and why_matched to hits (doc_type, item_key, title, item_title, keyword_text, timeline_title, users, score, ord, recall_stage)."""
    if not tuning.rerank_enabled:
        return hits.withColumns({"rerank_score": F.col("score"), "matched_terms": F.array().cast("array<string>"), "why_matched": F.array(F.lit("vector_only"))})
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "item_title", "keyword_text")])
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_PRIORS.items() for x in p]), F.col("doc_type")), F.lit(0.0))
    bonus, held = overlap_bonus(text, terms)
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    within = lambda c: (F.coalesce(c, F.lit("")) != "") & F.exists(wanted, lambda t: F.contains(c, t))
    users = F.array_join(F.coalesce("users", F.array().cast("array<string>")), " ")
    in_users = (F.col("doc_type") != "item_title") & F.exists(wanted, lambda t: F.contains(users, t))
    same = F.count("*").over(Window.partitionBy("item_key"))
    multi = F.when(same > 1, F.least(F.lit(0.08), 0.02 * (same - 1))).otherwise(0.0)
    second = F.col("recall_stage") == "second_pass_atom"
    score = (
        F.col("score")
        + prior * tuning.type_prior_weight
        + bonus * tuning.overlap_weight
        + F.when(within(F.col("title")), 0.06).otherwise(0.0) * tuning.title_weight
        + F.when(within(F.col("timeline_title")), 0.08).otherwise(0.0) * tuning.timeline_title_weight
        + F.when(in_users, 0.05).otherwise(0.0) * tuning.participant_weight
        + multi * tuning.multi_hit_weight
        - F.when(second, 0.015).otherwise(0.0)
    )
    # Labels of the reasons; the bonuses above are fixed as well.
    reasons = F.array_compact(
        F.array(
            F.when(F.size(held) > 0, F.concat(F.lit("命中词: "), F.array_join(F.slice(held, 1, 4), ", "))),
            F.when(within(F.col("title")), F.lit("命中文档标题")),
            F.when(within(F.col("timeline_title")), F.lit("命中时间轴标题")),
            F.when(in_users, F.lit("命中参与者")),
            F.when(same > 1, F.format_string("同一期多处命中 (%d)", same)),
            F.when(second, F.lit("补充召回: 转录片段")),
        )
    )
    return hits.withColumns({"rerank_score": F.round(score, digits), "matched_terms": held, "why_matched": F.array_distinct(reasons)})


def diversify(hits: DataFrame, limit: int, per_item: int = 2, score: str = "rerank_score", enabled: bool = True) -> DataFrame:
    """Best hit of each item first, then the second best of each, until the limit; hits without an item are left out."""
    if not enabled:
        return hits.orderBy(F.desc(score), "ord").limit(limit)
    kept = hits.where(F.coalesce(F.col("item_key").cast("string"), F.lit("")) != "")
    nth = F.row_number().over(Window.partitionBy("item_key").orderBy(F.desc(score), "ord"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= per_item).orderBy("nth", F.desc(score), "ord").limit(limit)


def degrade_reason(error: object) -> str:
    """Why the lexical branch stands in for vectors: a used-up quota, or anything else."""
    text = str(error)
    spent = any(mark in text for mark in ("1113", "余额不足", "资源包已用完"))
    return "embedding_quota_exhausted" if spent else "semantic_recall_unavailable"


# Labels of what a result matched by.
DETAILS = {"keyword": "关键词", "semantic": "语义命中片段", "related": "相关片段"}
DETAIL = "struct<kind:string,label:string,terms:array<string>,text:string>"


def match_details(terms: Column, shown: Column) -> Column:
    """What a hit matched by: its first six terms, and a snippet."""
    named = F.array_distinct(F.filter(terms, lambda t: t != ""))
    none = F.lit(None)
    keyword = F.struct(F.lit("keyword").alias("kind"), F.lit(DETAILS["keyword"]).alias("label"), F.slice(named, 1, 6).alias("terms"), none.cast("string").alias("text"))
    label = F.when(F.size(named) > 0, DETAILS["related"]).otherwise(DETAILS["semantic"])
    snippet = F.struct(F.lit("semantic").alias("kind"), label.alias("label"), none.cast("array<string>").alias("terms"), shown.alias("text"))
    return F.array_compact(F.array(F.when(F.size(named) > 0, keyword), F.when(F.coalesce(shown, F.lit("")) != "", snippet))).cast(f"array<{DETAIL}>")


# How a result of each type is told of.
TOLD = {"timeline_note": "命中时间轴记录", "episode_card": "命中节目摘要", "scene_summary": "命中节目片段摘要", "evidence_atom": "命中原始转录片段", "item_title": "命中节目标题"}


def match_summary(doc_type: Column, terms: Column, shown_time: Column) -> Column:
    """A sentence on why a hit is shown."""
    told = F.try_element_at(F.create_map(*[F.lit(x) for p in TOLD.items() for x in p]), doc_type)
    place = F.when((F.coalesce(shown_time, F.lit("")) != "") & (doc_type != "item_title"), F.concat(F.lit("位置约在 "), shown_time))
    named = F.array(F.concat(F.lit("提到了 "), F.array_join(F.slice(terms, 1, 3), "、")), told, place)
    near = F.array(F.lit("语义命中"), F.lit("匹配到相近描述"), place)
    return F.array_join(F.array_compact(F.when(F.size(terms) > 0, named).otherwise(near)), "，")
