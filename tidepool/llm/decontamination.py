"""Benchmark decontamination by a positional inverted index.

Benchmark items are cut into windows of consecutive words. Words are counted over all documents, and a window is sought
by its RAREST terms: the rarest is its anchor, the next ones follow unless their lists are more than LONGER times the
anchor's. The index stores the postings (document, term, position) of all terms that are sought, nothing else of the
texts. The anchors' postings, moved by their offsets, are the candidates; they are intersected with the next terms'
postings. Where all of these stand at their own offsets the window may stand there, and its words are compared with the
document's: exact phrase matches. Where they stand within the window's length around the anchor, in any order, the match
is one of proximity.

All of it is DataFrame expressions. Texts are never shuffled while the sought terms, windows and candidates stay under
the bound of a broadcast, each checked by a count; beyond it the same joins are shuffled ones, of narrow rows but for
one, which moves each text once to the places that are asked of it; what goes on to the windows are some words for each. Counts are summed in each task before they travel.

Defined results: null and empty texts have no words, no hit and no items, and are not contaminated; null and wordless
items have no window; items repeated under one id count once, equal texts under different ids count each; repeated
rows of documents give a row each; empty tables give no rows, or no hits. Further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.tables import bounded, durable

WINDOW_WORDS = 13
#: A document is contaminated where hit words times this reach its words.
HIT_SHARE = 20
#: Terms of a window whose lists are intersected, and the times a further list may be longer than the anchor's.
RAREST, LONGER = 3, 16
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    held = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(held) == F.length(held), F.lower(held)).otherwise(F.translate(held, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BREAKS), "")


def windows_of(benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(window, terms): the distinct windows of all items, numbered, a shorter item being one; and (item_id, window)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("terms")).distinct()
    windows = durable(cut.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()))
    return windows, durable(cut.join(windows, "terms").select("item_id", "window"))


def key_of() -> list[Column]:
    """Hashes of a row's id and text; rows with the same id and text share their matches. Never null."""
    return [F.xxhash64("doc_id").alias("id_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]


KEY = ["id_key", "text_key"]


def sought(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, anchor, at, rest): each window with its rarest term, and the next as (term, offset from the anchor)."""
    vocabulary = durable(windows.select(F.explode("terms").alias("term")).distinct())
    every = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    counted = lambda rows: rows.groupBy("term").agg(F.count("*").alias("n"))
    few = bounded(vocabulary)
    # A small vocabulary filters words where they are read; a large one meets their counts.
    counts = durable(counted(every.join(few, "term")) if few is not vocabulary else counted(every).join(vocabulary, "term"))
    placed = windows.select("window", F.posexplode("terms").alias("at", "term")).join(bounded(counts), "term", "left")
    rank = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "at")
    rarest = placed.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= RAREST)
    lists = rarest.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "at", "n"))).alias("r"))
    # A window with a term that no document has stands nowhere.
    lists = lists.where(F.col("r")[0]["n"] > 0)
    first = F.col("r")[0]
    rest = F.transform(F.filter(F.slice("r", 2, RAREST), lambda r: r["n"] <= LONGER * first["n"]), lambda r: F.struct(r["term"].alias("term"), (r["at"] - first["at"]).alias("step")))
    return lists.select("window", first["term"].alias("anchor"), first["at"].alias("at"), rest.alias("rest"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id_key, text_key, term, pos): postings of the terms, each once."""
    words = docs.select(*key_of(), F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return words.join(bounded(terms), "term").select(*KEY, "term", "pos").distinct()


def intersected(postings: DataFrame, plan: DataFrame, n: int, proximity: bool = True) -> DataFrame:
    """(id_key, text_key, window, start, aligned, near): candidates and which intersections they pass.

    Without proximity the next terms' postings are met at their offsets only. With it positions are met in blocks of n,
    each candidate looking into the block of its anchor and the two beside it.
    """
    anchors = postings.join(bounded(plan), postings["term"] == plan["anchor"])
    found = anchors.select(*KEY, "window", "pos", (F.col("pos") - F.col("at")).alias("start"), "rest").where("start >= 0")
    alone = found.where(F.size("rest") == 0).select(*KEY, "window", "start", F.lit(True).alias("aligned"), F.lit(False).alias("near"))
    asked = found.where(F.size("rest") > 0).select(*KEY, "window", "start", F.col("pos").alias("by"), F.size("rest").alias("lists"), F.posexplode("rest").alias("nth", "r")).select("*", "r.term", "r.step").drop("r")
    if proximity:
        block = lambda c: F.floor(c / F.lit(n)).cast("long")
        beside = asked.withColumn("block", F.explode(F.array(*[block(F.col("by")) + k for k in (-1, 0, 1)])))
        met = beside.join(postings.withColumn("block", block(F.col("pos"))), [*KEY, "term", "block"]).where(F.abs(F.col("pos") - F.col("by")) < n)
    else:
        met = asked.withColumn("pos", F.col("by") + F.col("step")).join(postings, [*KEY, "term", "pos"])
    bit = lambda hit: F.bit_or(F.when(hit, F.expr("shiftleft(1, nth)")).otherwise(0))
    masks = met.groupBy(*KEY, "window", "start", "lists").agg(bit(F.col("pos") == F.col("by") + F.col("step")).alias("at_steps"), bit(F.lit(True)).alias("around"))
    full = F.expr("shiftleft(1, lists) - 1")
    passed = masks.where(F.col("around") == full).select(*KEY, "window", "start", (F.col("at_steps") == full).alias("aligned"), F.lit(proximity).alias("near"))
    return alone.unionByName(passed)


def verified(docs: DataFrame, asked: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(id_key, text_key, window, start, words) of the places asked for (id_key, text_key, window, start) where a window's words stand.

    A text meets the places that are asked of it, each once, and gives n words for each; these meet the windows.
    """
    places = asked.groupBy(*KEY).agg(F.collect_set("start").alias("starts"))  # a text's positions at most
    words = docs.select(*key_of(), words_of(F.col("text")).alias("w"))
    cut = F.transform("starts", lambda i: F.struct(i.alias("start"), F.slice("w", i + 1, F.lit(n)).alias("piece")))
    pieces = words.join(bounded(places), KEY).select(*KEY, F.explode(cut).alias("p")).select(*KEY, "p.start", "p.piece")
    held = pieces.join(bounded(asked), [*KEY, "start"]).join(bounded(windows), "window")
    exact = held.where(F.slice("piece", F.lit(1), F.size("terms")) == F.col("terms"))
    return exact.select(*KEY, "window", "start", F.size("terms").alias("words")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, proximity: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact matches (id_key, text_key, window, start, words), those of proximity (id_key, text_key, window, start), and (item_id, window)."""
    windows, items = windows_of(benchmark, n)
    plan = durable(sought(docs, windows))
    terms = plan.select(F.explode(F.concat(F.array("anchor"), F.col("rest.term"))).alias("term")).distinct()
    candidates = durable(intersected(durable(index(docs, durable(terms))), plan, n, proximity))
    asked = durable(candidates.where("aligned").select(*KEY, "window", "start"))
    exact = durable(verified(docs, asked, windows, n))
    return exact, candidates.where("near").select(*KEY, "window", "start"), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, proximity: bool = True) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, n_near) for each row of docs (doc_id, text).

    n_near: items with a match of proximity, exact ones among them; 0 where these aren't asked for.
    """
    exact, near, of_items = matches(docs, benchmark, n, proximity)
    spans = exact.select(*KEY, "start", (F.col("start") + F.col("words")).alias("end")).distinct()
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        spans.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy(*KEY)
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("n_hit"))
    )
    named = bounded(of_items)
    items = lambda rows: rows.select(*KEY, "window").distinct().join(named, "window").groupBy(*KEY)
    listed = items(exact).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))  # item ids of the benchmark at most
    close = items(near).agg(F.count_distinct("item_id").alias("n_near"))
    hits = durable(covered.join(listed, KEY).join(close, KEY, "full"))
    base = docs.select("doc_id", *key_of(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(bounded(hits), KEY, "left").withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>")), "n_near": F.coalesce("n_near", F.lit(0)).cast("long")}
    )
    contaminated = (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", *KEY, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", contaminated.alias("contaminated"), "n_near")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """Docs without the contaminated rows."""
    found = decontaminate(docs, benchmark, n, proximity=False).where("contaminated")
    bad = durable(found.select(F.col("id_key").alias("__bad_id"), F.col("text_key").alias("__bad_text")).distinct())
    keyed = docs.withColumns(dict(zip(("__id", "__text"), key_of(), strict=True)))
    return keyed.join(bounded(bad), (F.col("__id") == F.col("__bad_id")) & (F.col("__text") == F.col("__bad_text")), "left_anti").drop("__id", "__text")
