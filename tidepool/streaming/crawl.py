"""Incremental reading of a paged list, newest first: page watermarks, refreshed pages, early stop, resumable backfill.

Pages are a table (page, nth, item_id, published_at), read from a source in blocks; what each pass does is worked out by
joins and aggregates over a block, so only its stopping page and the watermark come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import shared_folder
from tidepool.streaming.incremental import before_mark

#: Reads pages from the first number up to the second.
Pages = Callable[[int, int], DataFrame]


@dataclass(frozen=True)
class Mark:
    published_at: str
    #: Those at that time that were seen: one page's, or a DataFrame (item_id) of any number.
    item_ids: tuple[str, ...] | DataFrame


def numbered(rows: DataFrame, *order: Column, at: str = "at") -> DataFrame:
    """Rows with their place in the order, from 0: ranges are sorted apart and begin behind the counts of those before them."""
    shared_folder(rows.sparkSession)
    inside = rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("__id", 33)
    sizes = inside.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.withColumn("__before", before).drop("__n"))
    return inside.withColumn("__part", part).join(starts, "__part").withColumn(at, F.col("__before") + F.col("__id") - F.shiftleft("__part", 33)).drop("__id", "__part", "__before")


def page_mark(pages: DataFrame) -> Mark | None:
    """The first item's time on the first page that has items, and the ids of the run of items that share it."""
    top = pages.where(F.col("page") == pages.agg(F.min("page")).first()[0])  # one page
    order = Window.orderBy("nth")
    first = F.first("published_at").over(order)
    other = F.sum(F.when(F.col("published_at").eqNullSafe(first), 0).otherwise(1)).over(order)
    run = top.withColumn("__other", other).where("__other = 0").orderBy("nth").select("item_id", "published_at").collect()
    if not run or not run[0]["published_at"]:
        return None
    return Mark(run[0]["published_at"], tuple(str(r["item_id"]) for r in run))


def decided(pages: DataFrame, known: DataFrame, mark: Mark | None, refresh_pages: int) -> DataFrame:
    """Adds known, before (at or before the mark) and fetch to the rows of pages."""
    seen = known.select("item_id").distinct().withColumn("known", F.lit(True))
    rows = pages.join(seen, "item_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    ties = mark.item_ids if mark else ()
    if isinstance(ties, DataFrame):
        rows, ties = rows.join(ties.select("item_id").distinct().withColumn("__tied", F.lit(True)), "item_id", "left"), F.coalesce("__tied", F.lit(False))
    rows = rows.withColumn("before", before_mark(F.col("published_at"), F.col("item_id"), mark and mark.published_at, ties)).drop("__tied")
    return rows.withColumn("fetch", ~F.col("known") | (F.col("page") < refresh_pages) | ~F.col("before"))


def stopping_page(rows: DataFrame, mark: Mark | None, refresh_pages: int) -> int | None:
    """The first page behind the refreshed ones on which all is known and before the mark."""
    if mark is None:
        return None
    stale = rows.where(F.col("page") >= refresh_pages).groupBy("page").agg(F.bool_and(F.col("known") & F.col("before")).alias("stale"))
    return stale.where("stale").agg(F.min("page")).first()[0]


def sync_latest(pages: Pages, known: DataFrame, mark: Mark | None, refresh_pages: int = 1, most_pages: int | None = None, block: int = 16) -> tuple[DataFrame, Mark | None]:
    """(item_id, published_at, page, known, before, fetch) of the pages that are visited, and the mark to go on from.

    Pages are read in blocks, each twice as long as the one before, until one is stale or empty; nothing behind the stale
    page is visited. What is known, the mark's ties and each block's rows are worked out once and stored.
    """
    shared_folder(known.sparkSession)
    known = known.select("item_id").distinct().checkpoint(eager=True)
    if mark is not None and isinstance(mark.item_ids, DataFrame):
        mark = Mark(mark.published_at, mark.item_ids.select("item_id").distinct().checkpoint(eager=True))
    out, at, new = None, 0, None
    while most_pages is None or at < most_pages:
        to = at + block if most_pages is None else min(most_pages, at + block)
        rows = decided(pages(at, to), known, mark, refresh_pages).checkpoint(eager=True)
        if rows.isEmpty():
            break
        new = new or page_mark(rows)
        stop = stopping_page(rows, mark, refresh_pages)
        rows = rows if stop is None else rows.where(F.col("page") <= stop)
        out = rows if out is None else out.unionByName(rows)
        if stop is not None:
            break
        at, block = to, 2 * block
    if out is None:
        out = decided(pages(0, 0), known, mark, refresh_pages)
    return out.select("item_id", "published_at", "page", "known", "before", "fetch"), new or mark


def backfill(pages: Pages, known: DataFrame, cursor: int, most_pages: int) -> tuple[DataFrame, int, Mark | None]:
    """Unknown items of the next pages from a cursor, the cursor to resume from, and the first page's mark if it starts there."""
    rows = pages(cursor, cursor + most_pages)
    last = rows.agg(F.max("page")).first()[0]
    fresh = rows.join(known.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "published_at", "page")
    return fresh, cursor if last is None else int(last) + 1, page_mark(rows) if cursor == 0 and last is not None else None


def recent(log: Sequence[dict], entry: dict, most: int = 50) -> list[dict]:
    """A log's last entries, with one more."""
    return [*log, entry][-most:]
