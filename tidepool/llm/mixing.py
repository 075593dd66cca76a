"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets a real number of copies, its source's target over its source's size. The whole part is taken; the
fractions are rounded in pairs: mass moves from one document to the other, weighed by their sizes and in the direction
that keeps expectations, until one fraction is 0 or 1. The other goes on to the next pair, so the words of a source
are kept exactly up to one last document. Pairs are met in groups of bounded size by a fold over an array; the one
residual of each group goes to the next level of a reduction tree, until a source has one group. All of it is
DataFrame expressions; directions are drawn from hashes, so reruns agree.

Rows that are equal in id, source and text are a unit. The whole part of what its rows take together is dealt to them;
only the fraction that is left, less than one document, is rounded, so a unit of many rows misses no target.

Sources stay a table of their own, however many there are: ranks come from a sort, and the level that the targets are
filled to is found by a few sums over that table.

Defined results: a null text has size 0 and its documents the copies that their source's fraction gives, taking 0
words; a null source is a source of its own, last; rows of a unit differ by one copy at most, which of them is not
defined; sources without words have target 0; an empty table gives no rows. Further columns are ignored by ``mix`` and
carried along by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.tables import bounded, dealt, distinct_rows, durable, row_keys

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CEILING = 1.5, 2.0
#: Documents that meet in one fold, on average.
GROUP = 128
EDGE = 1e-9


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds nth, from 0, in the order of code points with null last, without a sort in one task."""
    order = durable(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task of the sort
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.col("at") - F.shiftleft(F.col("part"), 33)
    return order.withColumn("part", part).join(bounded(durable(before.select("part", "before"))), "part").withColumn("nth", F.col("before") + inside).drop("at", "part", "before")


def source_targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(__source, source_size, target) of units (source, size, rows).

    The target of a source is the lesser of its ceiling and a level times its weight; the level is raised from the
    uncapped one until the targets sum up to the share, each round taking more sources as capped.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    held = durable(ranked(sizes).withColumn("weight", F.get(cycle, (F.col("nth") % len(weights)).cast("int"))))
    most = F.col("source_size") * F.lit(float(ceiling))
    total = share * (held.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = most < F.col("weight") * F.lit(level)
        r = held.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r["n"] == capped or not r["weight"]:
            break
        level, capped = max(0.0, total - ceiling * (r["full"] or 0)) / r["weight"], r["n"]
    return held.select(F.col("source").alias("__source"), "source_size", F.least(most, F.col("weight") * F.lit(level)).alias("target"))


#: Sorted by rank, larger documents come first, so that small ones are left to settle the last fraction.
UNIT = "struct<rank:bigint,draw:bigint,a:bigint,b:int,x:double>"


def _fold() -> str:
    """Decided units and the residual of an array of units, as a SQL expression over `units`.

    The state's `carry` is an array of no or one unit. For a carried unit p and a new unit q of sizes mp and mq, p gains
    d and q loses d * mp / mq, or the other way.
    """
    made = lambda u, x: f"named_struct('rank', {u}.rank, 'draw', {u}.draw, 'a', {u}.a, 'b', {u}.b, 'x', {x})"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    low, high = f"{EDGE}D", f"{1 - EDGE}D"
    # Up: p gains; down: p loses.
    gains = "named_struct('up', least(1D - p.x, q.x * mq / mp), 'down', least(p.x, (1D - q.x) * mq / mp))"
    towards = "if((pmod(xxhash64(p.draw, q.draw, seed), 1000003) / 1000003D) * (g.up + g.down) < g.down, g.up, -g.down)"
    settle = f"""if(y.p.x <= {low} or y.p.x >= {high},
        if(y.q.x <= {low} or y.q.x >= {high},
            named_struct('done', concat(acc.done, array(y.p, y.q)), 'carry', cast(array() as array<{UNIT}>)),
            named_struct('done', concat(acc.done, array(y.p)), 'carry', array(y.q))),
        named_struct('done', concat(acc.done, array(y.q)), 'carry', array(y.p)))"""
    moved = let(f"named_struct('p', {made('p', 'p.x + d')}, 'q', {made('q', 'q.x - d * mp / mq')})", "y", settle)
    met = let("double(-p.rank)", "mp", let("double(-q.rank)", "mq", let(gains, "g", let(towards, "d", moved))))
    return f"""aggregate(units,
        named_struct('done', cast(array() as array<{UNIT}>), 'carry', cast(array() as array<{UNIT}>)),
        (acc, q) -> if(size(acc.carry) = 0, named_struct('done', acc.done, 'carry', array(q)), {let('acc.carry[0]', 'p', met)}))"""


def by_source(rows: DataFrame, each: DataFrame) -> DataFrame:
    """Joins what ``each`` has for __source; adaptive execution splits a hot source where it isn't broadcast."""
    return rows.join(each, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def rounded(units: DataFrame, seed: int = 11) -> DataFrame:
    """(a, b, up) of units (source, sources, a, b, size, x): whether the fraction x of a unit is taken.

    ``sources`` is the number of units of the source. A group is dealt at the first level and divided by GROUP at each
    further one, so levels need no counts; only the largest number of groups comes to the driver.
    """
    fold = _fold().replace("seed", str(seed))
    taken = (F.col("x") >= 0.5).alias("up")
    settled = (F.col("x") <= EDGE) | (F.col("size") <= 0)
    whole = units.where(settled).select("a", "b", taken)
    groups = F.ceil(F.col("sources") / F.lit(GROUP)).cast("long")
    draw = F.xxhash64("a", "b", F.lit(seed))
    rest = durable(units.where(~settled).select("source", (-F.col("size")).alias("rank"), draw.alias("draw"), "a", "b", "x", F.pmod(draw, groups).alias("group"), groups.alias("groups")))
    most = rest.agg(F.max("groups")).first()[0] or 0
    while most:
        folded = durable(
            rest.groupBy("source", "groups", "group")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "draw", "a", "b", "x"))).alias("units"))  # GROUP units on average
            .select("source", "groups", "group", F.expr(fold).alias("r"))
        )
        whole = whole.unionByName(folded.select(F.explode("r.done").alias("u")).select("u.a", "u.b", (F.col("u.x") >= 0.5).alias("up")))
        left = folded.select("source", "groups", "group", F.explode("r.carry").alias("u")).select("source", "u.*", "groups", "group")
        if most == 1:  # one residual of each source at most
            return whole.unionByName(left.select("a", "b", taken))
        rest = left.withColumn("group", F.floor(F.col("group") / GROUP).cast("long")).withColumn("groups", F.ceil(F.col("groups") / GROUP).cast("long"))
        most = -(-most // GROUP)
    return whole


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 11, columns: tuple[str, ...] = ("doc_id", "source", "text")) -> DataFrame:
    """(doc_id, source, size, a, b, source_size, target, rows, whole, extra): a row for each unit of docs (doc_id, text, source).

    Each row of a unit is taken ``whole`` times, and ``extra`` of its rows once more. Units are rows equal in ``columns``.
    """
    a, b = row_keys(docs, list(columns))
    keyed = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), a.alias("a"), b.alias("b"))
    units = durable(keyed.groupBy("doc_id", "source", "size", "a", "b").agg(F.count("*").alias("rows")))
    goal = durable(source_targets(units, weights, share, ceiling).join(units.groupBy(F.col("source").alias("named")).agg(F.count("*").alias("sources")), F.col("__source").eqNullSafe(F.col("named"))).drop("named"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    split = by_source(units, bounded(goal)).withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + EDGE).cast("long"))
    split = split.withColumn("together", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")) * F.col("rows"))
    split = durable(split.withColumn("sure", F.floor(F.col("together") + EDGE).cast("long")).withColumn("x", F.greatest(F.lit(0.0), F.col("together") - F.col("sure"))))
    up = rounded(split.select("source", "sources", "a", "b", "size", "x"), seed)
    out = split.drop("sources", "rate", "together", "x").join(up, ["a", "b"])
    return out.withColumn("extra", F.col("sure") + F.col("up").cast("long")).drop("sure", "up")


def copies(docs: DataFrame) -> DataFrame:
    """``mix`` with a row for each row of docs: (doc_id, source, size, source_size, target, copies)."""
    units = durable(mix(docs))
    each = dealt(units, F.col("rows"), "__nth", ["a", "b"], units)
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.when(F.col("__nth") <= F.col("extra"), 1).otherwise(0)).alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 11) -> DataFrame:
    """Docs with each row as often as the mix takes it; whole rows travel once, equal ones together."""
    plan = mix(docs, weights, share, ceiling, seed, tuple(docs.columns))
    times = durable(plan.select(F.col("a").alias("__a"), F.col("b").alias("__b"), (F.col("whole") * F.col("rows") + F.col("extra")).alias("__times")).where("__times > 0"))
    rows = distinct_rows(docs).join(times, ["__a", "__b"])
    return dealt(rows, F.col("__times"), "__nth", ["__a", "__b"], times).select(*[F.col(f"`{c}`") for c in docs.columns])
