"""The trie of conversations' common beginnings, by partition refinement.

All conversations are one class at first, the root. Turn by turn each class splits by what its members say next; a
class is a node, named by its depth and its smallest member. Turns are taken in blocks of FIRST, then twice as many, up
to MOST: within a block a class splits at each turn by the keys of the turns since the block began, so a block is one
grouping. After a block only classes of two members and more, with turns left, go on; a class of one member is retired,
and the rest of its turns is a chain of nodes with one child each, which needs no grouping. Then the blocks are folded back
from the last to the first: each node's leaves and saved tokens are written to its smallest member's turn, summed from
the last turn up to the first of a block, and added for all members of a node.

Turns are numbered by ranges, so a long conversation stands in several tasks; only keys (128 bits of role and text) and
sizes are grouped, summed in each task first, so a hot first turn or a much-copied conversation is no hot spot.
Conversations of few different turns make few rounds: their number grows with the logarithm of the longest beginning that
two conversations share, up to MOST turns, then by one for each MOST turns.

Defined results: null role or text is empty; turns of equal number go by role, then text; rows without conv_id belong to
no conversation; repeated rows are turns of their own; a conversation whose rebuilt turns are none ends at the root; an
empty table gives no rows; further columns are ignored. Negative ids keep the sign in c % 5, as SQL has it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.streams import digests, in_order
from tidepool.llm.tables import dropped, durable, place, stored

FIRST, MOST = 16, 4096
#: Conversations in a row that share a beginning, and the longest that they share.
SHARED, LONGEST = 5, 8
#: SHA-256 of nothing.
NOBODY = hashlib.sha256().hexdigest()


def lent(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its row."""
    return F.crc32(conv_id.cast("string")) % (LONGEST + 1)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, bytes): turns by number from 1, with the keys of role and text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.rand(17).alias("salt")
    )  # equal rows may stand in any order: the salt deals many of them to several tasks
    narrow = in_order(rows, "conv_id", "turn", "role", "text", "salt").select(
        "conv_id", "part", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), "role", "text").alias("k2"), F.octet_length("text").cast("long").alias("bytes")
    )
    kept = durable(narrow)
    begun = kept.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task at most
    begun = begun.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return kept.join(begun, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") - F.col("start") + 1).alias("pos"), "k1", "k2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after each conversation took the beginning of the first of its row, and (conv_id, length) of all."""
    lengths = durable(turns.groupBy("conv_id").agg(F.max("pos").alias("own")))
    first = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    heads = lengths.withColumn("h", lent(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).join(first, "base", "left")
    heads = durable(heads.select("conv_id", "base", "h", F.least("h", F.coalesce("of_base", F.lit(0))).alias("head"), F.greatest(F.lit(0), F.col("own") - F.col("h")).alias("tail")))
    # A beginning that falls short of h moves the own turns forward.
    short = heads.where("head < h and tail > 0").select("conv_id", (F.col("h") - F.col("head")).alias("gap"))
    own = turns.where(F.col("pos") > lent(F.col("conv_id"))).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "k1", "k2", "bytes")
    given = turns.where((F.col("pos") <= LONGEST) & (F.col("conv_id") % SHARED == 0)).withColumnRenamed("conv_id", "base")
    taken = given.join(heads.where("head > 0").select("conv_id", "base", "head"), "base").where("pos <= head").select("conv_id", "pos", "k1", "k2", "bytes")
    return own.unionByName(taken), heads.select("conv_id", (F.col("head") + F.col("tail")).alias("length"))


def refined(block: DataFrame) -> DataFrame:
    """Members of a block's nodes: block rows (conv_id, class, length, pos, k1, k2, bytes) with node, n, deepest, parent."""
    spark = block.sparkSession
    along = Window.partitionBy("conv_id").orderBy("pos")  # a block's turns at most
    keyed = block.select(
        "conv_id", "class", "length", "pos", "bytes", F.bit_xor(F.xxhash64("pos", "k1")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("r1"),
        F.bit_xor(F.xxhash64("pos", "k2")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("r2"),
    )
    key = ["class", "pos", "r1", "r2"]
    # As a table, so that the join deals out both sides anew and can split a hot class.
    at = place(spark)
    classes = stored(keyed.groupBy(*key).agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("length").alias("deepest")), at)
    members = durable(keyed.join(classes, key).drop("r1", "r2"))
    dropped(spark, at)
    return members.withColumn("parent", F.lag("node").over(along)).withColumn("parent", F.coalesce("parent", "class"))


def folded(members: DataFrame, after: DataFrame) -> DataFrame:
    """Members with the leaves and saved tokens that their conversation stands for from each turn on.

    ``after`` has what conversations bring from beyond the block: (conv_id, leaves, saved).
    """
    own = F.col("conv_id") == F.col("node")
    here = members.withColumn("leaves", F.when(own & (F.col("deepest") == F.col("pos")), 1).otherwise(0).cast("long")).withColumn("saved", F.when(own, (F.col("n") - 1) * F.col("bytes")).otherwise(0).cast("long"))
    upward = Window.partitionBy("conv_id").orderBy(F.col("pos").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = here.unionByName(after, allowMissingColumns=True)  # what comes after has no pos
    return both.withColumn("leaves", F.sum("leaves").over(upward)).withColumn("saved", F.sum("saved").over(upward)).where("pos is not null")


def prefix_trie(conversations: DataFrame, first: int = FIRST, most: int = MOST) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns, lengths = rebuilt(durable(numbered(conversations)))
    turns, lengths = durable(turns), durable(lengths)
    every = lengths.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    if not every["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    active = lengths.where("length > 0").withColumn("class", F.lit(every["root"]).cast("long"))
    blocks: list[DataFrame] = []
    edges: list[DataFrame] = []
    done, size = 0, first
    while not active.isEmpty():
        members = durable(refined(turns.where(F.col("pos").between(done + 1, done + size)).join(active, "conv_id")))
        blocks.append(members)
        done, size = done + size, min(2 * size, most)
        edges.append(members.where((F.col("pos") == done) & (F.col("length") > done)))
        active = edges[-1].where("n > 1").select("conv_id", F.col("node").alias("class"), "length")
    nothing = lengths.limit(0)
    carried = nothing.select("conv_id", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    summed: list[DataFrame] = []
    began = done
    for k, members in reversed(list(enumerate(blocks))):
        alone = edges[k].where("n = 1").select("conv_id", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        sums = folded(members, carried.unionByName(alone))
        size = min(first << k, most)
        began -= size
        if k:
            sums = durable(sums)
            carried = sums.where(F.col("pos") == began + 1).select("conv_id", "leaves", "saved")
        summed.append(
            sums.groupBy("node", "pos").agg(
                F.min("parent").alias("parent"), F.first("n").alias("n"), F.max("deepest").alias("deepest"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if(F.col("length") == F.col("pos")).alias("ending")
            )
        )
    root = lengths.agg(F.lit(every["root"]).cast("long").alias("node"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n"), F.max("length").alias("deepest"), F.count_if(F.col("length") == 0).alias("ending"))
    shared = nothing.select(*[F.lit(None).cast("long").alias(c) for c in ("node", "pos", "parent", "n", "deepest", "leaves", "saved", "ending")])
    for part in summed:
        shared = shared.unionByName(part)
    shared = durable(shared)
    top = shared.where("pos = 1").agg(F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
    root = root.withColumns({c: F.lit(top[c]).cast("long") for c in ("leaves", "saved")})
    nodes = shared.unionByName(root)
    children = shared.groupBy(F.col("parent").alias("node"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("children"))
    ends = [m.where("length = pos and n > 1").select("node", "pos", "conv_id") for m in blocks]
    ended = lengths.where("length = 0").select(F.lit(every["root"]).cast("long").alias("node"), F.lit(0).cast("long").alias("pos"), "conv_id")
    for part in ends:
        ended = ended.unionByName(part)
    whole = nodes.join(children, ["node", "pos"], "left").join(digests(ended, "node", "pos", "conv_id"), ["node", "pos"], "left")
    alone = F.sha2(F.col("node").cast("string"), 256)
    out = whole.select(
        F.col("node").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("children", (F.col("deepest") > F.col("pos")).cast("long")).alias("n_children"),  # a retired node has one
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(F.col("ending") == 0, F.lit(NOBODY)).otherwise(F.coalesce("digest", alone)).alias("ends_sha256"),
    )
    retired = nothing.select("conv_id", "length", F.lit(None).cast("long").alias("from"))
    for edge in edges:
        retired = retired.unionByName(edge.where("n = 1").select("conv_id", "length", F.col("pos").alias("from")))
    one = F.lit(1).cast("long")
    last = F.col("pos") == F.col("length")
    chains = turns.join(retired, "conv_id").where(F.col("pos") > F.col("from")).select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )
    return out.unionByName(chains)
