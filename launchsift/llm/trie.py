"""The trie of conversation prefixes, rolled up in bands of depth.

Every conversation is a path from the textless root; two conversations share the nodes of
their common beginning.  A node is named by its smallest member and its depth.  Values are
summed over subtrees in bands of fixed height: inside a band a node reaches only the ancestors
of that band, and the totals of the nodes on top of the bands, completed the same way on their
own smaller tree, are then handed to the ancestors in the band above.  A path of depth d thus
takes log d rounds, and each round makes at most one row a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import packed, written
from launchsift.llm.inorder import digests, pieces
from launchsift.llm.shards import numbered

#: Depths of a band.
HEIGHT = 16
#: Steps of a path whose keys are summed in one window.
CELL = 1024
#: Turns taken over from another conversation are fewer than this; fixed by ``rebuild``.
LEADS = 9


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, one, two, bytes): the turns of every conversation, places from 1.

    Turns are ordered with nulls first, equal ones by role and text hash; null roles and texts
    are empty.  ``one`` and ``two`` are hashes of role and text, ``bytes`` the text's UTF-8
    length.  Rows without conv_id belong to no conversation.  Ranges of the order are numbered
    in parallel, so the turns of one conversation need not meet in a task.
    """
    role, text = F.coalesce("row.role", F.lit("")), F.coalesce("row.text", F.lit(""))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = packed(conversations).filter("row.conv_id is not null").select(
        F.col("row.conv_id").cast("long").alias("conv_id"),
        F.col("row.turn").isNotNull().alias("known"),
        F.col("row.turn").alias("turn"),
        said.alias("said"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["known", "turn", "said"]
    ranged = written(
        rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-turns"
    )
    return numbered(ranged, "conv_id", "part", order, "place").select(
        "conv_id",
        (F.col("place") + 1).alias("place"),
        F.xxhash64("said", F.lit(1)).alias("one"),
        F.xxhash64("said", F.lit(2)).alias("two"),
        "bytes",
    )


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with length, steps) of the conversations rebuilt on the beginnings of others.

    Conversation c begins with the first h turns of c - c % 5 (all if it has fewer, none if it
    does not exist), h = crc32(c) % 9, and goes on with its own turns after its first h.
    """
    lead = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LEADS))
    lengths = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "trie-lengths")
    base = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("offered"))
    ids = lengths.withColumns({"h": lead, "base": F.col("conv_id") - F.col("conv_id") % 5}).join(base, "base", "left")
    taken = F.least("h", F.coalesce("offered", F.lit(0)))
    ids = ids.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    ids = written(ids, "trie-ids")
    # At most eight turns of a conversation go to at most five others.
    given = turns.filter(F.col("place") < LEADS).withColumnRenamed("conv_id", "base")
    first = ids.join(given, "base").filter("place <= taken").select("conv_id", F.col("place").alias("depth"), "one", "two", "bytes")
    rest = turns.withColumn("h", lead).filter(F.col("place") > F.col("h")).drop("h").join(ids, "conv_id").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "one", "two", "bytes"
    )
    return ids.select("conv_id", "length"), first.unionByName(rest)


def prefix_keys(ids: DataFrame, steps: DataFrame) -> DataFrame:
    """``steps`` with depth 0 added and ``one``, ``two`` replaced by keys of the whole prefix.

    A key is the exclusive or of 64-bit hashes of (step, depth); there are two.  Cells of a
    path are summed side by side and what precedes a cell comes from one row a cell.
    """
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("one", "two", "bytes")])
    rows = steps.select(
        "conv_id", "depth", F.xxhash64("one", "depth").alias("one"), F.xxhash64("two", "depth").alias("two"), "bytes"
    ).unionByName(root).withColumn("cell", F.floor(F.col("depth") / CELL).cast("long"))
    rows = written(rows, "trie-steps")
    cells = rows.groupBy("conv_id", "cell").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
    before = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(name: str) -> Column:
        return F.coalesce(F.bit_xor(name).over(before), F.lit(0))

    far = cells.select("conv_id", "cell", ahead("one").alias("far_one"), ahead("two").alias("far_two"))
    inside = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(far, ["conv_id", "cell"]).select(
        "conv_id",
        "depth",
        F.bit_xor("one").over(inside).bitwiseXOR(F.col("far_one")).alias("one"),
        F.bit_xor("two").over(inside).bitwiseXOR(F.col("far_two")).alias("two"),
        "bytes",
    )


def subtree_sums(paths: DataFrame, weights: DataFrame, names: list[str], height: int = HEIGHT) -> DataFrame:
    """(conv_id, depth, *names): the weights of every node summed over its subtree.

    ``paths`` (conv_id, depth, node) says for each step of a conversation which member names
    its node; ``weights`` (conv_id, depth, *names) has a row a node.
    """
    at = ["conv_id", "depth"]
    own = paths.join(weights, at, "left").withColumn("band", F.floor(F.col("depth") / height).cast("long"))
    # Only a node's namesake carries its weight; each step gets what stands at or below it in its band.
    below = Window.partitionBy("conv_id", "band").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("conv_id") == F.col("node")
    reached = own.select(
        F.col("node"), "depth", *[F.sum(F.when(mine, F.col(n))).over(below).alias(n) for n in names]
    ).filter(F.col(names[0]).isNotNull())
    near = reached.groupBy("node", "depth").agg(*[F.sum(n).alias(n) for n in names]).select(F.col("node").alias("conv_id"), "depth", *names)
    near = written(near, "trie-bands")
    if paths.filter(F.col("depth") >= height).isEmpty():
        return near
    tops = F.col("depth") % height == 0
    higher = (F.col("depth") / height).cast("long").alias("depth")
    totals = subtree_sums(
        written(paths.filter(tops).select("conv_id", higher, "node"), "trie-tops"),
        near.filter(tops).select("conv_id", higher, *names),
        names, height,
    )
    handed = totals.filter("depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), *names)
    far = (
        paths.withColumn("band", F.floor(F.col("depth") / height).cast("long"))
        .join(handed, ["conv_id", "band"])
        .select(F.col("node").alias("conv_id"), "depth", *names)
    )
    both = near.unionByName(far).groupBy(*at).agg(*[F.sum(n).alias(n) for n in names])
    return written(both, "trie-totals")


def prefix_trie(ids: DataFrame, steps: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``ids`` has conv_id and length of every conversation, ``steps`` its (depth, one, two, bytes)
    with depths from 1.  Equal conversations share all nodes.  Without conversations there is
    no node, not even the root; a conversation without steps is a member of the root alone.
    """
    rows = written(prefix_keys(ids, steps), "trie-keys")
    key = ["depth", "one", "two"]
    nodes = rows.groupBy(*key).agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes")
    )
    nodes = written(nodes, "trie-nodes")
    # A common prefix is a key of many rows; adaptive execution splits them.
    paths = written(rows.join(nodes.select(*key, "node"), key).select("conv_id", "depth", "node"), "trie-paths")
    at = ["conv_id", "depth"]
    # A conversation names its nodes from some depth on: from there it is its own parent.
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    named = nodes.select(F.col("node").alias("conv_id"), "depth", "n_convs", "bytes").join(above, at, "left")
    named = written(named, "trie-named")
    children = named.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    counted = written(
        named.join(children, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children"
    )
    weights = counted.select(
        *at,
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    sums = subtree_sums(paths, weights, ["n_leaves", "saved_tokens"], height)
    ends = paths.join(ids.select("conv_id", F.col("length").alias("depth")), at).select(
        "node", "depth", F.col("conv_id").alias("member"), F.col("conv_id").cast("string").alias("shown")
    )
    ended = digests(pieces(ends, ["node", "depth"], ["member"], "shown", ","), ["node", "depth"], ",", "ends_sha256")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return (
        counted.join(sums, at)
        .join(ended.withColumnRenamed("node", "conv_id"), at, "left")
        .select(
            *at, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
