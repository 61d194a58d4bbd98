"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch retains the k
lowest.  Documents with equal sets are one class.  Inverted lists of retained values, of
each sketch's rarest ones only, propose pairs; the union sketch estimates their similarity
and the full sets decide.  In a long list the members meet hubs first, so that groups of
copies join without all their pairs.  Of the members that are still in different components,
those that share too few hashes with other components to be similar to any of them are done;
the rest are compared with their group in tiles, which return links and no other pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import packed, released, small_or_shuffled, text_key, unpacked, written
from launchsift.llm.components import components

#: Retained values of a sketch.
SKETCH = 64
#: Chance with which a pair right at the threshold may share fewer retained values than assumed.
LOST = 1e-9
#: Hashes on one side of a tile when the members of a group that are still apart meet.
TILE = 100_000
#: Columns of a tile's incidence matrix that are multiplied at once.
COLUMNS = 4096
#: Words remembered with their hash by one worker.
REMEMBERED = 150_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_hashes(text: str | None, size: int, known: dict | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles of a whole text.

    A-Z are lower-cased; words end at ASCII white space.  Fewer words form one shingle; a
    text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    known = _WordHashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * _ODD[k % 4]
        mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[0]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], size: int):
    known = _WordHashes()
    for batch in released(batches):
        at = list(zip(*[batch.column(c).to_pylist() for c in batch.schema.names if c != "text"], strict=True))
        for keys, text in zip(at, batch.column("text"), strict=True):
            if len(known) > REMEMBERED:
                known.clear()
            yield keys, shingle_hashes(text.as_py(), size, known)


def _blocks(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types, strict=True)], schema=schema)


def sketches(docs: DataFrame, size: int, k: int = SKETCH) -> DataFrame:
    """(doc_id, key, n, set, sketch): set size, a 128-bit name of the set, the k lowest hashes.

    Both are null for a document without words.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([
            ("doc_id", first.schema.field("doc_id").type), ("key", pa.int64()), ("n", pa.int64()),
            ("set", pa.binary()), ("sketch", pa.list_(pa.int64())),
        ])

        def made():
            for (doc, key), h in _texts(_again(first, batches), size):
                if len(h):
                    yield doc, key, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), h[:k].copy()
                else:
                    yield doc, key, 0, None, None

        yield from _blocks(made(), schema)

    return rows.mapInArrow(run, f"doc_id {kind}, key long, n long, set binary, sketch array<long>")


def _again(first, rest):
    yield first
    yield from rest


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(v, hashes): the whole set of each class in ``wanted`` (w_id, w_key, v)."""
    rows = (
        docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")))
        .select("v", "text")
    )

    def run(batches):
        schema = pa.schema([("v", pa.binary()), ("hashes", pa.list_(pa.int64()))])
        yield from _blocks(((v, h) for (v,), h in _texts(batches, size)), schema, 200)

    return rows.mapInArrow(run, "v binary, hashes array<long>").dropDuplicates(["v"])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets."""

    def run(batches):
        for batch in released(batches):
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("v").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("v").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def least_shared(percent: int, k: int = SKETCH, lost: float = LOST) -> int:
    """Retained values that two similar sketches of ``k`` share, but for a chance of ``lost``.

    The values of the lower-reaching sketch are a random choice from its set, of which the
    other set holds at least ``percent``: just that where the shorter set lies in the longer
    one.  Without replacement the lower tail is lighter than the binomial one used here.  The
    same bound holds for the union sketch.
    """
    p, tail = percent / 100, 0.0
    for few in range(k):
        tail += math.comb(k, few) * p**few * (1 - p) ** (k - few)
        if tail > lost:
            return max(1, few)
    return k


def _shared_of_whole(n: str, percent: int, k: int) -> Column:
    """Retained values that a whole set of ``n`` elements shares with any similar one, at least.

    A partner that is whole too shares ``percent`` of it.  One of m > k elements has lost m - k of
    its own, which may all be common; the longest one, m = n / percent, leaves the fewest.
    """
    whole = F.ceil(F.col(n) * percent / 100)
    longest = F.floor(F.col(n) * 100 / percent)
    common = F.ceil((F.col(n) + longest) * percent / (100 + percent))
    return F.when(longest > k, F.greatest(F.least(whole, common - (longest - k)), F.lit(1))).otherwise(whole)


def _retained_lists(classes: DataFrame, percent: int, k: int, shared: int) -> DataFrame:
    """(value, v, n, alone): every class under the rarest retained values of its sketch.

    Two sketches with ``shared`` values in common also share one of their rarest
    ``size - shared + 1`` values, in any fixed order of all values; by rarity, values that
    many documents hold (such as a common passage) propose few pairs.  A sketch that is a
    whole set shares what :func:`_shared_of_whole` says.  ``alone`` counts the values that no
    other class retains.
    """
    spread = classes.select("v", "n", F.explode("sketch").alias("value"))
    frequent = written(
        spread.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequent-values"
    )
    size = F.least("n", F.lit(k))
    prefix = size - F.when(F.col("n") <= k, _shared_of_whole("n", percent, k)).otherwise(shared) + 1
    mine = Window.partitionBy("v")
    return (
        spread.join(frequent, "value")
        .withColumn("alone", size - F.count(F.lit(1)).over(mine))
        .withColumn("rank", F.row_number().over(mine.orderBy("df", "value")))
        .filter(F.col("rank") <= prefix - F.col("alone"))
        .select("value", "v", "n", "alone")
    )


def _close(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _labelled(lists: DataFrame, label: DataFrame | None) -> DataFrame:
    """``lists`` with the component ``c`` of every row, at first the class itself."""
    if label is None:
        return lists.withColumn("c", F.col("v"))
    named = label.select("v", F.col("component").alias("c"))
    return lists.join(named, "v", "left").withColumn("c", F.coalesce("c", "v"))


def _open(labelled: DataFrame) -> DataFrame:
    """The rows of lists that hold several components."""
    sizes = labelled.groupBy("value").agg(
        F.min(F.xxhash64("c")).alias("low"), F.max(F.xxhash64("c")).alias("high"), F.min("n").alias("shortest")
    )
    several = written(sizes.filter("low <> high").select("value", "shortest"), "open-lists")
    return written(labelled.join(several, "value"), "open")


def _able(mine: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of open lists whose class can still be similar to one of another component.

    Only hashes that another component holds too can be shared with it; with a partner of m
    elements a set of n must share percent / (100 + percent) * (n + m) of them, and no partner
    is shorter than the list's shortest member or than ``percent`` of n.
    """
    named = written(mine.select("v", F.xxhash64("c").alias("c")).distinct(), "open-classes")
    spread = sets.join(small_or_shuffled(named), "v").select("v", "c", F.explode("hashes").alias("hash"))
    shared = (
        spread.groupBy("hash").agg(F.min("c").alias("low"), F.max("c").alias("high"))
        .filter("low <> high").select("hash")
    )
    # Hashes that several components hold are as frequent as they are; written, the join is split.
    usable = (
        spread.select("v", "hash").join(written(shared, "shared-hashes"), "hash")
        .groupBy("v").agg(F.count(F.lit(1)).alias("usable"))
    )
    least = F.greatest(F.col("shortest"), F.ceil(F.col("n") * percent / 100))
    return mine.join(written(usable, "usable"), "v").filter(
        (100 + percent) * F.col("usable") >= percent * (F.col("n") + least)
    ).drop("usable")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, k: int = SKETCH) -> DataFrame | None:
    """(v, component): classes that have a similar partner, with their component; None without pairs."""
    shared = least_shared(percent, k)
    lists = written(_retained_lists(classes, percent, k, shared), "retained")
    sketch = classes.select("v", "sketch")
    wanted = lists.select("v").distinct().join(
        classes.select("v", F.col("doc_id").alias("w_id"), F.col("key").alias("w_key")), "v"
    )
    sets = written(full_sets(docs, small_or_shuffled(written(wanted, "listed")), size), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Estimate by the union sketch, then decide by the full sets."""
        both = pairs.join(sketch.toDF("b", "y"), "b").join(sketch.toDF("a", "x"), "a")
        union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
        common = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
        likely = written(
            both.filter(common >= F.size(union) * shared / k).select("a", "b"), "likely"
        )
        ends = written(likely.select(F.col("a").alias("v")).union(likely.select(F.col("b").alias("v"))).distinct(), "ends")
        needed = sets.join(small_or_shuffled(ends), "v", "left_semi")
        return written(_similar(likely, needed, percent), "links")

    # Every list's most typical member is its hub, mostly the same one in all lists of a group.
    order = F.struct("alone", F.xxhash64("v"))
    hubs = written(
        lists.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(order.alias("o"), "v", "n")).alias("hub"))
        .filter("members > 1")
        .select("value", F.col("hub.v").alias("h"), F.col("hub.n").alias("m")),
        "hubs",
    )
    if hubs.isEmpty():
        return None
    pairs = lists.join(hubs, "value").filter((F.col("v") != F.col("h")) & _close("n", "m", percent)).select(
        F.least("v", "h").alias("a"), F.greatest("v", "h").alias("b")
    ).distinct()
    found = verified(written(pairs, "pairs"))
    label = components(found)
    mine = _open(_labelled(lists, label))
    if mine.isEmpty():
        return label
    able = written(_able(mine, sets, percent), "able")
    return components(found.union(written(_links_in_groups(able, sets, percent), "links")))


def _links_in_groups(able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between components among the rows (value, v, n, c) of lists.

    Lists with common members make a group.  All members of a group outside its largest
    component are compared with the whole group; of the links between a member and another
    component a tile returns one.
    """
    star = able.groupBy("value").agg(F.min("v").alias("star"))
    groups = components(able.join(written(star, "stars"), "value").select("v", "star").distinct(), "v", "star")
    members = written(
        able.select("v", "n", F.xxhash64("c").alias("c")).distinct().join(groups.withColumnRenamed("component", "g"), "v"),
        "group-members",
    )
    parts = members.groupBy("g", "c").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    sizes = written(
        parts.groupBy("g").agg(
            F.max_by("c", F.struct("rows", "c")).alias("main"),
            F.sum("hashes").alias("all"),
            (F.sum("hashes") - F.max_by("hashes", F.struct("rows", "c"))).alias("rest"),
            F.count(F.lit(1)).alias("parts"),
        ).filter("parts > 1").select(
            "g", "main", F.ceil(F.col("all") / TILE).alias("m_parts"), F.ceil(F.col("rest") / TILE).alias("o_parts")
        ),
        "group-sizes",
    )
    spot = F.xxhash64("v")
    placed = members.join(sizes, "g").withColumn("asks", F.col("c") != F.col("main"))

    def upto(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))

    asking = placed.filter("asks").select("g", F.pmod(spot, "o_parts").alias("i"), upto("m_parts").alias("j"), "asks", "v", "c")
    asked = placed.select("g", upto("o_parts").alias("i"), F.pmod(spot, "m_parts").alias("j"), F.lit(False).alias("asks"), "v", "c")

    def meet(pdf):
        ask, rest = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        both = [*ask["hashes"], *rest["hashes"]]
        sizes = np.array([len(h) for h in both])
        row = np.repeat(np.arange(len(both)), sizes)
        _, column, times = np.unique(np.concatenate(both) if both else np.zeros(0), return_inverse=True, return_counts=True)
        shared = times[column] > 1  # hashes of one row only are common to no pair
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        k = len(ask)
        common = np.zeros((k, len(rest)), np.float32)
        for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            mine = (column >= at) & (column < at + COLUMNS)
            cells = np.zeros((len(both), COLUMNS), np.float32)
            cells[row[mine], column[mine] - at] = 1
            common += cells[:k] @ cells[k:].T
        total = sizes[:k, None] + sizes[None, k:] - common
        c, d = ask["c"].to_numpy(), rest["c"].to_numpy()
        linked = (100 * common >= percent * total) & (c[:, None] != d[None, :])
        x, y = np.nonzero(linked)
        _, first = np.unique(np.column_stack((x, d[y])), axis=0, return_index=True)
        v, w = ask["v"].tolist(), rest["v"].tolist()
        return pd.DataFrame([sorted((v[x[i]], w[y[i]])) for i in first], columns=["a", "b"])

    tiles = asking.union(asked).join(sets, "v").select("g", "i", "j", "asks", "v", "c", "hashes")
    return tiles.groupBy("g", "i", "j").applyInPandas(meet, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, key, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle
    sets; ``component_id`` is the smallest doc_id reachable over links.  Documents without
    words (null, empty, blank) have 0 shingles and no links.  Rows that repeat a doc_id are
    told apart by their text; ``kept`` says that the row's doc_id is its component's.
    """
    docs = packed(docs).select("row.doc_id", "row.text")
    all_sets = written(sketches(docs, size), "sketches")
    first = F.min(F.struct("doc_id", "key", "n", "sketch")).alias("m")
    classes = written(
        all_sets.filter("n > 0").groupBy(F.col("set").alias("v")).agg(first)
        .select("v", "m.doc_id", "m.key", "m.n", "m.sketch"),
        "classes",
    )
    label = links(docs, classes, size, percent)
    ids = classes.select("v", "doc_id")
    if label is None:
        named = ids.select("v", F.col("doc_id").alias("component_id"))
    else:
        linked = ids.join(label, "v", "left").withColumn("component", F.coalesce("component", "v"))
        smallest = written(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
        named = linked.join(smallest, "component").select("v", "component_id")
    return (
        all_sets.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("set").alias("v"))
        .join(written(named, "components"), "v", "left")
        .select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, one of every group: the one with the smallest doc_id.

    Of rows that repeat that doc_id the one with the smallest text key stays, of identical
    ones any.  Documents without words all stay.
    """
    found = written(near_duplicates(docs, size, percent), "near-duplicates")
    stay = found.filter("kept and n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("m")).select(
        F.col("m.doc_id").alias("k_id"), F.col("m.key").alias("k_key")
    )
    wordless = found.filter("n_shingles = 0").select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key")).distinct()
    rows = packed(docs).withColumn("doc_id", F.col("row.doc_id")).withColumn("key", text_key(F.col("row.text")))
    same = Window.partitionBy("doc_id", "key").orderBy(F.lit(0))
    blank = F.coalesce(F.length(F.regexp_replace("row.text", r"[\x20\x09-\x0D]+", "")) == 0, F.lit(True))
    once = rows.withColumn("nth", F.row_number().over(same)).filter((F.col("nth") == 1) | blank)
    joined = once.join(
        stay.union(wordless), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key")), "left_semi"
    )
    return unpacked(joined, docs.columns)
