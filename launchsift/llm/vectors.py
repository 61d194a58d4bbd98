"""Near-duplicate vectors by sorted projection passes.

Every vector gets the signs of its products with random directions.  A pass orders all
vectors by a random choice of those signs, read as one number, and compares each with the
neighbours inside a bounded window; links of all passes are verified in double precision
and united.  Direct links are then counted inside the components: vectors close enough to
their component's centre are linked with one another by the triangle inequality, and only
the others are compared one by one, in tiles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import packed, written
from launchsift.llm.components import components

#: Signs of products with random directions that make up the sorting key of a pass.
KEY_SIGNS = 60
#: Vectors around which the density is measured, and bins of the angle.
ASKING = 256
ANGLES = 180
#: Cosines in single precision are off by less than this.
SINGLE = 2e-5
#: Neighbours on either side that a vector is compared with, at least.
WINDOW = 128
#: Vectors of a block that are compared at once.
BLOCK = 512
#: Chance with which a pair right at the threshold comes together in some pass.
RECALL = 0.95
#: Vectors of one side of a tile when links are counted.
TILE = 512


def passes_needed(crowds: np.ndarray, cosine: float, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has met with chance ``recall``.

    ``crowds`` counts around some vectors, a row for each, the vectors that are not linked with
    it by their angle (:func:`crowds_of`).  A pair meets in a pass if it agrees in so many signs
    that at most ``window`` of those are expected to agree as well; the chance is the mean over
    the rows.
    """
    if not len(crowds):
        return 4
    agree = 1 - np.arange(crowds.shape[1]) / crowds.shape[1]  # at the near edge of each bin
    left = np.stack([crowds @ agree**signs for signs in range(1, KEY_SIGNS + 1)])
    signs = np.where((left <= window).any(0), (left <= window).argmax(0) + 1, KEY_SIGNS)
    missed = 1 - np.minimum((1 - math.acos(cosine) / math.pi) ** signs, 0.99)
    low, high = 4, 4
    while (missed**high).mean() > 1 - recall:
        low, high = high + 1, 2 * high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if (missed**middle).mean() <= 1 - recall else (middle + 1, high)
    return high


def crowds_of(unique: DataFrame, cosine: float) -> np.ndarray:
    """Counts of vectors by their angle to each of some vectors, linked ones left out.

    The asking vectors are the first by name, which is a hash.  Every vector is compared with them.
    """
    asking: dict[int, np.ndarray] = {}
    for r in unique.select("v", "x").orderBy("v").limit(ASKING).collect():
        x = np.frombuffer(r["x"])
        asking.setdefault(len(x), []).append(_unit(x[None])[0])
    asking = {d: np.stack(x) for d, x in asking.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {d: np.zeros((len(x), ANGLES), np.int64) for d, x in asking.items()}
        for batch in batches:
            for d, x in _by_length(batch.column("x").to_pylist()):
                if d not in found:
                    continue
                near = np.clip(asking[d] @ _unit(x[1]).T, -1, 1)
                at = np.minimum((np.arccos(near) / math.pi * ANGLES).astype(np.int64), ANGLES - 1)
                at += np.arange(len(near))[:, None] * ANGLES
                found[d] += np.bincount(at[near < cosine], minlength=len(near) * ANGLES).reshape(-1, ANGLES)
        flat = [(d, q, a, int(m[q, a])) for d, m in found.items() for q, a in zip(*np.nonzero(m))]
        if flat:
            d, q, a, n = zip(*flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int32()), pa.array(q, pa.int32()), pa.array(a, pa.int32()), pa.array(n, pa.int64())],
                names=["d", "q", "a", "n"],
            )

    counted = unique.select("x").mapInArrow(run, "d int, q int, a int, n long").groupBy("d", "q", "a").agg(F.sum("n").alias("n"))
    out = {d: np.zeros((len(x), ANGLES)) for d, x in asking.items()}
    for r in counted.collect():
        out[r["d"]][r["q"], r["a"]] = r["n"]
    return np.concatenate(list(out.values())) if out else np.zeros((0, ANGLES))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(raw: list[bytes], kind=np.float64) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(components, (rows, vectors)) for every length among ``raw``."""
    sizes = np.array([len(r) for r in raw]) // np.dtype(kind).itemsize
    for d in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == d)
        yield d, (mine, np.frombuffer(b"".join(raw[i] for i in mine), kind).reshape(-1, d))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of (vec_id, v) for all rows, and (v, x, copies, least) for the usable ones.

    ``v`` names a vector by its 128-bit hash, ``x`` holds its components as double bytes.
    Null, empty and zero vectors and those with a null or non-finite component have no ``v``.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raw = [], []
            for value in batch.column("embedding").to_pylist():
                x = np.array([np.nan] if not value else [np.nan if c is None else c for c in value], np.float64)
                good = bool(np.isfinite(x).all() and x.any())
                raw.append((x + 0.0).tobytes() if good else None)  # -0.0 becomes 0.0
                names.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(names, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "v", "x"]
            )

    named = vectors.mapInArrow(run, f"vec_id {kind}, v binary, x binary")
    rows = written(named.select("vec_id", "v"), "vector-names")
    alike = named.filter("v is not null").groupBy("v").agg(
        F.first("x").alias("x"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    return rows, written(alike, "vectors")


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the matrix ``near`` connects, one per joined node."""
    left = np.ones(len(near), bool)
    edges = []
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            edges += [(at, int(k)) for k in new]
            queue += new.tolist()
    return edges


def candidates(unique: DataFrame, cosine: float, seed: int = 11) -> DataFrame:
    """(a, b): pairs that met in a window and whose cosine in single precision allows ``cosine``.

    Sure links are thinned to those that connect what their block links, as links are counted
    later; pairs too close to the threshold for single precision all stay.
    """
    spark = unique.sparkSession
    passes = passes_needed(crowds_of(unique, cosine), cosine)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (1 << np.arange(KEY_SIGNS - 1, -1, -1)).astype(np.int64)
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            raw = batch.column("x").to_pylist()
            units = [(d, mine, _unit(x)) for d, (mine, x) in _by_length(raw)]
            short = [b""] * len(raw)
            for _, mine, x in units:
                for i, one in zip(mine.tolist(), x.astype(np.float32)):
                    short[i] = one.tobytes()
            short = pa.array(short, pa.binary())
            for p in range(passes):
                key = np.zeros(len(raw), np.int64)
                for d, mine, x in units:
                    if (d, p) not in planes:
                        planes[d, p] = np.random.default_rng([seed, d, p]).standard_normal((d, KEY_SIGNS))
                    key[mine] = (x @ planes[d, p] > 0) @ power
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * len(raw), pa.int32()), pa.array(key), batch.column("v"), short],
                    names=["pass", "key", "v", "x"],
                )

    order = ["key", "v"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range partition is the bucket in which ranks are counted; written, it stays as it is.
    dealt = written(
        unique.select("v", "x").mapInArrow(keys, "pass int, key long, v binary, x binary")
        .repartitionByRange(n, "pass", *order)
        .withColumn("bucket", F.spark_partition_id()),
        "passes",
    )
    sizes = dealt.groupBy("pass", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pass", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pass", "bucket").orderBy(*order)
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(offsets, ["pass", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("nth") - 1
    )
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    at_end = F.pmod("rank", F.lit(BLOCK)) >= BLOCK - WINDOW
    blocks = ranked.select(
        "pass", "v", "x",
        F.explode(F.when(at_end, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"),
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, (mine, x) in _by_length(pdf["x"].tolist(), np.float32):
            near = x @ x.T
            np.fill_diagonal(near, -1)
            edges += [(mine[i], mine[j]) for i, j in _spanning(near >= cosine + SINGLE)]
            a, b = np.nonzero(np.triu(np.abs(near - cosine) < SINGLE))
            edges += zip(mine[a], mine[b])
        v = pdf["v"].tolist()
        return pd.DataFrame([sorted((v[i], v[j])) for i, j in edges], columns=["a", "b"])

    return blocks.groupBy("pass", "block").applyInPandas(meet, "a binary, b binary").distinct()


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]


def verified(pairs: DataFrame, unique: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine in double precision reaches ``cosine``; of unequal lengths none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x), np.frombuffer(y)
                keep.append(len(x) == len(y) and float(_cosines(x[None], y[None])[0, 0]) >= cosine)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = unique.select(F.col("v").alias("a"), "x")
    y = unique.select(F.col("v").alias("b"), F.col("x").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def count_links(members: DataFrame, cosine: float) -> DataFrame:
    """(v, n): vectors linked directly with each, its own copies included, itself not.

    ``members`` is a written table (v, component, x, copies).  Two vectors within half the
    threshold angle of their component's centre are linked, so those are only counted; the
    remaining ones are compared with every member of their component.
    """
    half = math.acos(cosine) / 2 - 1e-6

    def direction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[bytes, np.ndarray] = {}
            for c, x in zip(batch.column("component").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(x)
                sums[c] = sums.get(c, 0.0) + x / np.linalg.norm(x)
            flat = [(c, k, float(s)) for c, x in sums.items() for k, s in enumerate(x)]
            if flat:
                c, k, s = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(k, pa.int32()), pa.array(s)], names=["component", "k", "s"])

    centres = written(
        members.select("component", "x").mapInArrow(direction, "component binary, k int, s double")
        .groupBy("component", "k").agg(F.sum("s").alias("s"))
        .groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda t: t.s).alias("centre")),
        "centres",
    )

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = []
            for x, c in zip(batch.column("x").to_pylist(), batch.column("centre").to_pylist(), strict=True):
                x, c = np.frombuffer(x), np.array(c)
                size = np.linalg.norm(x) * np.linalg.norm(c)
                inner.append(bool(size > 0 and x @ c / size >= math.cos(half)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("v", "component", "x", "copies")] + [pa.array(inner, pa.bool_())],
                names=["v", "component", "x", "copies", "inner"],
            )

    placed = written(
        members.join(centres, "component").select("v", "component", "x", "copies", "centre")
        .mapInArrow(core, "v binary, component binary, x binary, copies long, inner boolean"),
        "placed",
    )
    inside = written(
        placed.filter("inner").groupBy("component").agg(F.sum("copies").alias("inside")), "inside"
    )
    # Members in tiles: a tile is a random part of a component of about TILE members.
    sizes = written(
        placed.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(~F.col("inner"), 1)).alias("o"))
        .filter("o > 0")
        .select("component", F.ceil(F.col("m") / TILE).alias("m_parts"), F.ceil(F.col("o") / TILE).alias("o_parts")),
        "tiles",
    )
    spot = F.xxhash64("v")
    open_ = placed.join(sizes, "component")
    outer = open_.filter("not inner").select(
        "component", F.pmod(spot, F.col("o_parts")).alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_parts") - 1)).alias("j"),
        F.lit(True).alias("asks"), "v", "x", "copies", "inner",
    )
    every = open_.select(
        "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_parts") - 1)).alias("i"),
        F.pmod(spot, F.col("m_parts")).alias("j"), F.lit(False).alias("asks"), "v", "x", "copies", "inner",
    )

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, rest = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(ask) or not len(rest):
            return pd.DataFrame({"v": [], "n": []})
        width = len(pdf["x"].iloc[0]) // 8
        x = np.frombuffer(b"".join(ask["x"]), np.float64).reshape(-1, width)
        y = np.frombuffer(b"".join(rest["x"]), np.float64).reshape(-1, width)
        near = _cosines(x, y) >= cosine
        near &= ask["v"].to_numpy()[:, None] != rest["v"].to_numpy()[None, :]
        inner = rest["inner"].to_numpy()
        return pd.DataFrame({
            "v": [*ask["v"], *rest["v"][inner]],
            "n": [*(near @ rest["copies"].to_numpy()), *(ask["copies"].to_numpy() @ near)[inner]],
        })

    counted = outer.union(every).groupBy("component", "i", "j").applyInPandas(tile, "v binary, n long")
    near = counted.groupBy("v").agg(F.sum("n").alias("compared"))
    return (
        placed.join(inside, "component", "left").join(near, "v", "left")
        .select(
            "v",
            (
                F.col("copies") - 1
                + F.when(F.col("inner"), F.col("inside") - F.col("copies")).otherwise(0)
                + F.coalesce("compared", F.lit(0))
            ).alias("n"),
        )
    )


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    ``component_id`` is the smallest vec_id reachable over pairs with a cosine of at least
    ``cosine``; ``n_links`` counts the rows linked directly.  Equal vectors are linked rows.
    Null, empty, zero and non-finite vectors, and those of another length, link with nothing.
    """
    rows, unique = classes(packed(vectors).select("row.vec_id", "row.embedding"))
    links = written(verified(written(candidates(unique, cosine), "vector-pairs"), unique, cosine), "vector-links")
    label = components(links)
    joined = unique.join(label, "v")
    members = written(joined.select("v", "component", "x", "copies"), "members")
    counts = written(count_links(members, cosine), "link-counts")
    least = written(joined.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    found = written(
        unique.select("v", "copies", "least")
        .join(label.join(least, "component").select("v", "component_id"), "v", "left")
        .join(counts, "v", "left")
        .select("v", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n", F.col("copies") - 1).alias("n")),
        "vector-results",
    )
    return rows.join(found, "v", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
