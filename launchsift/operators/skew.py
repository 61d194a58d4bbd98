"""Joins and top-k that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = "_salt"


def split_count(df: DataFrame) -> int:
    """Into how many parts a hot group is cut: the session's shuffle width."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def first_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group with their rank, in one round.

    Spark's window-group limit keeps every input task's own first ``k`` before the only
    shuffle, so of a hot group at most ``k`` rows a task meet in the ranking.  Meant for
    narrow rows: each is sorted and sent once.
    """
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, ranked).filter(F.col(rank) <= k)


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group with their rank, for few groups of wide rows.

    Two rounds: each input task keeps its own first ``k`` (Spark prunes before the
    shuffle), about sqrt(tasks) groups of tasks are reduced in parallel, and only their
    survivors meet in the final ranking.  A hot group therefore never meets in one
    task, and the result does not depend on how rows were spread.
    """
    groups = max(2, int(split_count(df) ** 0.5))
    own = df.withColumn(SALT, F.spark_partition_id() % groups)
    survivors = first_k_per_group(own, [*keys, SALT], order, k, rank).drop(rank, SALT)
    return first_k_per_group(survivors, keys, order, k, rank)


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys holding more than 1/n of the rows; there can be at most n of them."""
    parts = split_count(df)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counted.agg(F.sum("_rows")).scalar()
    return counted.filter(F.col("_rows") * parts > total).select(*keys, F.lit(True).alias("_hot"))


def skew_join(
    fact: DataFrame, dim: DataFrame, keys: list[str], spread: list[str], how: str = "left"
) -> DataFrame:
    """``fact`` joined to ``dim`` on ``keys`` with the hot keys of ``fact`` salted.

    Adaptive skew handling does not reach a side that ends in an aggregate, so the split
    is explicit: rows of hot keys get a salt from ``spread`` and only the dimension rows
    of those keys are repeated.  The hot-key list is broadcast because it has at most as
    many rows as there are shuffle partitions.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    parts = split_count(fact)
    hot = F.broadcast(hot_keys(fact, keys))
    # A null key matches nothing, so its rows may lie anywhere.
    free = F.col("_hot") | reduce(or_, [F.col(k).isNull() for k in keys])
    left = (
        fact.join(hot, keys, "left")
        .withColumn(
            SALT,
            F.when(free, F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
            .otherwise(F.lit(0)),
        )
        .drop("_hot")
    )
    right = (
        dim.join(hot, keys, "left")
        .withColumn(
            SALT,
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1)))
                .otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot")
    )
    return left.join(right, [*keys, SALT], how).drop(SALT)
