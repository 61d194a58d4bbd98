"""Closure over upstream ids, set at a time.

A parent shared by very many children is a hot join key here.  The other side of these
joins is always the stored table itself, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.functions.constants import TEXT_UNKNOWN_TOKEN
from launchsift.functions.schemas import INT, TEXT, struct
from launchsift.functions.text import blank_to_null

PIPELINE_DEPTH = 4


def cut_plan(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the folder named in ``spark.checkpoint.dir`` and reads it back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def lineage(
    findings: DataFrame, starts: DataFrame, max_depth: int | None = PIPELINE_DEPTH
) -> DataFrame:
    """(start_id, msg_id, depth): everything upstream of each start, itself included.

    Each finding appears once per start at its smallest depth, unknown parents are
    skipped and cycles end.  ``starts`` has one column ``start_id``.  One join per level
    serves all starts together.  Up to the pipeline's own depth that is a fixed chain of
    joins; beyond it, or without a limit, every level is written to the checkpoint folder
    and the walk ends at ``max_depth`` or at the first empty level.
    """
    nodes = findings.select("msg_id", "upstream_ids")
    frontier = starts.select("start_id", F.col("start_id").alias("msg_id")).distinct()
    if max_depth is not None and max_depth <= PIPELINE_DEPTH:
        return _fixed_walk(nodes, frontier, max_depth)
    closed, depth = None, 0
    while True:
        level = cut_plan(_level(nodes, frontier, depth))
        found = level.select("start_id", "msg_id", "depth")
        closed = found if closed is None else closed.unionByName(found)
        if depth == max_depth or level.isEmpty():
            return closed
        frontier = (
            level.select("start_id", F.explode("upstream_ids").alias("msg_id"))
            .distinct()
            .join(closed.select("start_id", "msg_id"), ["start_id", "msg_id"], "left_anti")
        )
        depth += 1


def _level(nodes: DataFrame, frontier: DataFrame, depth: int) -> DataFrame:
    return frontier.join(nodes, "msg_id").select(
        "start_id", "msg_id", "upstream_ids", F.lit(depth).alias("depth")
    )


def _fixed_walk(nodes: DataFrame, frontier: DataFrame, max_depth: int) -> DataFrame:
    """Levels 0 to ``max_depth`` as one plan; a finding keeps its smallest depth."""
    levels = []
    for depth in range(max_depth + 1):
        levels.append(_level(nodes, frontier, depth))
        frontier = levels[-1].select("start_id", F.explode("upstream_ids").alias("msg_id")).distinct()
    every = reduce(DataFrame.unionByName, [x.select("start_id", "msg_id", "depth") for x in levels])
    return every.groupBy("start_id", "msg_id").agg(F.min("depth").alias("depth"))


def lineage_report(findings: DataFrame, starts: DataFrame, max_depth: int = PIPELINE_DEPTH) -> DataFrame:
    """Closure with the stored columns; ``depth`` gives the distance to the start."""
    return lineage(findings, starts, max_depth).join(findings, "msg_id")


def token_names(closure: DataFrame, findings: DataFrame) -> DataFrame:
    """(start_id, token_name): the nearest non-empty name upstream, else "Unknown"."""
    named = findings.select(
        "msg_id", blank_to_null(F.get_json_object("payload", "$.token_name")).alias("_name")
    ).filter(F.col("_name").isNotNull())
    nearest = (
        closure.join(named, "msg_id", "left")
        .groupBy("start_id")
        .agg(
            F.min_by(
                "_name", F.when(F.col("_name").isNotNull(), F.struct("depth", "msg_id"))
            ).alias("_name")
        )
    )
    return nearest.select(
        "start_id", F.coalesce("_name", F.lit(TEXT_UNKNOWN_TOKEN)).alias("token_name")
    )


def model_attribution(
    closure: DataFrame, findings: DataFrame, own: DataFrame | None = None
) -> DataFrame:
    """(start_id, model_attribution): sorted distinct model tags upstream plus the own one."""
    tagged = findings.filter(F.col("model_used").isNotNull()).select("msg_id", "model_used")
    seen = closure.join(tagged, "msg_id").select("start_id", "model_used")
    if own is not None:
        seen = seen.unionByName(
            own.filter(F.col("model_used").isNotNull()).select("start_id", "model_used")
        )
    lists = seen.distinct().groupBy("start_id").agg(
        F.array_sort(F.collect_set("model_used")).alias("_models")
    )
    return (
        closure.select("start_id").distinct()
        .join(lists, "start_id", "left")
        .select(
            "start_id",
            F.coalesce("_models", F.array().cast("array<string>")).alias("model_attribution"),
        )
    )


# -- closures that are kept ------------------------------------------------------------------

#: What lies upstream of a finding, itself included, and the parents that were not stored yet.
ABOVE = T.ArrayType(struct(msg_id=TEXT, depth=INT, token_name=TEXT, model_used=TEXT))
MISSING = T.ArrayType(struct(msg_id=TEXT, depth=INT))

#: Stored closures (msg_id, above, missing) of the ids (``msg_id``) asked for.
Look = Callable[[DataFrame], DataFrame]


def closures(new: DataFrame, stored: DataFrame, max_depth: int = PIPELINE_DEPTH) -> DataFrame:
    """(msg_id, above, missing) of a batch of new findings.

    Parents inside the batch are walked; those outside bring along their closures in
    ``stored``, so the work follows the batch.  Nothing deeper than ``max_depth`` is kept.
    """
    nodes = new.select("msg_id", "upstream_ids")
    info = new.select(
        "msg_id", blank_to_null(F.get_json_object("payload", "$.token_name")).alias("token_name"), "model_used"
    )
    inside = nodes.select(F.explode("upstream_ids").alias("msg_id")).join(nodes.select("msg_id"), "msg_id", "left_semi")
    own = nodes.select(F.col("msg_id").alias("start_id"), "msg_id")
    walked = own.withColumn("depth", F.lit(0)) if inside.isEmpty() else cut_plan(_fixed_walk(nodes, own, max_depth))
    parents = (
        walked.join(nodes, "msg_id")
        .select("start_id", F.explode("upstream_ids").alias("msg_id"), (F.col("depth") + 1).alias("depth"))
        .filter(F.col("depth") <= max_depth)
        .groupBy("start_id", "msg_id").agg(F.min("depth").alias("depth"))
        .join(nodes.select("msg_id"), "msg_id", "left_anti")
    )
    found, gone = _beyond(parents, stored, max_depth)
    above = (
        _nearest(walked.join(info, "msg_id").unionByName(found))
        .groupBy("start_id")
        .agg(F.array_sort(F.collect_list(F.struct("msg_id", "depth", "token_name", "model_used"))).alias("above"))
    )
    missing = gone.groupBy("start_id", "msg_id").agg(F.min("depth").alias("depth")).groupBy("start_id").agg(
        F.array_sort(F.collect_list(F.struct("msg_id", "depth"))).alias("missing")
    )
    return above.join(missing, "start_id", "left").select(F.col("start_id").alias("msg_id"), "above", "missing")


def _nearest(closure: DataFrame) -> DataFrame:
    """One row per start and finding, with its smallest depth."""
    least = [F.min(c).alias(c) for c in ("token_name", "model_used")]
    return closure.groupBy("start_id", "msg_id").agg(F.min("depth").cast("int").alias("depth"), *least)


def _beyond(parents: DataFrame, stored: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """What the stored closures of parents add, and the parents that are not stored.

    The first as (start_id, msg_id, depth, token_name, model_used), the second as (start_id,
    msg_id, depth).
    """
    joined = parents.join(stored.select("msg_id", "above", "missing"), "msg_id", "left").withColumnRenamed("depth", "_far")
    deeper = (F.col("_far") + F.col("a.depth")).cast("int").alias("depth")
    found = joined.select("start_id", "_far", F.explode("above").alias("a")).select(
        "start_id", "a.msg_id", deeper, "a.token_name", "a.model_used"
    )
    gone = joined.filter("above is null").select("start_id", "msg_id", F.col("_far").cast("int").alias("depth"))
    gone = gone.unionByName(
        joined.select("start_id", "_far", F.explode("missing").alias("a")).select("start_id", "a.msg_id", deeper)
    )
    return found.filter(F.col("depth") <= max_depth), gone.filter(F.col("depth") <= max_depth)


def kept_lineage(starts: DataFrame, look: Look, max_depth: int = PIPELINE_DEPTH) -> DataFrame:
    """``lineage`` from kept closures: (start_id, msg_id, depth, token_name, model_used).

    Parents that were stored after their children are looked up once more, level by level, as
    long as there are any.
    """
    at = starts.select("start_id", F.col("start_id").alias("msg_id"), F.lit(0).alias("depth")).distinct()
    stored = cut_plan(look(at))
    every = []
    for _ in range(max_depth + 1):
        found, gone = _beyond(at, stored, max_depth)
        every.append(found)
        # A start that is not stored has nothing upstream; other parents may have come late.
        late = gone.filter("depth > 0").groupBy("start_id", "msg_id").agg(F.min("depth").alias("depth"))
        if stored.filter("missing is not null").isEmpty():
            break
        late = cut_plan(late)
        stored = cut_plan(look(late))
        at = late.join(stored.select("msg_id"), "msg_id", "left_semi")
    return _nearest(reduce(DataFrame.unionByName, every))


def kept_names(closure: DataFrame) -> DataFrame:
    """``token_names`` of a kept lineage."""
    named = F.col("token_name").isNotNull()
    nearest = closure.groupBy("start_id").agg(
        F.min_by("token_name", F.when(named, F.struct("depth", "msg_id"))).alias("_name")
    )
    return nearest.select("start_id", F.coalesce("_name", F.lit(TEXT_UNKNOWN_TOKEN)).alias("token_name"))
