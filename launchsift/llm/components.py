"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchsift.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for every vertex of ``edges``; the component is its smallest vertex.

    Every round lowers each label to the smallest one among the neighbours and then to the
    label of that label, so long chains halve.  Labels are written per round to the shared
    folder; a vertex with very many neighbours is met by partial minima and by joins of
    written tables, which adaptive execution splits.  No edges give no rows.
    """
    both = written(
        edges.select(F.col(a).alias("v"), F.col(b).alias("u"))
        .union(edges.select(F.col(b).alias("v"), F.col(a).alias("u")))
        .filter("v != u")
        .distinct(),
        "edges",
    )
    labels = written(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("component").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("component").alias("next"))
        after = written(
            lower.join(jump, "low").select("v", "old", F.least("low", "next").alias("component")), "labels"
        )
        if after.filter("old <> component").isEmpty():
            return after.select("v", "component")
        labels = after.select("v", "component")
