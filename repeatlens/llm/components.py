"""Connected components by alternating large-star and small-star steps.

Every step keeps the components and makes the graph flatter; it ends when
each node hangs directly on its component's smallest node.  A node with many
neighbours costs one partial minimum per task and a join that adaptive
execution may split; no task gathers a neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.session import write_shared


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each node of ``edges``; component: its smallest node.

    Self-loops and edges with a null end are ignored; no edges, no rows.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = write_shared(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .distinct(), "edges")
    seen = _signature(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("m", "u").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lower.select("u", F.col("m").alias("v"))))
        e = write_shared(small.distinct(), "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    hung = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return hung.union(roots)
