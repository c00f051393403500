"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import Workspace


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root: for each node of ``edges`` (two columns of longs) the smallest node that it reaches.

    Every step pulls each node towards the smallest neighbour; the number of steps grows with the logarithm of the
    longest path. Each step is written to the shared folder, and the one before it removed. Neighbour minima are
    pre-aggregated, so a node with very many edges costs one row a task.
    """
    a, b = edges.columns
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct()
    now, step = work.save("star-0", now), 0
    seen = _signature(now)
    while seen[0]:
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = work.save(f"large-{step}", large)
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        rest = large.join(least, "x").filter("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        small = work.save(f"star-{step + 1}", rest.union(least.select("x", F.col("m").alias("y"))).distinct())
        work.drop(f"star-{step}")
        work.drop(f"large-{step}")
        now, step, before, seen = small, step + 1, seen, _signature(small)
        if before == seen:
            break
    roots = now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(roots)
