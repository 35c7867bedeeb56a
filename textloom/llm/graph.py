"""Connected components of a large edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join back, so no neighbourhood is gathered in one place, and each round is written
to the shared folder.  Labels are the smallest node of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom.llm.store import written


def _round(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and sum of hashes, which the write itself gathers."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")), name)
    return out, (seen.get["n"], seen.get["hash"])


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, label) of every node that has an edge (a, b) to another one; nodes without are left out."""
    now, state = _round(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(most):
        if state == before or not state[0]:
            break
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now, state = _round(small.distinct(), name)
    else:
        raise RuntimeError(f"no fixed point in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
