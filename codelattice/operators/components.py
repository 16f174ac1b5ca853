"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.session import drop_scratch, write_scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u gets linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """With edges from the larger to the smaller end: u and its smaller neighbours get linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, *, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of an edge list with ids that can be ordered.

    Each round is two group-bys with map-side combination and is written to the shared folder, so the lineage stays short and no task
    ever holds a component. Loops and edges with a null end are ignored. Raises if it hasn't converged after ``most_rounds``.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = write_scratch(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        last, now = now, write_scratch(_small_star(_large_star(now)))
        drop_scratch(last)
        state = now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = state
    raise RuntimeError(f"no convergence after {most_rounds} rounds")
