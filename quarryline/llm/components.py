"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest node that each node of `edges` (src, dst: long) reaches: (node, component).

    Alternates the large-star and small-star steps until the edges stay as they are, which takes a number of rounds
    that grows with the logarithm of the longest path. Each round's edges are written to the shared folder. Self loops
    and repeats count for nothing; nodes without an edge to another aren't returned; nulls aren't edges.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0:
            return spark.createDataFrame([], "node long, component long")
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        old, now = now, materialize(small.where("u <> v").distinct())
        discard(old)
    raise RuntimeError("the components did not settle")
