"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from visitseq.sources.scratch import drop_table, materialize, scratch_path


def components(edges: DataFrame, one: str, other: str) -> DataFrame:
    """``one``, root: the smallest node each node hangs together with, for nodes with an edge.

    A round links every larger neighbour of a node, then every smaller one, to the smallest
    (Kiveris et al. 2014); the number of rounds grows with the logarithm of the largest
    component. Each round is written, so a round never repeats the ones before it.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    now = materialize(edges.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v"))
                      .filter("u <> v").distinct(), path=path)
    state = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = (near.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        last, path = path, scratch_path(spark, "edges")
        now = materialize(small, path=path)
        drop_table(spark, last)
        was, state = state, _state(now)
        if was == state:
            return now.select(F.col("u").alias(one), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
