"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.sources.tables import remove, scratch


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``edges`` holds (big, small) with big > small."""
    both = edges.union(edges.select(F.col("small").alias("big"), F.col("big").alias("small")))
    least = both.groupBy("big").agg(F.min("small").alias("m")).select(F.col("big").alias("at"), F.least("m", "big").alias("m"))
    # every larger neighbour of a node goes to the least node around it
    large = edges.select(F.col("small").alias("at"), F.col("big").alias("v")).join(least, "at").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
    low = large.groupBy("big").agg(F.min("small").alias("m"))
    # every smaller neighbour of a node, and the node itself, goes to the least of them
    small = large.join(low, "big").select(F.col("small").alias("big"), F.col("m").alias("small"))
    kept = low.select("big", F.col("m").alias("small"))
    return small.union(kept).where("big > small").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (least node reachable) of each node that an edge touches and that is not a root.

    Each round is written to the shared folder and the one before deleted; the driver sees a count and a hash of it. Edges with
    a null end or equal ends are no edges. Ends when a round changes nothing; raises after ``rounds``.
    """
    valid = edges.where(F.col(left) != F.col(right))
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = kept(valid.select(F.greatest(left, right).alias("big"), F.least(left, right).alias("small")).distinct())

    def mark(df: DataFrame) -> tuple:
        # sums of hashes as decimals: no order, no overflow
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        last = path
        now, path = kept(_round(now))
        remove(spark, last)  # nothing reads it any more
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("big").alias("node"), F.col("small").alias("root"))
