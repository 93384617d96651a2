"""Places in an order of the whole table, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.sources.tables import written


def placed(df: DataFrame, parts: list[str], order: list[Column], name: str = "place", per_bucket: int = 262_144) -> DataFrame:
    """``df`` with each row's place (from 1) in ``order`` within its ``parts``.

    Rows are dealt by Spark's range partitioning into buckets of about ``per_bucket`` rows; bucket counts give offsets, and
    only a bucket is sorted in one task. ``order`` must tell all rows apart.
    """
    buckets = max(1, -(-df.count() // per_bucket))
    ranged = written(df.repartitionByRange(buckets, *map(F.col, parts), *order).withColumn("_bucket", F.spark_partition_id()), "placed")
    counts = ranged.groupBy(*parts, "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*parts).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*parts, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy(*parts, "_bucket").orderBy(*order))
    return ranged.join(offsets, [*parts, "_bucket"]).withColumn(name, F.col("_before") + nth).drop("_bucket", "_before")
