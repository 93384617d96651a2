"""Writing: append-only logs, derived tables, captures, feeds and purges, each by its declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from wardlight.sources.tables import exists, move, remove


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` by the declared schema: order and types as declared, missing columns null, others dropped."""
    have = set(df.columns)
    filled = df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return filled.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, empty if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str, schema: T.StructType) -> None:
    conform(df, schema).write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str, schema: T.StructType) -> None:
    """A derived table written anew; ``df`` must not read from ``path``."""
    conform(df, schema).write.mode("overwrite").parquet(path)


def upsert_settings(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Settings are appended with their ordinal; readers take the latest of each key."""
    append(df, path, schema)


def fan_out(docs: DataFrame, batch: str, targets: Sequence[tuple[DataFrame, str, T.StructType]]) -> None:
    """One batch to several tables, each row with the batch id; the source is kept while they are written."""
    docs.persist()
    try:
        for df, path, schema in targets:
            append(df.withColumn("batch", F.lit(batch)), path, schema)
    finally:
        docs.unpersist()


def capture(df: DataFrame, path: str, day: str, last_id: int) -> None:
    """An immutable capture in its own folder, named by day and last id, so that a rerun writes the same rows there again."""
    df.write.mode("overwrite").parquet(f"{path}/capture_date={day}/batch={last_id}")


def feed(pages: DataFrame, path: str, per_folder: int = 1000) -> None:
    """Feed rows in order, ``per_folder`` pages a folder, so that a long feed is few files; a page is read by folder and number."""
    rows = pages.withColumn("pages", F.floor((F.col("page") - 1) / per_folder))
    rows.repartitionByRange("pages", "rn").sortWithinPartitions("pages", "rn").write.mode("overwrite").partitionBy("pages").parquet(path)


def publish(df: DataFrame, path: str, schema: T.StructType, ratio: float = 0.9) -> bool:
    """Rebuild a table unless it would lose more than a tenth of its rows; whether it was written."""
    spark = df.sparkSession
    fresh = conform(df, schema).persist()
    try:
        if fresh.count() < ratio * stored(spark, path, schema).count():
            return False
        fresh.write.mode("overwrite").parquet(path)
        return True
    finally:
        fresh.unpersist()


def purge(spark: SparkSession, paths: Sequence[str], schemas: Sequence[T.StructType], ids: DataFrame, key: str = "doc_id") -> None:
    """Rows of given ids out of every table: each is written beside itself and put in its place by renaming.

    A run that broke off between the two renames left the whole table under ``.old``; the next one puts that back first.
    """
    for path, schema in zip(paths, schemas, strict=True):
        old, fresh = f"{path}.old", f"{path}.next"
        if exists(spark, old) and not exists(spark, path):
            move(spark, old, path)
        kept = stored(spark, path, schema).join(ids.select(key).distinct(), key, "left_anti")
        conform(kept, schema).write.mode("overwrite").parquet(fresh)
        remove(spark, old)
        if exists(spark, path):
            move(spark, path, old)
        move(spark, fresh, path)
        remove(spark, old)
