"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests), a temporary folder is set for it; a cluster without one is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    kept = spark.sparkContext.getCheckpointDir()
    if not kept and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not kept:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Paths given out by ``scratch``, by application.
_MADE: dict[str, list[str]] = {}


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a folder within its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(old).getFileSystem(spark._jsc.hadoopConfiguration()).rename(place(old), place(new))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one go."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def mark(spark: SparkSession) -> int:
    """How many intermediate tables have been written, for ``discard``."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int, keep: Sequence[str] = ()) -> None:
    """Deletes the intermediate tables written since a ``mark``, but for those with the labels in ``keep``; for steps whose results no longer read them."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone = [p for p in made[since:] if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in keep]
    for path in gone:
        remove(spark, path)
        made.remove(path)


def clear(spark: SparkSession) -> int:
    """Deletes all intermediate tables that this application has written; for callers that are done with every result."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
