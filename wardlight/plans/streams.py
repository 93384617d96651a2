"""Queries that run as streams over readings landed in two halves; each stream takes all that has landed, then stops."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.plans.readings import BASE, lines_sql
from wardlight.plans.registry import query
from wardlight.sources import views
from wardlight.sources.tables import scratch, table
from wardlight.streaming import jobs

EVERY_FILE = 2**31 - 1
HALF = "(SELECT max(event_id) // 2 FROM events)"


def _drained(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A stream's whole result, each batch replacing the last one's."""
    path = scratch(spark, name)
    jobs.drain(df, lambda batch, number: batch.write.mode("overwrite").parquet(path), scratch(spark, f"{name}-state"), "complete")
    return spark.read.schema(df.schema).parquet(path)


@query(
    "stream_poll_alerts",
    f"SELECT * FROM ({lines_sql(True)}) WHERE oid > {HALF}",
)
def stream_poll_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the second poll; the first one only sets the baseline. Rows come by arrival, so late stamps count."""
    rows = views.readings(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in jobs.READING.fields])
    half = (rows.agg(F.max("oid")).first()[0] or 0) // 2
    path, out, state = (scratch(spark, n) for n in ("poll-in", "poll-out", "poll-state"))
    for part in (F.col("oid") <= half, F.col("oid") > half):
        rows.where(part).write.mode("append").parquet(path)
        jobs.poll(jobs.source(spark, path, files=EVERY_FILE), out, state, cap=EVERY_FILE - 1).awaitTermination()
    shape = T.StructType([*jobs.ALERT.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(shape).parquet(f"{out}/alerts").select("oid", "station", "line")


MEANS = f"""{BASE}, u AS (SELECT station, ts, h2s FROM readings WHERE h2s IS NOT NULL AND h2s <> 999),
w AS (SELECT station, date_trunc('hour', ts) - to_hours(CAST(k AS INT)) AS start, h2s FROM u, range(24) r(k))
SELECT station, start, start + INTERVAL 24 HOURS AS "end", round(CAST(sum(CAST(h2s AS DECIMAL(28, 6))) AS DOUBLE) / count(*), 6) AS avg, count(*) AS n FROM w GROUP BY station, start"""


@query("stream_sliding_mean", MEANS)
def stream_sliding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream keeps panes, a row a station and hour; means are made of these."""
    rows = views.readings(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in jobs.READING.fields])
    path = scratch(spark, "mean-in")
    rows.write.parquet(path)
    panes = _drained(spark, jobs.hourly_panes(jobs.source(spark, path, files=EVERY_FILE)), "panes")
    return jobs.sliding_means(panes).withColumn("avg", F.round("avg", 6))


STORE = "spark.sql.streaming.stateStore.providerClass"


def _landed_until(spark: SparkSession, sf_dir: str, parts: int) -> tuple[str, int]:
    """Readings landed in ``parts`` files in no order of time, and last a reading of no station long after them, which moves the watermark past all others; the number of files."""
    rows = views.readings(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in jobs.READING.fields])
    path = scratch(spark, "stream-in")
    rows.repartition(parts, "oid").write.parquet(path)
    end = rows.agg(F.max("ts")).first()[0]
    if end is not None:
        last = spark.createDataFrame([(None, "", end + dt.timedelta(days=60), None, None, None)], jobs.READING)
        last.coalesce(1).write.mode("append").parquet(path)
    return path, parts


def _appended(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """All that a stream appends, by batch; its states are kept by RocksDB, which timers need."""
    path, before = scratch(spark, name), spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        jobs.drain(df, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), scratch(spark, f"{name}-state"))
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(df.schema).option("basePath", path).parquet(f"{path}/batch=*").select(*df.columns)


@query(
    "stream_episodes",
    f"""{BASE},
m AS (SELECT station, ts, oid, h2s >= 72 AS s FROM readings WHERE h2s IS NOT NULL AND h2s <> 999),
t AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY station ORDER BY ts, oid), false) AS b FROM m),
o AS (SELECT *, lead(oid) OVER (PARTITION BY station ORDER BY ts, oid) AS recovered_oid FROM t WHERE s <> b)
SELECT station, oid AS opened_oid, recovered_oid FROM o WHERE s""",
)
def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert episodes from readings that arrive in no order; an opening and its recovery are events of their own."""
    path, files = _landed_until(spark, sf_dir, 3)
    found = _appended(spark, jobs.episode_events(jobs.source(spark, path, files=files), late="60 days"), "episodes")
    return found.groupBy("station", "opened_oid").agg(F.max("recovered_oid").alias("recovered_oid"))


@query("stream_silences", f"{BASE} SELECT station, epoch_us(max(ts)) // 1000 AS as_of_ms FROM readings GROUP BY station")
def stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations silent for two days when readings end: all of them, each told once."""
    path, files = _landed_until(spark, sf_dir, 1)
    found = _appended(spark, jobs.silences(jobs.source(spark, path, files=files), 48), "silences")
    return found.where("station <> ''")


@query("sliding_mean", MEANS)
def sliding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sliding_means(jobs.hourly_panes(views.readings(spark, sf_dir))).withColumn("avg", F.round("avg", 6))


@query(
    "stream_weekly_flush",
    "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, CASE WHEN user_id % 5 = 0 THEN 'alert' ELSE 'digest' END AS route, count(*) AS n FROM events GROUP BY ALL",
)
def stream_weekly_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 5 == 0, "alert").otherwise("digest").alias("route"))
    path = scratch(spark, "weeks-in")
    rows.write.parquet(path)
    return _drained(spark, jobs.weekly_flush(jobs.source(spark, path, rows.schema, EVERY_FILE)), "weekly-flush")
