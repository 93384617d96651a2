import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from wardlight.operators import readings as r
from wardlight.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def landed_files(spark, tmp_path):
    """Three files of readings by insertion id; some stamps are late."""
    rng = random.Random(8)
    rows = []
    for k in range(240):
        late = 30 if k % 37 == 0 else 0
        rows.append((k + 1, f"MS-{k % 3}", T0 + dt.timedelta(minutes=30 * k - 60 * late), rng.choice([10.0, 80.0, 999.0, None, 71.0]), rng.choice([1.0, 45.0, 600.0]), None))
    path = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame(rows[80 * n : 80 * n + 80], jobs.READING).coalesce(1).write.mode("append").parquet(path)
    return rows, path, tmp_path


def test_sliding_average_equals_batch_over_closed_windows(spark, landed_files):
    rows, path, tmp = landed_files
    got = []
    jobs.drain(jobs.sliding_average(jobs.source(spark, path)), lambda df, n: got.extend(df.collect()), str(tmp / "c1"))
    batch = {(x.station, x.start): (x.avg, x.n) for x in jobs.sliding_average(spark.read.schema(jobs.READING).parquet(path)).collect()}
    assert got and all(batch[x.station, x.start] == (x.avg, x.n) for x in got)
    last = max(t for _, _, t, *_ in rows)
    assert {(x.station, x.start) for x in got} >= {k for k in batch if k[1] + dt.timedelta(hours=24) < last - dt.timedelta(days=3)}


def test_episodes_equal_batch_whatever_the_order(spark, landed_files):
    rows, path, tmp = landed_files
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.read.schema(jobs.READING).parquet(path)
    shuffled = str(tmp / "shuffled")
    mixed = df.withColumn("k", F.xxhash64("oid"))
    for part in range(4):  # files in no order of time, and a last one far behind them all
        mixed.where(F.pmod("k", F.lit(4)) == part).orderBy("k").drop("k").coalesce(1).write.mode("append").parquet(shuffled)
    end = df.agg(F.max("ts")).first()[0] + dt.timedelta(days=400)
    spark.createDataFrame([(None, "", end, None, None, None)], jobs.READING).coalesce(1).write.mode("append").parquet(shuffled)
    got = []
    jobs.drain(jobs.episode_events(jobs.source(spark, shuffled, files=1), late="365 days"), lambda df, n: got.extend(df.collect()), str(tmp / "c2"))
    usable = df.where("h2s is not null and h2s <> 999")
    want = {(x.station, x.opened_oid, x.recovered_oid) for x in r.episodes(usable, usable.h2s >= 72, usable.h2s < 72).collect()}
    opened = {(x.station, x.opened_oid) for x in got if x.recovered_oid is None}
    assert opened == {w[:2] for w in want} and want
    assert {(x.station, x.opened_oid, x.recovered_oid) for x in got if x.recovered_oid is not None} == {w for w in want if w[2] is not None}


def test_poll_starts_silently_and_reruns_alike(spark, landed_files):
    rows, path, tmp = landed_files
    out = str(tmp / "out")
    jobs.poll(jobs.source(spark, path), out, str(tmp / "c3")).awaitTermination()
    alerts = spark.read.parquet(f"{out}/alerts")
    captured = spark.read.parquet(f"{out}/capture")
    kept = {x.oid for n in (1, 2) for x in r.captured(spark.createDataFrame(rows[80 * n : 80 * n + 80], jobs.READING)).collect()}
    assert {"monitor_id", "timestamp", "h2s_ppb", "wind_speed"} <= set(captured.columns)
    loud = {x[0] for x in rows if x[0] > 80 and (x[4] >= 40 or (x[3] is not None and x[3] != 999 and x[3] >= 72))}
    got = {x.oid for x in captured.collect()}
    assert loud <= got == kept and captured.count() == len(got) < 160
    total = captured.count()
    assert alerts.where("batch = 0").count() == 0 and alerts.count() > 0
    status = spark.read.parquet(f"{out}/status")
    assert status.select("batch").distinct().count() == 3
    jobs.poll(jobs.source(spark, path), out, str(tmp / "c3")).awaitTermination()
    assert spark.read.parquet(f"{out}/capture").count() == total
    assert spark.read.parquet(f"{out}/measurements").where("metric = 'methane' and value = 600").count() > 0


def test_weeks_and_days(spark, landed_files):
    rows, path, tmp = landed_files
    week = jobs.weekly_flush(spark.read.schema(jobs.READING).parquet(path).selectExpr("ts", "'digest' as route")).collect()
    assert all(x.week.weekday() == 0 for x in week) and sum(x.n for x in week) == 240
    day = jobs.daily_counts(spark.read.schema(jobs.READING).parquet(path)).collect()
    assert sum(x.n for x in day) == 240 and sum(x.n_urgent for x in day) == sum(1 for x in rows if x[4] >= 500 or (x[3] is not None and x[3] != 999 and x[3] >= 72))


def test_silence_is_told_once_and_rearmed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path, oid = str(tmp_path / "in"), 0
    for hours in ([("a", 0), ("b", 0)], [("b", 10)], [("b", 20)], [("b", 21), ("a", 22)], [("b", 50)], [("b", 60)]):
        rows = [(oid + k, s, T0 + dt.timedelta(hours=h), 1.0, 1.0, None) for k, (s, h) in enumerate(hours)]
        oid += len(rows)
        spark.createDataFrame(rows, jobs.READING).coalesce(1).write.mode("append").parquet(path)
    got = []
    jobs.drain(jobs.silences(jobs.source(spark, path), 8), lambda df, n: got.extend(df.collect()), str(tmp_path / "c"))
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    silent = sorted((x.as_of_ms - start) // 3_600_000 for x in got if x.station == "a")
    assert silent == [0, 22]
