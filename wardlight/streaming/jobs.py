"""Structured Streaming jobs over landed readings and filings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardlight.operators import readings as r
from wardlight.sources import sinks

READING = T.StructType(
    [
        T.StructField("oid", T.LongType()),
        T.StructField("station", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("h2s", T.DoubleType()),
        T.StructField("ch4", T.DoubleType()),
        T.StructField("h2s_text", T.StringType()),
    ]
)
MEASURE = T.StructType([T.StructField(n, t) for n, t in (("oid", T.LongType()), ("station", T.StringType()), ("metric", T.StringType()), ("value", T.DoubleType()), ("unit", T.StringType()), ("as_of", T.StringType()), ("note", T.StringType()))])
STATUS = T.StructType([T.StructField(n, t) for n, t in (("station", T.StringType()), ("oid", T.LongType()), ("ts", T.TimestampType()), ("h2s", T.DoubleType()), ("ch4", T.DoubleType()), ("severity", T.StringType()))])
CAPTURE = T.StructType([T.StructField("monitor_id", T.StringType()), T.StructField("timestamp", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("h2s_ppb", "ch4_ppm", "wind_direction", "wind_speed", "temp")], T.StructField("oid", T.LongType())])
ALERT = T.StructType([T.StructField(n, t) for n, t in (("oid", T.LongType()), ("station", T.StringType()), ("line", T.StringType()))])


def source(spark: SparkSession, path: str, schema: T.StructType = READING, files: int = 1) -> DataFrame:
    """Landed Parquet files as a stream. Files are taken by arrival, so rows with old stamps are never missed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def poll(stream: DataFrame, out: str, checkpoint: str, cap: int = 100_000) -> StreamingQuery:
    """Each batch: measurements, then capture, then status, then alerts; the checkpoint moves last.

    A batch of more than ``cap`` rows, or the first one of all, sets the status silently. Folders are
    named by batch, so a batch that is run again writes the same rows in the same place.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            n = batch.limit(cap + 1).count()
            if not n:
                return
            quiet = number == 0 or n > cap
            classed = r.classify(batch)
            put = lambda df, name, schema: sinks.conform(df, schema).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
            if not quiet:
                put(r.digest_rows(r.long_form(batch), {p.metric: p.action for p in (r.H2S, r.CH4)}), "measurements", MEASURE)
                put(r.captured(batch), "capture", CAPTURE)
            put(r.latest(classed, ["station"], "oid"), "status", STATUS)
            if not quiet:
                put(r.alert_lines(batch), "alerts", ALERT)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_panes(readings: DataFrame, late: str = "2 days", slide: str = "1 hour") -> DataFrame:
    """Sums and counts of usable hydrogen sulfide values by station and hour, of which sliding means are made; late rows count up to the watermark.

    Values are added as decimals (to a millionth), so sums don't depend on the order of rows.
    """
    usable = readings.where(F.col("h2s").isNotNull() & (F.col("h2s") != r.H2S.sentinel))
    usable = usable.withWatermark("ts", late) if readings.isStreaming else usable
    return usable.groupBy(F.window("ts", slide).alias("pane"), "station").agg(F.sum(F.col("h2s").cast("decimal(28,6)")).alias("sum"), F.count("*").alias("n"))


def sliding_means(panes: DataFrame, size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Mean and count by station in sliding windows, from ``hourly_panes``: a pane, not a reading, goes to each window that holds it.

    On a stream it is a second aggregation behind the first one, in append mode.
    """
    placed = panes.select("station", "sum", "n", F.window(F.window_time("pane") if panes.isStreaming else F.col("pane.start"), size, slide).alias("w"))
    sums = placed.groupBy("w", "station").agg((F.sum("sum").cast("double") / F.sum("n")).alias("avg"), F.sum("n").alias("n"))
    return sums.select("station", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "avg", "n")


def sliding_average(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """Mean and count of usable hydrogen sulfide values by station in windows of a day that begin each hour."""
    return sliding_means(hourly_panes(readings, late))


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Readings and exceedances of each station and day."""
    rows = r.classify(stream).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day"), "station").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "urgent").alias("n_urgent")).select("station", F.col("window.start").alias("day"), "n", "n_urgent")


def weekly_flush(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Pending digest items counted by week; weeks start on Monday, so they close after Sunday."""
    rows = stream.withWatermark("ts", late)
    # windows of a week start at the epoch, a Thursday: four days on is a Monday
    return rows.groupBy(F.window("ts", "7 days", "7 days", "4 days"), "route").agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), "route", "n")


ROW_STATE = T.StructType([T.StructField("ms", T.LongType()), T.StructField("oid", T.LongType()), T.StructField("over", T.BooleanType())])


class Episodes(StatefulProcessor):
    """Alerts of one station: one when the level is reached, none until a reading below it; silence changes nothing.

    Readings come in chunks in any order and wait in the state until the watermark has passed them; then they count in the order
    of their stamps and ids. The state is the open alert and what waits, which the lateness bounds; chunks aren't put together.
    """

    def __init__(self, level: float, sentinel: float):
        self.level, self.sentinel = level, sentinel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("oid", T.LongType())]))
        self.waiting = handle.getListState("waiting", ROW_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[part["h2s"].notna() & (part["h2s"] != self.sentinel) & part["ts"].notna()]
            if len(part):
                ms = part["ts"].astype("datetime64[ms]").astype("int64")
                self.waiting.appendList([(int(t), int(o), bool(v >= self.level)) for t, o, v in zip(ms, part["oid"], part["h2s"], strict=True)])
                first = int(ms.min()) if first is None else min(first, int(ms.min()))
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame({"station": pd.Series(dtype="str"), "opened_oid": pd.Series(dtype="Int64"), "recovered_oid": pd.Series(dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] <= passed else later).append(tuple(row))
        began = self.open.get()[0] if self.open.exists() else None
        out = []
        for _, oid, over in sorted(due):
            if over and began is None:
                began = oid
                out.append((key[0], began, None))
            elif not over and began is not None:
                out.append((key[0], began, oid))
                began = None
        if began is None:
            self.open.clear()
        else:
            self.open.update((began,))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(later)[0])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["station", "opened_oid", "recovered_oid"]).astype({"opened_oid": "Int64", "recovered_oid": "Int64"})

    def close(self) -> None:
        pass


def episode_events(stream: DataFrame, level: float = 72.0, sentinel: float = 999.0, late: str = "2 days") -> DataFrame:
    """Openings (no recovery yet) and recoveries of alert episodes, as the watermark passes them; readings later than ``late`` are dropped."""
    shape = "station string, opened_oid long, recovered_oid long"
    rows = stream.select("station", "ts", "oid", "h2s").withWatermark("ts", late)
    return rows.groupBy("station").transformWithStateInPandas(Episodes(level, sentinel), shape, "Append", "EventTime")


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that has landed, then stop."""
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Liveness(StatefulProcessor):
    """One row when a station has been silent for a time, once for each silence; a later reading arms it again."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = max(int(part["ts"].max().value // 1_000_000) for part in rows)
        known = self.newest.get()[0] if self.newest.exists() else None
        if known is None or seen > known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.newest.update((seen,))
            self.handle.registerTimer(seen + self.silence_ms)
        yield pd.DataFrame({"station": pd.Series(dtype="str"), "as_of_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"station": [key[0]], "as_of_ms": [self.newest.get()[0]]})

    def close(self) -> None:
        pass


def silences(stream: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """Stations without a reading for ``hours`` of event time, told by the watermark of all stations."""
    rows = stream.select("station", "ts").withWatermark("ts", late)
    return rows.groupBy("station").transformWithStateInPandas(Liveness(hours * 3_600_000), "station string, as_of_ms long", "Append", "EventTime")
