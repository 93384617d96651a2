"""Sensor readings: classes, long form, peaks, averages, thinning and alert episodes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.functions import scalars as S
from wardlight.sources.tables import written


@dataclass(frozen=True)
class Pollutant:
    """A measured column with its levels; ``watch`` is an optional lower level."""

    column: str
    metric: str
    unit: str
    action: float | None
    watch: float | None
    sentinel: float | None


H2S = Pollutant("h2s", "hydrogen_sulfide", "ppb", 72.0, None, 999.0)
CH4 = Pollutant("ch4", "methane", "ppm", 500.0, 40.0, 99999.0)
RANKS = ("ok", "anomaly", "watch", "urgent")


def status(p: Pollutant) -> Column:
    """``missing``, ``sentinel``, ``exceedance``, ``watch`` or ``ok`` of one pollutant."""
    v = F.col(p.column)
    found = F.when(v.isNull() | F.isnan(v), "missing")
    if p.sentinel is not None:
        found = found.when(v == p.sentinel, "sentinel")
    if p.action is not None:
        found = found.when(v >= p.action, "exceedance")
    if p.watch is not None:
        found = found.when(v >= p.watch, "watch")
    return found.otherwise("ok")


def reason(p: Pollutant) -> Column:
    """Why a pollutant's reading counts: a struct of ``column``, ``status``, ``value``, the ``level`` it reaches and the ``action`` level; null if it doesn't."""
    found = F.col(f"{p.column}_status")
    level = F.when(found == "exceedance", F.lit(p.action)).when(found == "watch", F.lit(p.watch)).cast("double")
    told = F.struct(F.lit(p.column).alias("column"), found.alias("status"), F.col(p.column).cast("double").alias("value"), level.alias("level"), F.lit(p.action).cast("double").alias("action"))
    return F.when(found.isin("exceedance", "watch", "sentinel"), told)


def classify(df: DataFrame, pollutants: Sequence[Pollutant] = (H2S, CH4)) -> DataFrame:
    """Adds ``<column>_status`` for each pollutant, the worst ``severity``, ``reasons`` (structs by pollutant, see ``reason``) and ``n_reasons``."""
    df = df.withColumns({f"{p.column}_status": status(p) for p in pollutants})
    ranks = [F.when(F.col(f"{p.column}_status") == "exceedance", 3).when(F.col(f"{p.column}_status") == "watch", 2).when(F.col(f"{p.column}_status") == "sentinel", 1).otherwise(0) for p in pollutants]
    worst = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    df = df.withColumn("severity", F.get(F.lit(list(RANKS)), worst)).withColumn("reasons", F.filter(F.array(*map(reason, pollutants)), lambda r: r.isNotNull()))
    return df.withColumn("n_reasons", F.size("reasons"))


def told(r: Column) -> Column:
    """A reason in words."""
    name, value, level = F.upper(r["column"]), S.compact_number(r["value"]), S.compact_number(r["level"])
    below = F.when(r["action"].isNotNull(), F.concat(F.lit(", below the action level "), S.compact_number(r["action"]))).otherwise("")
    return (
        F.when(r["status"] == "exceedance", F.concat(name, F.lit("="), value, F.lit(" reaches the action level "), level))
        .when(r["status"] == "watch", F.concat(name, F.lit("="), value, F.lit(" reaches the watch level "), level, below))
        .otherwise(F.concat(name, F.lit("="), value, F.lit(" is a sentinel")))
    )


def alert_lines(df: DataFrame, pollutants: Sequence[Pollutant] = (H2S, CH4), averaged: Sequence[str] = ("h2s",), on_sentinel: bool = True, with_watch: bool = True) -> DataFrame:
    """Readings worth a line, with ``line``: kind, station, minute and reasons in order.

    Pollutants in ``averaged`` have their action level judged by a mean elsewhere, so a single hour of theirs isn't one here.
    Without ``on_sentinel`` anomalies go, and sentinels aren't told beside other reasons; without ``with_watch`` readings that only reach a
    watch level go.
    """
    rows = classify(df, [replace(p, action=None) if p.column in averaged else p for p in pollutants])
    wanted = ["urgent", *(["watch"] if with_watch else []), *(["anomaly"] if on_sentinel else [])]
    shown = F.col("reasons") if on_sentinel else F.filter("reasons", lambda r: r["status"] != "sentinel")
    kind = F.when(F.col("severity") == "urgent", "EXCEEDANCE").otherwise(F.col("severity"))
    line = F.concat_ws(" ", kind, "station", F.concat(F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("")), F.lit(":")), F.array_join(F.transform(shown, told), "; "))
    return rows.where(F.col("severity").isin(wanted)).withColumn("line", line)


def levels_are_sane(thresholds: DataFrame) -> DataFrame:
    """Watch levels that aren't below their action level, with the reason."""
    return thresholds.where(F.col("watch") >= F.col("action")).withColumn("problem", F.lit("watch level is not below the action level"))


def stations(df: DataFrame, prefix: str = "MS-") -> DataFrame:
    return df.where(F.col("station").startswith(prefix))


def long_form(df: DataFrame, pollutants: Sequence[Pollutant] = (H2S, CH4), prefix: str = "MS-") -> DataFrame:
    """One row for each usable value of a watched station: metric, value, unit, minute stamp and note."""
    kept = stations(df, prefix)
    pairs = F.array(*[F.struct(F.lit(p.metric).alias("metric"), F.col(p.column).alias("value"), F.lit(p.unit).alias("unit"), F.lit(p.sentinel).cast("double").alias("sentinel")) for p in pollutants])
    rows = kept.select("oid", "station", "ts", "h2s_text", F.explode(pairs).alias("m")).select("oid", "station", "ts", "h2s_text", "m.*")
    rows = rows.where(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("sentinel")))
    note = F.concat_ws("; ", F.lit("fenceline"), F.when((F.col("metric") == H2S.metric) & F.col("h2s_text").isNotNull(), F.col("h2s_text")))
    return rows.select("oid", "station", "metric", "value", "unit", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("as_of"), note.alias("note"))


def last_writer(long: DataFrame) -> DataFrame:
    """The latest inserted row of each (station, metric, stamp)."""
    return _picked(long, ["station", "metric", "as_of"], F.max_by(F.struct("oid", "value", "unit", "note"), "oid"))


def daily_peaks(long: DataFrame) -> DataFrame:
    """The largest value of each (station, metric, day); the first inserted wins ties."""
    day = long.withColumn("day", F.substring("as_of", 1, 10))
    return _picked(day, ["station", "metric", "day"], F.max(F.struct("value", (-F.col("oid")).alias("neg"), "oid", "unit", "as_of", "note"))).drop("neg")


def _picked(df: DataFrame, keys: list[str], best: Column) -> DataFrame:
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def digest_rows(long: DataFrame, levels: dict[str, float]) -> DataFrame:
    """Daily peaks and every value at its level or above, one row for each (station, metric, stamp)."""
    over = F.coalesce(*[F.when(F.col("metric") == m, F.col("value") >= v) for m, v in levels.items()], F.lit(False))
    columns = ["station", "metric", "as_of", "oid", "value", "unit", "note"]
    return last_writer(daily_peaks(long).select(*columns).unionByName(long.where(over).select(*columns)))


def trailing_average(df: DataFrame, asof: str, hours: int = 24, pollutant: Pollutant = H2S) -> DataFrame:
    """Per station the mean and count of usable values later than ``hours`` before ``asof``; later ones count as well."""
    since = F.to_timestamp(F.lit(asof)) - F.expr(f"INTERVAL {hours} HOURS")
    usable = df.where((F.col("ts") > since) & F.col(pollutant.column).isNotNull() & (F.col(pollutant.column) != F.lit(pollutant.sentinel)))
    return usable.groupBy("station").agg(F.round(F.avg(pollutant.column), 6).alias("avg"), F.count("*").alias("n"))


def average_alerts(averages: DataFrame, level: float, least: int) -> DataFrame:
    """``alert`` at the level with enough readings, ``suppressed`` with too few, else ``quiet``."""
    over = F.col("avg") >= level
    return averages.withColumn("outcome", F.when(over & (F.col("n") >= least), "alert").when(over, "suppressed").otherwise("quiet"))


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def cursor(df: DataFrame, column: str = "oid") -> DataFrame:
    """The largest id compared as a number, whatever its type."""
    return df.agg(F.max(F.expr(f"try_cast(`{column}` AS bigint)")).alias("cursor"))


def thinned(df: DataFrame, calm: Column, hours: float = 8.0, per_part: int = 262_144) -> DataFrame:
    """All elevated rows, and of the calm ones each that is ``hours`` or more later than the last calm row kept, by station in the order of ids.

    Calm rows alone move the clock; rows without a stamp stay. A row can be kept only if its stamp passes all before it, as the
    clock is never more than ``hours`` behind the latest stamp. So each part of about ``per_part`` rows of a station, in the order of ids,
    is a map from the clock before it to the clock behind it, which needs an entry for each of its rising stamps within ``hours``
    of the latest stamp before it, and one more. A walk over these maps (a row a part) gives each part its clock, and parts are then
    walked apart, so no task has a station's history. Elevated rows don't move. Rows alike in station and id are kept together.
    """
    gap = int(hours * 3600 * 10**6)
    quiet = F.coalesce(calm, F.lit(False)) & F.col("ts").isNotNull()
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") if df.schema["ts"].dataType.simpleString() == "timestamp_ntz" else F.unix_micros("ts")
    rows = df.where(quiet).select("station", "oid", us.alias("us"))
    parts = max(1, -(-rows.count() // per_part))
    placed = rows.repartitionByRange(parts, "station", "oid", "us").withColumn("part", F.spark_partition_id())
    placed = written(placed, "thinned-rows")
    tops = placed.groupBy("station", "part").agg(F.max("us").alias("top"))
    earlier = W.partitionBy("station").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    tops = tops.select(F.col("station").alias("_station"), F.col("part").alias("_part"), F.max("top").over(earlier).alias("before"))
    joined = written(placed.join(tops, F.col("station").eqNullSafe(F.col("_station")) & (F.col("part") == F.col("_part"))).drop("_station", "_part"), "thinned-parts")

    def rising(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int | None]:
        """Stamps that pass all before them in the order of ids, their rows, and the latest stamp before the part."""
        order = table.select(["oid", "us"]).append_column("n", pa.array(range(table.num_rows))).sort_by([("oid", "ascending"), ("us", "ascending")])
        us, n = order.column("us").to_numpy(), order.column("n").to_numpy()
        before = table.column("before")[0].as_py()
        seen = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min if before is None else before], us]))[:-1]
        up = us > seen
        return us[up], n[up], before

    def mapped(key: tuple, table: pa.Table) -> pa.Table:
        us, _, before = rising(table)
        following = np.searchsorted(us, us + gap)
        last = us.copy()
        for k in range(len(us) - 1, -1, -1):
            if following[k] < len(us):
                last[k] = last[following[k]]
        n = min(len(us), 1 if before is None else int(np.searchsorted(us, before + gap)) + 1)
        return pa.table({"station": pa.array([key[0].as_py()], pa.string()), "part": pa.array([key[1].as_py()], pa.int32()), "enter": pa.array([us[:n].tolist()], pa.list_(pa.int64())), "leave": pa.array([last[:n].tolist()], pa.list_(pa.int64()))})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, clock = ..., None
        for batch in batches:
            found = []
            for station, enter, leave in zip(*(batch.column(c).to_pylist() for c in ("station", "enter", "leave")), strict=True):
                if station != at:
                    at, clock = station, None
                found.append(clock)
                k = 0 if clock is None else bisect_left(enter, clock + gap)
                clock = leave[k] if k < len(leave) else clock
            yield pa.RecordBatch.from_arrays([batch.column("station"), batch.column("part"), pa.array(found, pa.int64())], names=["_station", "_part", "clock"])

    def kept(table: pa.Table) -> pa.Table:
        us, n, _ = rising(table)
        clock, found = table.column("clock")[0].as_py(), []
        k = 0 if clock is None else int(np.searchsorted(us, clock + gap))
        while k < len(us):
            found.append(int(n[k]))
            k = int(np.searchsorted(us, us[k] + gap))
        return table.select(["station", "oid"]).take(pa.array(found, pa.int64()))

    maps = joined.groupBy("station", "part").applyInArrow(mapped, "station string, part int, enter array<long>, leave array<long>")
    clocks = maps.repartition("station").sortWithinPartitions("station", "part").mapInArrow(walked, "_station string, _part int, clock long")
    timed = joined.join(written(clocks, "thinned-clocks"), F.col("station").eqNullSafe(F.col("_station")) & (F.col("part") == F.col("_part"))).drop("_station", "_part")
    kind = df.schema["oid"].dataType.simpleString()
    some = timed.groupBy("station", "part").applyInArrow(kept, f"station string, oid {kind}").select(F.col("station").alias("_station"), F.col("oid").alias("_oid"))
    sparse = df.where(quiet).join(some, F.col("station").eqNullSafe(F.col("_station")) & (F.col("oid") == F.col("_oid")), "left_semi")
    return df.where(~quiet).unionByName(sparse)


def capture_rows(df: DataFrame) -> DataFrame:
    """Readings as they are kept for good: raw values under their public names, missing ones null."""
    have = set(df.columns)
    names = {"station": "monitor_id", "as_of": "timestamp", "h2s": "h2s_ppb", "ch4": "ch4_ppm", "direction": "wind_direction", "speed": "wind_speed", "temp": "temp", "oid": "oid"}
    rows = df.withColumn("as_of", F.date_format("ts", "yyyy-MM-dd HH:mm")) if "as_of" not in have else df
    return rows.select(*[F.col(a).alias(b) if a in have or a == "as_of" else F.lit(None).cast("double").alias(b) for a, b in names.items()])


def captured(df: DataFrame, hours: float = 8.0, prefix: str = "MS-") -> DataFrame:
    """Which readings of a poll are kept for good: every exceedance or watch of a watched station, and of the rest one in ``hours``."""
    rows = classify(stations(df, prefix))
    calm = ~F.col("h2s_status").isin("exceedance", "watch") & ~F.col("ch4_status").isin("exceedance", "watch")
    return capture_rows(thinned(rows, calm, hours))


def episodes(df: DataFrame, over: Column, fine: Column) -> DataFrame:
    """Alert episodes: one opens with a reading over the level and lasts until one that is fine; silence and other readings change nothing.

    Readings are compared within a station's day; what stands before a day and what turns after it comes from a row a day, so
    no task reads a station's whole history.
    """
    day = F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date"))
    marked = df.withColumn("_s", F.when(over, 1).when(fine, 0)).where("_s is not null").select("station", day.alias("_day"), "ts", "oid", "_s")
    w, days = W.partitionBy("station", "_day").orderBy("ts", "oid"), W.partitionBy("station").orderBy("_day")
    ends = marked.groupBy("station", "_day").agg(F.max_by("_s", F.struct("ts", "oid")).alias("_last"))
    before = ends.select("station", "_day", F.lag("_last").over(days).alias("_before"))
    turned = marked.join(before, ["station", "_day"]).withColumn("_b", F.coalesce(F.lag("_s").over(w), "_before", F.lit(0))).where("_s <> _b")
    firsts = turned.groupBy("station", "_day").agg(F.min_by("oid", F.struct("ts", "oid")).alias("_first"))
    after = firsts.select("station", "_day", F.lead("_first").over(days).alias("_next"))
    rows = turned.join(after, ["station", "_day"]).withColumn("recovered_oid", F.coalesce(F.lead("oid").over(w), "_next"))
    return rows.where("_s = 1").select("station", F.col("oid").alias("opened_oid"), "recovered_oid")


def silent(df: DataFrame, asof: str, days: int) -> DataFrame:
    """Stations whose newest reading is ``days`` or more before ``asof``."""
    newest = df.groupBy("station").agg(F.max("ts").alias("as_of"))
    age = F.datediff(F.lit(asof).cast("date"), F.to_date("as_of"))
    return newest.withColumn("days_silent", age).withColumn("stale", age >= days)


def to_alert_once(stale: DataFrame, marks: DataFrame) -> DataFrame:
    """Stale stations without a mark for their present newest reading."""
    return stale.where("stale").join(marks.select("station", "as_of"), ["station", "as_of"], "left_anti")
