"""Queries over sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import readings as r
from wardlight.plans.registry import query
from wardlight.sources import views

STATUS = """classed AS (
  SELECT *, CASE WHEN h2s IS NULL THEN 'missing' WHEN h2s = 999 THEN 'sentinel' WHEN h2s >= 72 THEN 'exceedance' ELSE 'ok' END AS h2s_status,
    CASE WHEN ch4 IS NULL THEN 'missing' WHEN ch4 = 99999 THEN 'sentinel' WHEN ch4 >= 500 THEN 'exceedance' WHEN ch4 >= 40 THEN 'watch' ELSE 'ok' END AS ch4_status
  FROM readings)"""
LONG = """long AS (
  SELECT oid, station, metric, value, unit, strftime(ts, '%Y-%m-%d %H:%M') AS as_of,
    CASE WHEN metric = 'hydrogen_sulfide' AND h2s_text IS NOT NULL THEN 'fenceline; ' || h2s_text ELSE 'fenceline' END AS note
  FROM (SELECT oid, station, ts, h2s_text, 'hydrogen_sulfide' AS metric, h2s AS value, 'ppb' AS unit FROM readings WHERE h2s <> 999
        UNION ALL SELECT oid, station, ts, h2s_text, 'methane', ch4, 'ppm' FROM readings WHERE ch4 <> 99999)
  WHERE starts_with(station, 'MS-') AND value IS NOT NULL)"""
BASE = f"WITH {views.READINGS}"


def _reason_sql(column: str, action: str | None, watch: str | None) -> str:
    """A pollutant's reason in words; an ``action`` of None is judged elsewhere."""
    value = f"CASE WHEN {column} = floor({column}) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END"
    name = f"'{column.upper()}=' || {value}"
    over = f"WHEN 'exceedance' THEN {name} || ' reaches the action level {action}' " if action else ""
    near = f"WHEN 'watch' THEN {name} || ' reaches the watch level {watch}, below the action level {action}' " if watch else ""
    return f"CASE {column}_status {over}{near}WHEN 'sentinel' THEN {name} || ' is a sentinel' END"


def _reasons_sql(*each: str) -> str:
    return f"array_to_string(list_filter([{', '.join(each)}], lambda x: x IS NOT NULL), '; ')"


REASONS = _reasons_sql(_reason_sql("h2s", "72", None), _reason_sql("ch4", "500", "40"))


@query(
    "reading_classify",
    f"""{BASE}, {STATUS}
SELECT oid, station, h2s_status, ch4_status,
  CASE WHEN 'exceedance' IN (h2s_status, ch4_status) THEN 'urgent' WHEN 'watch' IN (h2s_status, ch4_status) THEN 'watch' WHEN 'sentinel' IN (h2s_status, ch4_status) THEN 'anomaly' ELSE 'ok' END AS severity,
  CAST(h2s_status IN ('exceedance', 'sentinel') AS INT) + CAST(ch4_status IN ('exceedance', 'watch', 'sentinel') AS INT) AS n_reasons,
  {REASONS} AS reasons FROM classed""",
)
def reading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.classify(views.readings(spark, sf_dir)).withColumn("reasons", F.array_join(F.transform("reasons", r.told), "; "))
    return rows.select("oid", "station", "h2s_status", "ch4_status", "severity", "n_reasons", "reasons")


def lines_sql(sentinels: bool) -> str:
    ch4 = "WHEN ch4_status = 'exceedance' THEN 'EXCEEDANCE' WHEN ch4_status = 'watch' THEN 'watch'"
    kind = f"CASE {ch4} WHEN 'sentinel' IN (h2s_status, ch4_status) THEN 'anomaly' END" if sentinels else f"CASE {ch4} END"
    reasons = _reasons_sql(*([_reason_sql("h2s", None, None)] if sentinels else []), _reason_sql("ch4", "500", "40"))
    return f"""{BASE}, {STATUS}, k AS (SELECT *, {kind} AS kind, {reasons} AS reasons FROM classed)
SELECT oid, station, kind || ' ' || station || ' ' || strftime(ts, '%Y-%m-%d %H:%M') || ': ' || reasons AS line FROM k WHERE kind IS NOT NULL"""


@query("alert_lines", lines_sql(True))
def alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.alert_lines(views.readings(spark, sf_dir)).select("oid", "station", "line")


@query("alert_lines_without_sentinels", lines_sql(False))
def alert_lines_without_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.alert_lines(views.readings(spark, sf_dir), on_sentinel=False).select("oid", "station", "line")


@query("reading_unpivot", f"{BASE}, {LONG} SELECT * FROM long")
def reading_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.long_form(views.readings(spark, sf_dir))


@query(
    "reading_digest_select",
    f"""{BASE}, {LONG},
peak AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY station, metric, substr(as_of, 1, 10) ORDER BY value DESC, oid) = 1),
both_ AS (SELECT * FROM peak UNION ALL SELECT * FROM long WHERE (metric = 'hydrogen_sulfide' AND value >= 72) OR (metric = 'methane' AND value >= 500))
SELECT station, metric, as_of, oid, value, unit, note FROM both_ QUALIFY row_number() OVER (PARTITION BY station, metric, as_of ORDER BY oid DESC) = 1""",
)
def reading_digest_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.digest_rows(r.long_form(views.readings(spark, sf_dir)), {r.H2S.metric: 72.0, r.CH4.metric: 500.0})


@query(
    "daily_peak",
    f"""{BASE}, {LONG}
SELECT station, metric, substr(as_of, 1, 10) AS day, value, oid, unit, as_of, note FROM long QUALIFY row_number() OVER (PARTITION BY station, metric, substr(as_of, 1, 10) ORDER BY value DESC, oid) = 1""",
)
def daily_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.daily_peaks(r.long_form(views.readings(spark, sf_dir)))


@query(
    "last_writer_wins",
    f"""{BASE}, {LONG} SELECT station, metric, as_of, oid, value, unit, note FROM long QUALIFY row_number() OVER (PARTITION BY station, metric, as_of ORDER BY oid DESC) = 1""",
)
def last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.last_writer(r.long_form(views.readings(spark, sf_dir)))


@query(
    "station_latest",
    f"""{BASE}, {STATUS}, x AS (SELECT * FROM classed QUALIFY row_number() OVER (PARTITION BY station ORDER BY oid DESC) = 1)
SELECT station, oid, strftime(ts, '%Y-%m-%d %H:%M') AS as_of, h2s, h2s_status, ch4, ch4_status FROM x""",
)
def station_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.classify(r.latest(views.readings(spark, sf_dir), ["station"], "oid"))
    return rows.select("station", "oid", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("as_of"), "h2s", "h2s_status", "ch4", "ch4_status")


@query("max_cursor", "SELECT max(event_id) AS cursor FROM events")
def max_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.cursor(views.readings(spark, sf_dir).select(F.col("oid").cast("string").alias("oid")))


@query(
    "rolling_avg_alert",
    f"""{BASE},
a AS (SELECT station, round(avg(h2s), 6) AS avg, count(*) AS n FROM readings WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS AND h2s IS NOT NULL AND h2s <> 999 GROUP BY station)
SELECT *, CASE WHEN avg >= 52 AND n >= 100 THEN 'alert' WHEN avg >= 52 THEN 'suppressed' ELSE 'quiet' END AS outcome FROM a""",
)
def rolling_avg_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.average_alerts(r.trailing_average(views.readings(spark, sf_dir), "2024-01-30"), 52.0, 100)


@query(
    "capture_downsample",
    f"""WITH RECURSIVE {views.READINGS}, {STATUS},
r AS (SELECT station, ts, oid, h2s_status NOT IN ('exceedance', 'watch') AND ch4_status NOT IN ('exceedance', 'watch') AS calm FROM classed WHERE starts_with(station, 'MS-')),
c AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY oid) AS k FROM r WHERE calm),
w AS (
  SELECT station, k, ts, oid, ts AS last, true AS keep FROM c WHERE k = 1
  UNION ALL
  SELECT c.station, c.k, c.ts, c.oid, CASE WHEN c.ts >= w.last + INTERVAL 8 HOURS THEN c.ts ELSE w.last END, c.ts >= w.last + INTERVAL 8 HOURS
  FROM w JOIN c ON c.station = w.station AND c.k = w.k + 1),
k AS (SELECT station, oid FROM r WHERE NOT calm UNION ALL SELECT station, oid FROM w WHERE keep)
SELECT k.station, k.oid, strftime(ts, '%Y-%m-%d %H:%M') AS timestamp, h2s AS h2s_ppb, ch4 AS ch4_ppm FROM k JOIN readings USING (oid)""",
)
def capture_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.captured(views.readings(spark, sf_dir)).select(F.col("monitor_id").alias("station"), "oid", "timestamp", "h2s_ppb", "ch4_ppm")


@query(
    "watch_episodes",
    f"""{BASE},
m AS (SELECT station, ts, oid, CASE WHEN h2s = 999 THEN NULL WHEN h2s >= 72 THEN 1 WHEN h2s < 72 THEN 0 END AS s FROM readings),
t AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY station ORDER BY ts, oid), 0) AS b FROM m WHERE s IS NOT NULL),
o AS (SELECT *, lead(oid) OVER (PARTITION BY station ORDER BY ts, oid) AS recovered_oid FROM t WHERE s <> b)
SELECT station, oid AS opened_oid, recovered_oid FROM o WHERE s = 1""",
)
def watch_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = views.readings(spark, sf_dir).where("h2s is not null and h2s <> 999")
    return r.episodes(usable, F.col("h2s") >= 72, F.col("h2s") < 72)


@query(
    "liveness",
    f"""{BASE}, n AS (SELECT station, max(ts) AS as_of FROM readings GROUP BY station)
SELECT station, as_of, date_diff('day', CAST(as_of AS DATE), DATE '2024-02-01') AS days_silent, date_diff('day', CAST(as_of AS DATE), DATE '2024-02-01') >= 2 AS stale FROM n""",
)
def liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.silent(views.readings(spark, sf_dir), "2024-02-01", 2)
