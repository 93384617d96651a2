"""Queries over line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import sequences as q
from wardlight.plans.registry import query
from wardlight.sources import lines as L
from wardlight.sources.tables import table

GAS = f"WITH {L.WELL_ROWS}"


def gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.gas_readings(L.well_lines(spark, sf_dir))


@query("well_parse", f"{GAS} SELECT doc, line_no, page, well_id, dt, adj, ch4, co2, o2, balance, temp, valid FROM wells")
def well_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gas(spark, sf_dir).select("doc", "line_no", "page", "well_id", "dt", "adj", "ch4", "co2", "o2", "balance", "temp", "valid")


SUMMARY = """good AS (SELECT * FROM wells WHERE valid AND NOT adj),
top AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY temp DESC, doc, line_no) = 1),
agg AS (SELECT well_id, max(o2) AS max_o2, count(*) AS n FROM good GROUP BY well_id),
summary AS (SELECT t.well_id, t.temp AS max_temp, t.dt, t.o2 AS o2_at_max, t.ch4 AS ch4_at_max, max_o2, n FROM top t JOIN agg a ON t.well_id = a.well_id)"""


@query("well_summary", f"{GAS}, {SUMMARY} SELECT *, CAST(substr(well_id, 4) AS INT) % 10 = 3 AS is_listed FROM summary")
def well_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "part").where("p_partkey % 10 = 3").select(F.concat(F.lit("AHW"), "p_partkey").alias("well_id"))
    return q.well_summary(gas(spark, sf_dir), listed)


@query(
    "well_headline",
    f"""{GAS}, {SUMMARY} SELECT (SELECT count(*) FROM wells) AS n_readings, (SELECT round(100.0 * count(*) FILTER (valid) / count(*), 1) FROM wells) AS pct_valid,
  count(*) AS n_wells, count(*) FILTER (max_temp >= 131) AS wells_131, count(*) FILTER (max_temp >= 139) AS wells_139 FROM summary""",
)
def well_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gas(spark, sf_dir)
    return q.headline_counts(rows, q.well_summary(rows), (131.0, 139.0))


@query(
    "well_measurements",
    f"""{GAS}, d AS (SELECT doc, well_id, strftime(l_shipdate, '%Y-%m-%d') AS as_of, temp, o2, ch4 FROM wells WHERE NOT adj)
SELECT doc, well_id, as_of, 'temperature' AS metric, temp AS value, 'F' AS unit FROM d UNION ALL SELECT doc, well_id, as_of, 'oxygen', o2, 'percent' FROM d UNION ALL SELECT doc, well_id, as_of, 'methane', ch4, 'percent' FROM d""",
)
def well_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.well_measurements(gas(spark, sf_dir))


@query("well_bands", f"{GAS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY temp DESC, line_no) AS k FROM wells) SELECT doc, line_no, well_id, temp FROM p WHERE temp >= 138 OR k = 1")
def well_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.banded(gas(spark, sf_dir), 138.0).select("doc", "line_no", "well_id", "temp")


@query(
    "minimum_evidence",
    f"{GAS} SELECT doc, count(*) FILTER (valid) AS n_valid, count(*) FILTER (temp >= 139) AS n_anchor, count(*) FILTER (valid) >= 800 AND count(*) FILTER (temp >= 139) >= 1 AS replace FROM wells GROUP BY doc",
)
def minimum_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardlight.operators.state import minimum_evidence as guard

    return guard(gas(spark, sf_dir), F.col("valid"), F.col("temp") >= 139, 800, 1)


@query("co_parse", f"WITH {L.CO_ROWS} SELECT doc, well_id, month, ppm FROM co")
def co_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.co_readings(L.co_lines(spark, sf_dir)).select("doc", "well_id", "month", "ppm")


@query(
    "co_trend",
    f"""WITH {L.CO_ROWS} SELECT doc, well_id, string_agg(month || '=' || CAST(ppm AS BIGINT), ' ' ORDER BY month) AS series, max(ppm) AS max_ppm, arg_min(ppm, month) AS first_ppm, arg_max(ppm, month) AS last_ppm,
  round(arg_max(ppm, month) - arg_min(ppm, month), 6) AS rise, count(*) AS n FROM co GROUP BY doc, well_id""",
)
def co_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.co_trend(q.co_readings(L.co_lines(spark, sf_dir)))


@query(
    "co_measurements",
    f"WITH {L.CO_ROWS} SELECT doc, well_id, strftime(o_orderdate, '%Y-%m-%d') AS as_of, 'carbon_monoxide' AS metric, ppm AS value, 'ppm' AS unit, 'CO, ' || month AS note FROM co",
)
def co_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.co_measurements(q.co_readings(L.co_lines(spark, sf_dir)))


MONTHS = ("1996-01", "1996-02", "1996-03", "1996-04", "1996-05")


@query("co_pivot", f"WITH {L.CO_ROWS} SELECT doc, well_id, " + ", ".join(f"max(ppm) FILTER (month = '{m}') AS \"{m}\"" for m in MONTHS) + " FROM co GROUP BY doc, well_id")
def co_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.co_pivot(q.co_readings(L.co_lines(spark, sf_dir)), MONTHS)


VERDICT = f"""{L.REPORT_ROWS},
r AS (SELECT DISTINCT user_id % 50 AS report, user_id % 50 % 3 <> 0 AS all_clear FROM events),
s AS (SELECT report, count(*) AS n_days, count(value) AS tokens, max(CASE WHEN value NOT LIKE '<%' THEN CAST(value AS DOUBLE) END) AS max_numeric, count(*) FILTER (value LIKE '<%') AS b FROM vals GROUP BY report),
v AS (SELECT r.report, coalesce(n_days, 0) AS n_days, max_numeric, CASE WHEN max_numeric IS NOT NULL THEN CAST(CAST(max_numeric AS BIGINT) AS VARCHAR) WHEN b > 0 THEN '<1' ELSE '' END AS value_token,
  max_numeric IS NULL AND coalesce(b, 0) > 0 AS all_below_1, all_clear, coalesce(max_numeric >= 10, false) AS exceed_24h, coalesce(tokens, 0) = 0 AS parse_anomaly FROM r LEFT JOIN s ON r.report = s.report),
w AS (SELECT *, exceed_24h OR parse_anomaly OR NOT all_clear AS alert FROM v)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("report")).distinct().withColumn("all_clear", F.col("report") % 3 != 0)
    return q.report_verdict(reports, q.daily_values(L.report_lines(spark, sf_dir)), 10.0)


@query("monthly_report_rollup", f"WITH {VERDICT} SELECT *, CASE WHEN alert THEN 'alert' ELSE 'routine' END AS severity FROM w")
def monthly_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir)


@query(
    "audience_routing",
    f"""WITH {VERDICT} SELECT report, severity, CASE WHEN report % 10 = 9 THEN 'suppressed' WHEN exceed_24h THEN 'all' WHEN alert THEN 'review' ELSE 'none' END AS audience,
  CASE WHEN exceed_24h THEN 'EXCEEDANCE' WHEN alert THEN 'review' ELSE 'ok' END AS alert_cell FROM (SELECT *, CASE WHEN alert THEN 'alert' ELSE 'routine' END AS severity FROM w)""",
)
def audience_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.audience(verdicts(spark, sf_dir), F.col("report") % 10 == 9).select("report", "severity", "audience", "alert_cell")


@query(
    "report_text_verdict",
    f"""WITH {L.REPORT_TEXTS},
l AS (SELECT report, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM report_texts),
f AS (SELECT *, lead(line) OVER w AS next, lead(n) OVER w AS spot FROM l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY report ORDER BY n)),
d AS (SELECT report, CASE WHEN spot - n <= 3 AND regexp_full_match(next, '\\s*(<\\s*1|\\d{{1,4}}(\\.\\d+)?)\\s*') THEN replace(trim(next), ' ', '') END AS value FROM f WHERE regexp_full_match(line, '\\s*\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}\\s*')),
s AS (SELECT report, count(*) AS n_days, count(value) AS tokens, max(CASE WHEN value NOT LIKE '<%' THEN CAST(value AS DOUBLE) END) AS m FROM d GROUP BY report),
v AS (SELECT t.report, coalesce(n_days, 0)::INT AS n_days, m AS max_numeric, CASE WHEN m IS NOT NULL THEN CAST(CAST(m AS BIGINT) AS VARCHAR) WHEN tokens > 0 THEN '<1' ELSE '' END AS value_token, m IS NULL AND coalesce(tokens, 0) > 0 AS all_below_1,
  regexp_matches(regexp_extract(text, '(?s)^(.*?)(\\n\\s*1\\s+Notifications\\b.*)?$', 1), '(?i)no\\s+notifications?\\s+required\\s+to\\s+be\\s+sent') AS all_clear, coalesce(m >= 10, false) AS exceed_24h, coalesce(tokens, 0) = 0 AS parse_anomaly
  FROM report_texts t LEFT JOIN s USING (report))
SELECT *, exceed_24h OR parse_anomaly OR NOT all_clear AS alert, CASE WHEN exceed_24h OR parse_anomaly OR NOT all_clear THEN 'alert' ELSE 'routine' END AS severity,
  array_to_string(list_filter([CASE WHEN exceed_24h THEN 'exceedance: a day''s mean of ' || value_token || ' ppb reaches the level of 10 ppb' END, CASE WHEN parse_anomaly THEN 'no values: no day''s mean was found in the text: look at the report itself'
    WHEN NOT all_clear THEN 'no all-clear: the report doesn''t say that no notifications were required' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM v""",
)
def report_text_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q.report_text_verdict(L.report_texts(spark, sf_dir), 10.0)
    return found.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat_ws(": ", r["code"], r["text"])), "; "))
