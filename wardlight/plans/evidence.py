"""Queries over filings and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import scalars as S
from wardlight.operators import evidence as ev
from wardlight.plans.registry import query
from wardlight.sources import views
from wardlight.sources.tables import table

FAN = f"""{views.FILINGS}, {views.FILING_RISKS},
fan AS (SELECT f.*, r.risk, CASE WHEN r.risk <> 'R8' THEN 'Risk ' || substr(r.risk, 2) ELSE r.risk END AS risk_name
  FROM filings f JOIN filing_risks r ON f.doc_id = r.doc_id WHERE doc_type = 'evidence' AND r.risk <= 'R8')"""
WASTE = "waste AS (SELECT 'R' || (1 + s_nationkey % 2) AS risk, '2024-01-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') AS date, 'W' || (s_suppkey % 3) AS facility, s_name AS label, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'site' END AS detail FROM supplier)"


def fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fanned_out(views.filings(spark, sf_dir), views.filing_risks(spark, sf_dir))


def waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("R"), 1 + F.col("s_nationkey") % 2).alias("risk"),
        F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("s_suppkey") % 28).cast("string"), 2, "0")).alias("date"),
        F.concat(F.lit("W"), F.col("s_suppkey") % 3).alias("facility"),
        F.col("s_name").alias("label"),
        F.when(F.col("s_suppkey") % 5 == 0, None).otherwise(F.lit("site")).alias("detail"),
    )


@query("evidence_fanout", f"WITH {FAN} SELECT doc_id, facility, date_filed, risk, risk_name FROM fan")
def evidence_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fan(spark, sf_dir).select("doc_id", "facility", "date_filed", "risk", "risk_name")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = fan(spark, sf_dir).select("risk", F.col("date_filed").alias("date"), "facility", F.col("severity").alias("key_point"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("risk_name")).alias("summary"))
    return ev.common_evidence(state, waste(spark, sf_dir))


ALL = f"""{FAN}, {WASTE},
allev AS (SELECT 'state' AS source, risk, date_filed AS date, facility, CASE WHEN doc_id % 4 = 0 THEN severity ELSE severity || ' — ' || risk_name END AS detail FROM fan
  UNION ALL SELECT 'waste', risk, date, facility, CASE WHEN detail IS NULL THEN label ELSE label || ' — ' || detail END FROM waste)"""


@query("all_evidence", f"WITH {ALL} SELECT * FROM allev")
def all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir)


@query(
    "risk_register",
    f"""WITH {ALL}, t AS (SELECT risk, count(*) AS n, max(date) AS last_date FROM allev GROUP BY risk),
reg AS (SELECT 'R' || k AS risk, 'Risk ' || k AS name FROM range(1, 11) r(k))
SELECT reg.risk, name, coalesce(n, 0) AS n, coalesce(last_date, '') AS last_date FROM reg LEFT JOIN t ON reg.risk = t.risk""",
)
def risk_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = spark.range(1, 11).select(F.concat(F.lit("R"), "id").alias("risk"), F.concat(F.lit("Risk "), "id").alias("name"))
    return ev.register(risks, ev.risk_tally(_all(spark, sf_dir)))


MAXIMA = """maxima AS (SELECT doc_id,
  max(CASE WHEN metric = 'temperature' AND basis = 'measured' THEN CAST(round_even(CASE WHEN unit = 'C' THEN value * 9 / 5 + 32 ELSE value END, 0) AS INT) END) AS measured_f,
  bool_or(metric = 'temperature') AS has_temperature FROM measurements GROUP BY doc_id)"""
URGENT = f"""{views.FILINGS}, {views.MEASUREMENTS}, {MAXIMA},
judged AS (SELECT f.*, measured_f, has_temperature, CASE WHEN severity = 'urgent' THEN true WHEN measured_f IS NOT NULL THEN measured_f >= 145 WHEN has_temperature THEN false
  ELSE f.doc_id % 3 = 0 AND price > 100000 END AS urgent FROM filings f LEFT JOIN maxima m ON f.doc_id = m.doc_id),
routes AS (SELECT *, CASE WHEN urgent THEN 'alert' ELSE 'digest' END AS route FROM judged)"""


@query("measured_max", f"WITH {views.MEASUREMENTS}, {MAXIMA} SELECT * FROM maxima")
def measured_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.measured_maximum(views.measurements(spark, sf_dir))


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when((F.col("doc_id") % 3 == 0) & (F.col("price") > 100000), "probe read 180 °F at noon").otherwise("below 120 F")
    filings = views.filings(spark, sf_dir).withColumn("text", words)
    return ev.routed(ev.urgency(filings, ev.measured_maximum(views.measurements(spark, sf_dir)), "text"))


@query("urgency_route", f"WITH {URGENT} SELECT doc_id, severity, measured_f, urgent, route FROM routes")
def urgency_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("doc_id", "severity", "measured_f", "urgent", "route")


@query(
    "weekly_digest",
    f"""WITH {URGENT}
SELECT strftime(date_trunc('week', CAST(date_filed AS DATE)) + INTERVAL 6 DAYS, '%Y-%m-%d') AS week,
  CASE WHEN route = 'alert' THEN '3 recap' WHEN doc_type = 'procedural' THEN '1 procedural' ELSE '2 other' END AS section,
  count(*) AS n, min(doc_id) AS first_doc, max(date_filed) AS last_date FROM routes GROUP BY 1, 2""",
)
def weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.weekly_digest(_routes(spark, sf_dir))


FEEDS = f"""{views.FILINGS}, feed AS (SELECT doc_id, date_filed, 0 AS src FROM filings WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, date_filed, 1 FROM filings WHERE doc_id % 2 <> 0)"""


@query(
    "feed_pages",
    f"""WITH {FEEDS}, n AS (SELECT *, row_number() OVER (ORDER BY date_filed DESC, src, doc_id) AS rn, CAST(ceil(count(*) OVER () / 50.0) AS INT) AS last FROM feed),
p AS (SELECT *, CAST(ceil(rn / 50.0) AS INT) AS page FROM n)
SELECT doc_id, date_filed, src, rn, page, CASE WHEN page = 1 THEN 'index.html' ELSE 'page-' || page || '.html' END AS file,
  CASE WHEN page = 1 THEN '' WHEN page = 2 THEN 'index.html' ELSE 'page-' || (page - 1) || '.html' END AS prev,
  CASE WHEN page < last THEN 'page-' || (page + 1) || '.html' ELSE '' END AS next FROM p""",
)
def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.filings(spark, sf_dir).select("doc_id", "date_filed")
    feed = f.withColumn("src", F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1))
    return ev.feed_pages(feed, "date_filed", [F.col("src"), F.col("doc_id")])


@query(
    "feed_links",
    f"""WITH {views.FILINGS},
f AS (SELECT doc_id, 'https://state.example/docs/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '?v=1' ELSE '/' END AS link,
  'Report ' || doc_type || CASE WHEN doc_id % 3 = 0 THEN ' (3/' || (1 + doc_id % 28) || '/2024)' ELSE '' END AS title, doc_type FROM filings),
a AS (SELECT doc_id, 'https://mirror.example/' || doc_id AS archive_link FROM filings WHERE doc_id % 5 = 0)
SELECT f.doc_id, coalesce(archive_link, link) AS link, 'Report ' || doc_type AS title FROM f LEFT JOIN a ON f.doc_id = a.doc_id""",
)
def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.filings(spark, sf_dir)
    dated = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" (3/"), 1 + F.col("doc_id") % 28, F.lit("/2024)"))).otherwise("")
    feed = f.select(
        "doc_id",
        F.concat(F.lit("https://state.example/docs/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "?v=1").otherwise("/")).alias("link"),
        S.without_trailing_date(F.concat(F.lit("Report "), "doc_type", dated)).alias("title"),
    )
    archive = f.where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("https://mirror.example/"), "doc_id").alias("archive_link"))
    return ev.mirrored_links(feed, archive).select("doc_id", "link", "title")
