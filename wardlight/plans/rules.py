"""Queries over collections of waste records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import rules
from wardlight.plans.registry import query
from wardlight.sources.tables import table


def frames(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, rules.Collection]]:
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")

    def us(day) -> F.Column:
        return F.concat(F.month(day), F.lit("/"), F.dayofmonth(day), F.lit("/"), F.year(day))

    reports = o.select((F.col("o_custkey") % 19).alias("site"), F.col("o_orderkey").alias("period"), F.when(F.col("o_orderkey") % 7 == 0, "Yes").when(F.col("o_orderkey") % 7 == 1, " ").otherwise("No").alias("exceedence"), us("o_orderdate").alias("received"))
    kinds = F.when(F.col("c_custkey") % 4 == 0, "Construction Permit").otherwise("Operating License")
    apps = c.select((F.col("c_nationkey")).alias("site"), F.col("c_custkey").alias("application"), kinds.alias("type"), F.col("c_mktsegment").alias("status"), F.lit("3/7/2024").alias("received"))
    annual = s.select(
        F.col("s_suppkey").alias("site"),
        F.lit("2023").alias("year"),
        F.lit("9").alias("years_start"),
        F.when(F.col("s_suppkey") % 5 == 0, "0.0").when(F.col("s_suppkey") % 5 == 1, "").when(F.col("s_suppkey") % 5 == 2, "n/a").otherwise("12").alias("years_end"),
    )
    evals = p.select((F.col("p_size") % 19).alias("site"), F.col("p_partkey").alias("evaluation"), F.col("p_type").alias("kind"), F.lit("12/1/2023").alias("received"))
    word = F.get(F.lit(["Violation Notice", "Penalty Paid", "Letter", "Consent Judgment", "Matter CLOSED"]), F.col("l_suppkey") % 5)
    acts = li.groupBy(F.col("l_orderkey").alias("action"), (F.col("l_suppkey") % 19).alias("site"), word.alias("type")).agg(F.max("l_returnflag").alias("response"), us(F.min("l_shipdate")).alias("received"))
    specs = (rules.quarterly_report(), rules.application(), rules.annual_report(), rules.evaluation(), rules.compliance_action())
    return list(zip((reports, apps, annual, evals, acts), specs, strict=True))


def _us(day: str) -> str:
    return f"strftime({day}, '%Y-%m-%d')"


EVENTS = f"""acts AS (SELECT l_orderkey AS action, l_suppkey % 19 AS site, ['Violation Notice', 'Penalty Paid', 'Letter', 'Consent Judgment', 'Matter CLOSED'][1 + l_suppkey % 5] AS type, max(l_returnflag) AS response, min(l_shipdate) AS d FROM lineitem GROUP BY ALL),
ev AS (
  SELECT 'quarterly_reports' AS collection, (o_custkey % 19) || '|' || o_orderkey AS identity, CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' ' ELSE 'No' END AS content,
    'Quarterly report ' || o_orderkey AS label, 'Exceedance: ' || CASE o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN '' ELSE 'No' END AS detail, {_us("o_orderdate")} AS date,
    CASE WHEN o_orderkey % 7 = 0 THEN 'notable' ELSE 'watch' END AS fresh, CASE WHEN o_orderkey % 7 = 0 THEN 'notable' ELSE 'watch' END AS again, 'evidence' AS doc_type, 'R5' AS risk FROM orders
  UNION ALL SELECT 'applications', c_nationkey || '|' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Construction Permit' ELSE 'Operating License' END || '|' || c_mktsegment,
    CASE WHEN c_custkey % 4 = 0 THEN 'Construction Permit' ELSE 'Operating License' END, c_mktsegment, '2024-03-07', CASE WHEN c_custkey % 4 = 0 THEN 'urgent' ELSE 'notable' END,
    CASE WHEN c_custkey % 4 = 0 THEN 'urgent' ELSE 'notable' END, CASE WHEN c_custkey % 4 = 0 THEN 'evidence' ELSE 'procedural' END, 'R1' FROM customer
  UNION ALL SELECT 'annual_reports', s_suppkey || '|2023', '9|' || ['0.0', '', 'n/a', '12', '12'][1 + s_suppkey % 5], 'Annual report 2023', 'Years left: ' || ['0.0', '9', 'n/a', '12', '12'][1 + s_suppkey % 5], '2023-12-31',
    CASE WHEN s_suppkey % 5 = 0 THEN 'notable' ELSE 'watch' END, CASE WHEN s_suppkey % 5 = 0 THEN 'notable' ELSE 'watch' END, 'evidence', 'R1' FROM supplier
  UNION ALL SELECT 'evaluations', (p_size % 19) || '|' || p_partkey, p_type, 'Evaluation ' || p_partkey, p_type, '2023-12-01', 'watch', 'watch', 'procedural', 'R2' FROM part
  UNION ALL SELECT 'compliance_actions', site || '|' || action || '|' || type, response, type, 'Response: ' || response, {_us("d")},
    CASE WHEN type IN ('Penalty Paid', 'Matter CLOSED') THEN 'watch' WHEN type IN ('Violation Notice', 'Consent Judgment') THEN 'urgent' ELSE 'notable' END,
    CASE WHEN type IN ('Penalty Paid', 'Matter CLOSED') THEN 'watch' ELSE 'notable' END, CASE WHEN type IN ('Violation Notice', 'Consent Judgment') THEN 'evidence' ELSE 'procedural' END, 'R2' FROM acts)"""


@query("historical_load", f"WITH {EVENTS} SELECT collection, identity, substr(sha1(content), 1, 12) AS hash, label, detail, date, fresh AS severity, doc_type, risk, 'historical' AS kind FROM ev WHERE collection <> 'applications'")
def historical_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = spark.createDataFrame([("applications",)], "collection string")
    return rules.historical(frames(spark, sf_dir), loaded)


@query(
    "wds_rules",
    f"""WITH {EVENTS}, h AS (SELECT *, substr(sha1(content), 1, 12) AS hash, CAST(('0x' || substr(md5(identity), 1, 4)) AS INT) % 10 AS r FROM ev)
SELECT collection, identity, hash, label, detail, date, CASE WHEN r = 0 THEN fresh ELSE again END AS severity, doc_type, risk, CASE WHEN r = 0 THEN 'new' ELSE 'changed' END AS kind FROM h WHERE r IN (0, 1)""",
)
def wds_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the records is unknown to the seen table, and a tenth stands there with another hash."""
    given = frames(spark, sf_dir)
    no = F.conv(F.substring(F.md5("identity"), 1, 4), 16, 10).cast("int") % 10
    found = None
    for df, spec in given:
        seen = rules.events(df, spec, F.lit(False), F.lit("seen")).select("collection", "identity", F.when(no == 1, "other").otherwise(F.col("hash")).alias("hash")).where(no != 0)
        part = rules.against_seen(df, spec, seen)
        found = part if found is None else found.unionByName(part)
    return found
