"""Queries that bring raw records into canonical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import normalize as n
from wardlight.operators import readings as r
from wardlight.plans.corpus import PAGES, doc_pages
from wardlight.plans.readings import BASE, STATUS
from wardlight.plans.registry import query
from wardlight.plans.sequences import VERDICT, verdicts
from wardlight.sources import views
from wardlight.sources.tables import table


@query(
    "document_normalize",
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date_filed,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE 'doc-' || o_orderkey END AS document_name,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus ELSE '' END AS type_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://state.example/a/' || o_orderkey WHEN 1 THEN 'https://else.example/b' ELSE 'https://state.example/dl/' || o_orderkey END AS doc_url FROM orders""",
)
def document_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = F.when(k % 4 == 0, F.concat(F.lit('<a href="/a/'), k, F.lit('">Download</a>'))).when(k % 4 == 1, "https://else.example/b").when(k % 4 == 2, "")
    raw = table(spark, sf_dir, "orders").select(
        k.alias("doc_id"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).alias("descr"),
        F.when(k % 3 == 1, F.col("o_orderstatus")).otherwise(" ").alias("source_type"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00:00")).alias("created"),
        url.alias("url"),
    )
    return n.documents(raw, "https://state.example", "https://state.example/dl")


@query(
    "registry_view",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN 'pending' ELSE strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%d') END AS closed,
  CASE WHEN c_nationkey = 3 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""",
)
def registry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    closed = F.when(k % 7 == 0, None).when(k % 7 == 1, " pending ").otherwise((k * 86_400_000).cast("string"))
    raw = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit(" "), "c_name").alias("name"), closed.alias("closed"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"))
    return n.canonical_view(raw, ["id", "name", "closed", "nation"], ["closed"])


@query(
    "feed_rows",
    f"""WITH {views.FILINGS}, {views.FILING_RISKS}, r AS (SELECT doc_id, string_agg(DISTINCT risk, ', ' ORDER BY risk) AS risks FROM filing_risks GROUP BY doc_id)
SELECT date_filed, f.doc_id, doc_type, coalesce(risks, '') AS risks, severity, facility FROM filings f LEFT JOIN r ON f.doc_id = r.doc_id""",
)
def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.feed_rows(views.filings(spark, sf_dir), views.filing_risks(spark, sf_dir))


@query(
    "measurement_rows",
    f"""WITH {views.FILINGS}, {views.MEASUREMENTS}
SELECT CASE WHEN metric = 'oxygen' THEN date_filed ELSE as_of END AS as_of, m.doc_id, metric, value, unit, basis, date_filed, facility FROM measurements m JOIN filings f ON m.doc_id = f.doc_id""",
)
def measurement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.measurements(spark, sf_dir)
    return n.measurement_rows(views.filings(spark, sf_dir), m.withColumn("as_of", F.when(F.col("metric") == "oxygen", " ").otherwise(F.col("as_of"))))


@query(
    "deadline_rows",
    """SELECT strftime(l_shipdate, '%Y-%m-%d') AS due, '' AS extension_due, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate + INTERVAL 9 DAYS, '%Y-%m-%d') ELSE '' END AS actual_completion, 'item ' || l_linenumber AS item_description,
  l_returnflag AS compelled_by, 'filings' AS source_stream, 'F' || (l_suppkey % 6) AS facility, CAST(l_orderkey AS VARCHAR) AS ref, '2024-01-31' AS extracted_at FROM lineitem WHERE l_linenumber <> 4""",
)
def deadline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("due"),
        F.lit(None).cast("string").alias("extension_due"),
        F.when(F.col("l_linestatus") == "F", F.date_format(F.date_add("l_shipdate", 9), "yyyy-MM-dd")).alias("actual_completion"),
        F.when(F.col("l_linenumber") != 4, F.concat(F.lit("item "), "l_linenumber")).otherwise(" ").alias("item_description"),
        F.col("l_returnflag").alias("compelled_by"),
        F.concat(F.lit("F"), F.col("l_suppkey") % 6).alias("facility"),
        F.col("l_orderkey").alias("ref"),
    )
    return n.deadline_rows(rows, "filings", "2024-01-31")


@query(
    "station_rows",
    f"""{BASE}, {STATUS}, x AS (SELECT * FROM classed QUALIFY row_number() OVER (PARTITION BY station ORDER BY oid DESC) = 1)
SELECT station, strftime(ts, '%Y-%m-%d %H:%M') AS as_of, coalesce(CASE WHEN h2s = floor(h2s) THEN CAST(CAST(h2s AS BIGINT) AS VARCHAR) ELSE CAST(h2s AS VARCHAR) END, '') AS h2s,
  coalesce(CASE WHEN ch4 = floor(ch4) THEN CAST(CAST(ch4 AS BIGINT) AS VARCHAR) ELSE CAST(ch4 AS VARCHAR) END, '') AS ch4, h2s_status, ch4_status, CAST(oid AS VARCHAR) AS oid, 'https://air.example' AS link FROM x""",
)
def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.station_rows(r.classify(r.latest(views.readings(spark, sf_dir), ["station"], "oid")), "https://air.example")


@query(
    "monthly_measurements",
    f"""WITH {VERDICT} SELECT '2024-' || lpad(CAST(1 + report % 12 AS VARCHAR), 2, '0') || '-01' AS as_of, 'SCHOOL' AS well_id, report, value_token AS value, 'measured' AS basis,
  'monthly max of ' || n_days || ' daily means' || CASE WHEN all_below_1 THEN '; all days below 1' ELSE '' END AS note FROM w WHERE value_token <> ''""",
)
def monthly_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.concat(F.lit("2024-"), F.lpad((1 + F.col("report") % 12).cast("string"), 2, "0"))
    return n.monthly_measurements(verdicts(spark, sf_dir), month, "SCHOOL")


@query("text_routing", f"WITH {PAGES} SELECT doc, count(*) AS n_pages, bool_or(page < 9 AND regexp_matches(text, '[a-z]*tioning')) AS has_header, count(*) > 12 AND bool_or(page < 9 AND regexp_matches(text, '[a-z]*tioning')) AS route FROM pages_ GROUP BY doc")
def text_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.routed_texts(doc_pages(spark, sf_dir), "[a-z]*tioning", 12, 9)


@query(
    "diff_case_order",
    """WITH o AS (SELECT l_suppkey % 30 AS site, count(*) AS old_n FROM lineitem WHERE l_suppkey % 30 <> 4 AND l_orderkey % 10 <> 0 GROUP BY 1),
n AS (SELECT l_suppkey % 30 AS site, count(*) AS new_n, count(*) > count(DISTINCT l_orderkey * 100 + l_linenumber) AS has_duplicates FROM lineitem WHERE l_suppkey % 30 <> 6 AND l_orderkey % 10 <> 1 GROUP BY 1),
j AS (SELECT coalesce(o.site, n.site) AS site, old_n, coalesce(new_n, 0) AS new_n, coalesce(has_duplicates, false) AS has_duplicates FROM o FULL JOIN n ON o.site = n.site)
SELECT *, site % 11 <> 5 AS readable, site % 5 = 3 AS truncated, CASE WHEN site % 13 = 7 THEN 'a' ELSE 'b' END AS old_config, 'b' AS new_config,
  CASE WHEN old_n IS NULL THEN 'baseline' WHEN site % 11 = 5 THEN 'unreadable' WHEN site % 13 = 7 THEN 'settings changed' WHEN has_duplicates THEN 'counts only' WHEN site % 5 = 3 THEN 'digests only'
    WHEN old_n = 0 AND new_n > 0 THEN 'first records' WHEN old_n > 0 AND new_n = 0 THEN 'all records gone' ELSE 'detail' END AS diff_case FROM j""",
)
def diff_case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("site", F.col("l_suppkey") % 30)
    sides = n.sites_state(li.where("site <> 4 and l_orderkey % 10 <> 0"), li.where("site <> 6 and l_orderkey % 10 <> 1"), ["l_orderkey", "l_linenumber"], "site")
    site = F.col("site")
    return n.diff_case(sides.withColumns({"readable": site % 11 != 5, "truncated": site % 5 == 3, "old_config": F.when(site % 13 == 7, "a").otherwise("b"), "new_config": F.lit("b")}))


@query(
    "episode_marks",
    """WITH m AS (SELECT DISTINCT user_id AS station FROM events WHERE user_id % 2 = 0), r AS (SELECT DISTINCT user_id AS station FROM events WHERE user_id % 3 = 0), a AS (SELECT DISTINCT user_id AS station FROM events WHERE user_id % 5 = 0)
SELECT station FROM m WHERE station NOT IN (SELECT * FROM r) UNION SELECT station FROM a""",
)
def episode_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("station")).distinct()
    return n.episode_marks(s.where("station % 2 = 0"), s.where("station % 3 = 0"), s.where("station % 5 = 0"))


@query(
    "site_tagging",
    f"""WITH {views.SITES} SELECT l_orderkey AS record, l_suppkey AS site, srn AS facility_srn, name AS facility_name FROM lineitem JOIN sites ON l_suppkey = site WHERE l_linenumber = 1""",
)
def site_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("site"))
    return n.tagged(rows, views.sites(spark, sf_dir)).select("record", "site", "facility_srn", "facility_name")
