"""Queries that pick records out of pages made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import scalars as S
from wardlight.plans.registry import query
from wardlight.sources import landed
from wardlight.sources.tables import table


@query(
    "link_harvest",
    """WITH l AS (SELECT page_id, h, i - 1 AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?href="([^"]+)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?i)<a\\b[^>]*?href="([^"]+)"', 1), 1) AS i FROM pages)),
m AS (SELECT page_id, n, 'https://site.example' || h || '_2024-0' || (1 + n % 4) AS url, '2024-0' || (1 + n % 4) AS month FROM l)
SELECT page_id, n, url, month FROM m QUALIFY row_number() OVER (PARTITION BY page_id, month ORDER BY n) = 1""",
)
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a page gets a month, four in turn; the first of each month stays."""
    p = table(spark, sf_dir, "pages")
    parts = F.split("html", r'(?i)(?=<a\b[^>]*?href=")')
    marked = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(x, F.lit(r'(?i)(<a\b[^>]*?href="[^"]+)"'), F.concat(F.lit("$1_2024-0"), 1 + (i - 1) % 4, F.lit('"'))))), "")
    return landed.report_links(p.select("page_id", marked.alias("html")), "html", "https://site.example")[0].select("page_id", "n", "url", "month")


@query(
    "grid_extract",
    "SELECT s_nationkey AS page, CAST(s_suppkey AS INT) AS row, s_name AS \"Site Name\", CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) END AS \"Number\" FROM supplier",
)
def grid_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    number = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("s_suppkey").cast("string"))
    one = F.concat(F.lit('<span id="row_'), "s_suppkey", F.lit('_a" class="c" title="Site Name"> '), "s_name", F.lit(' </span><span title="Number" id="row_'), "s_suppkey", F.lit('_b">'), number, F.lit("</span>"))
    grids = s.groupBy(F.col("s_nationkey").alias("page")).agg(F.concat(F.array_join(F.sort_array(F.collect_list(one)), ""), F.lit('<span id="row_99999_a" title="Site Name"> </span>')).alias("html"))
    return landed.grid_rows(grids, "html", ["Site Name", "Number"])


@query(
    "label_blocks",
    "SELECT p_size AS page, p_name AS \"Evaluation\", p_brand AS \"Type\", CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS \"Date\", p_partkey FROM part",
)
def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" "), "p_brand")).otherwise(F.col("p_brand"))
    text = F.concat(F.lit("head Evaluation: "), "p_name", F.lit(" Type: "), kind, F.lit("\nDate: "), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")))
    blocks = landed.labelled_blocks(p.select(F.col("p_size").alias("page"), "p_partkey", text.alias("text")), "text", "Evaluation", ["Type", "Date"])
    return blocks.select("page", "Evaluation", "Type", "Date", "p_partkey")


@query(
    "annual_totals",
    "SELECT l_orderkey AS page, CAST(year(min(l_shipdate)) AS VARCHAR) AS year, CASE WHEN l_orderkey % 4 <> 0 THEN round(sum(CAST(l_quantity AS INT) * 1000.0), 2) END AS total FROM lineitem GROUP BY l_orderkey",
)
def annual_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    box = F.concat(F.lit('<input type="text" value="'), F.format_number(F.col("l_quantity").cast("int") * 1000, 0), F.lit('">'))
    page = li.groupBy(F.col("l_orderkey").alias("page")).agg(F.year(F.min("l_shipdate")).alias("y"), F.array_join(F.collect_list(box), " ").alias("b"))
    html = F.concat(F.lit("<h2>x</h2><h3>Annual "), "y", F.lit("</h3>"), F.when(F.col("page") % 4 != 0, F.col("b")).otherwise("none"))
    return landed.annual_blocks(page.select("page", html.alias("html")), "html")


@query(
    "folder_listing",
    "SELECT p_size AS folder, p_partkey, '1/' || (1 + p_partkey % 28) || '/2024' AS date, '9:05 AM' AS time, '/f/' || p_partkey AS href, p_name AS name, p_partkey % 6 = 0 AS is_dir FROM part",
)
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.when(F.col("p_partkey") % 6 == 0, "&lt;dir&gt;").otherwise(F.col("p_size").cast("string"))
    html = F.concat(F.lit("<pre><br> 1/"), 1 + F.col("p_partkey") % 28, F.lit("/2024  9:05 AM   "), size, F.lit(' <A HREF="/f/'), "p_partkey", F.lit('">'), "p_name", F.lit("</A><br></pre>"))
    return landed.folder_listing(p.select(F.col("p_size").alias("folder"), "p_partkey", html.alias("html"))).drop("n")


@query(
    "normalize_profile",
    """SELECT o_orderkey AS ref_num, strftime(o_orderdate, '%Y-%m-%d') AS received, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS status, 'a' || chr(10) || 'b' AS descr,
  substr(sha1(o_orderkey || '|' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END), 1, 12) AS hash FROM orders""",
)
def normalize_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates come in three formats, one with an offset that must not move the day; line ends and nulls are evened out."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    day = F.when(k == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00.000-0500"))).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.concat(F.month("o_orderdate"), F.lit("/"), F.dayofmonth("o_orderdate"), F.lit("/"), F.year("o_orderdate")))
    status = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    rows = o.select(F.col("o_orderkey").alias("ref_num"), S.iso_date(day).alias("received"), S.first_filled(status).alias("status"), F.regexp_replace(F.lit("a\r\nb"), "\r\n?", "\n").alias("descr"))
    return rows.withColumn("hash", S.content_hash("ref_num", "status"))
