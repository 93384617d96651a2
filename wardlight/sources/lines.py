"""Line tables derived from the driver tables: gas tables, CO tables and monthly reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.sources.tables import table


#: Orders whose lines make up one gas report, and one CO report.
GAS_REPORT, CO_REPORT = 256, 4096


def well_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gas record of each lineitem row as 11 or 12 lines, in reports of ``GAS_REPORT`` orders; the gases of every fiftieth order don't add up, and every seventh's rows bear a date alone."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    ch4, co2, o2 = q, F.lit(20), F.col("l_linenumber")
    rest = 100 - ch4 - co2 - o2 + F.when(F.col("l_orderkey") % 50 == 0, 30).otherwise(0)
    name = F.concat(F.lit("AHW"), "l_partkey", F.when(F.col("l_linenumber") % 3 == 0, "**").otherwise(""))
    day = F.concat(F.month("l_shipdate"), F.lit("/"), F.dayofmonth("l_shipdate"), F.lit("/"), F.year("l_shipdate"))
    stamp = F.concat(day, F.when(F.col("l_orderkey") % 7 == 0, "").otherwise(" 8:30"))
    numbers = [x.cast("string") for x in (ch4, co2, o2, rest, F.lit(-1), 90 + q, 80 + q, F.lit(-2), F.lit(-3))]
    adj = F.when(F.col("l_linenumber") == 5, F.array(F.lit("ADJ"))).otherwise(F.array().cast("array<string>"))
    few = F.when(F.col("l_linenumber") == 6, F.slice(F.array(*numbers), 1, 5)).otherwise(F.array(*numbers))
    parts = F.concat(F.array(name, stamp), adj, few, F.array(F.lit(" "), F.lit("Comment: none")))
    doc = F.floor(F.col("l_orderkey") / GAS_REPORT)
    order = W.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
    rows = li.withColumn("doc", doc).withColumn("k", F.row_number().over(order).cast("long")).select("doc", "k", F.posexplode(parts).alias("n", "text"))
    return rows.select("doc", (F.col("k") * 20 + F.col("n")).alias("line_no"), F.floor(F.col("k") / 40).cast("int").alias("page"), "text")


WELL_ROWS = f"""numbered AS (
  SELECT l_orderkey // {GAS_REPORT} AS doc, row_number() OVER (PARTITION BY l_orderkey // {GAS_REPORT} ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_shipdate) AS k,
    l_partkey, CAST(l_quantity AS INT) AS q, l_orderkey, l_linenumber, l_shipdate FROM lineitem),
wells AS (
  SELECT doc, k * 20 AS line_no, CAST(floor(k / 40) AS INT) AS page, 'AHW' || l_partkey AS well_id, month(l_shipdate) || '/' || day(l_shipdate) || '/' || year(l_shipdate) || ' 8:30' AS dt, l_linenumber = 5 AS adj,
    CAST(q AS DOUBLE) AS ch4, 20.0::DOUBLE AS co2, CAST(l_linenumber AS DOUBLE) AS o2, (100 - q - 20 - l_linenumber + CASE WHEN l_orderkey % 50 = 0 THEN 30 ELSE 0 END)::DOUBLE AS balance,
    (90 + q)::DOUBLE AS temp, l_orderkey % 50 <> 0 AS valid, l_shipdate FROM numbered WHERE l_linenumber <> 6 AND l_orderkey % 7 <> 0)"""


def co_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CO reports of ``CO_REPORT`` orders, a page a month: a title on two lines, a header, then well, day and ppm lines; some pages lack the ppm header."""
    o = table(spark, sf_dir, "orders")
    ppm = F.when(F.col("o_orderkey") % 97 == 0, "45658.00").otherwise((F.col("o_custkey") % 900).cast("string"))
    day = F.concat(F.month("o_orderdate"), F.lit("/"), F.dayofmonth("o_orderdate"), F.lit("/"), F.year("o_orderdate"))
    page = F.concat(F.year("o_orderdate"), F.lpad(F.month("o_orderdate"), 2, "0")).cast("int")
    doc = F.floor(F.col("o_orderkey") / CO_REPORT).alias("doc")
    triple = o.select(doc, page.alias("page"), "o_orderkey", F.posexplode(F.array(F.concat(F.lit("AHCO"), F.col("o_custkey") % 60, F.lit("****")), day, ppm)).alias("n", "text"))
    body = triple.select("doc", "page", (F.col("page").cast("long") * 10_000_000 + 100 + F.col("o_orderkey") % CO_REPORT * 4 + F.col("n")).alias("line_no"), "text")
    head = F.array(F.lit("Attachment 2 -"), F.date_format("o_orderdate", "MMMM  yyyy 'CO Data'"), F.when(page % 5 == 0, "CO (ppm) %").otherwise("ppm"))
    tops = o.select(doc, page.alias("page"), F.posexplode(head).alias("n", "text")).distinct().select("doc", "page", (F.col("page").cast("long") * 10_000_000 + F.col("n")).alias("line_no"), "text")
    return body.unionByName(tops).select("doc", "page", "line_no", "text")


CO_ROWS = f"""co AS (
  SELECT o_orderkey // {CO_REPORT} AS doc, 'AHCO' || (o_custkey % 60) AS well_id, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_custkey % 900 AS DOUBLE) AS ppm, o_orderdate, o_orderkey FROM orders
  WHERE o_orderkey % 97 <> 0 AND (year(o_orderdate) * 100 + month(o_orderdate)) % 5 <> 0
  QUALIFY row_number() OVER (PARTITION BY o_orderkey // {CO_REPORT}, o_custkey % 60, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) = 1)"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly reports of each user: a date line and a value line for each day with events, blanks between; some years have two digits, some lines space around them."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = e.groupBy((F.col("user_id") % 50).alias("report"), "day").agg(F.min("value").alias("v"))
    value = F.when(F.col("v") < 1, F.when(F.col("report") % 4 == 0, "< 1").otherwise("<1")).otherwise(F.floor("v").cast("string"))
    shown = F.concat(F.when(F.col("report") % 5 == 0, "  ").otherwise(""), F.month("day"), F.lit("/"), F.dayofmonth("day"), F.lit("/"), F.when(F.col("report") % 2 == 1, F.year("day") % 100).otherwise(F.year("day")), F.lit(" "))
    gap = F.when(F.dayofmonth("day") % 9 == 0, F.array(shown, F.lit(""), F.lit(""), F.lit(""), value)).when(F.dayofmonth("day") % 9 == 4, F.array(shown, F.lit("n/a"))).otherwise(F.array(shown, F.lit(" "), value))
    rows = days.select("report", "day", F.posexplode(gap).alias("n", "text"))
    return rows.select("report", (F.unix_date("day") * 10 + F.col("n")).alias("line_no"), "text")


REPORT_ROWS = """days AS (
  SELECT user_id % 50 AS report, CAST(ts AS DATE) AS day, min(value) AS v FROM events GROUP BY ALL),
vals AS (SELECT report, CASE WHEN day(day) % 9 IN (0, 4) THEN NULL WHEN v < 1 THEN '<1' ELSE CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) END AS value FROM days)"""


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole monthly reports, one for each user and month: a head, the days' lines, a sentence of clearance (broken over lines, or missing), footnotes that name levels and may repeat it."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = e.groupBy("user_id", "day").agg(F.min("value").alias("v"))
    value = F.when(F.col("v") < 1, F.when(F.col("user_id") % 4 == 0, "< 1").otherwise("<1")).otherwise(F.floor("v").cast("string"))
    shown = F.concat(F.month("day"), F.lit("/"), F.dayofmonth("day"), F.lit("/"), F.when(F.col("user_id") % 2 == 1, F.year("day") % 100).otherwise(F.year("day")))
    line = F.when(F.dayofmonth("day") % 9 == 0, F.concat(shown, F.lit("\n\n\n\n"), value)).when(F.dayofmonth("day") % 9 == 4, F.concat(shown, F.lit("\nn/a"))).otherwise(F.concat(shown, F.lit("\n \n"), value))
    month = F.date_format("day", "yyyy-MM")
    rows = days.select("user_id", month.alias("month"), "day", line.alias("line")).groupBy("user_id", "month").agg(F.sort_array(F.collect_list(F.struct("day", "line"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    k = F.col("user_id") % 5
    clear = F.when(k == 0, "There were no  notifications\nrequired to be sent.").when(k == 1, "No notification required to\n be sent").when(k == 2, "Notifications were required.").otherwise("")
    notes = F.when(F.col("user_id") % 3 == 0, "\n 1 Notifications are sent if a mean exceeds 72 ppb;\nelse there are no notifications required to be sent.").otherwise("")
    return rows.select(F.concat_ws(" ", "user_id", "month").alias("report"), F.concat(F.lit("Monthly report "), "month", F.lit("\n\nDate\nMean\n"), body, F.lit("\n\n"), clear, notes).alias("text"))


REPORT_TEXTS = """report_days AS (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS v FROM events GROUP BY ALL),
report_day_lines AS (SELECT *, month(day) || '/' || day(day) || '/' || (CASE WHEN user_id % 2 = 1 THEN year(day) % 100 ELSE year(day) END) AS shown,
  CASE WHEN v < 1 THEN CASE WHEN user_id % 4 = 0 THEN '< 1' ELSE '<1' END ELSE CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) END AS value FROM report_days),
report_texts AS (SELECT user_id || ' ' || strftime(day, '%Y-%m') AS report, 'Monthly report ' || strftime(day, '%Y-%m') || chr(10) || chr(10) || 'Date' || chr(10) || 'Mean' || chr(10)
  || string_agg(CASE WHEN day(day) % 9 = 0 THEN shown || repeat(chr(10), 4) || value WHEN day(day) % 9 = 4 THEN shown || chr(10) || 'n/a' ELSE shown || chr(10) || ' ' || chr(10) || value END, chr(10) ORDER BY day) || chr(10) || chr(10)
  || CASE user_id % 5 WHEN 0 THEN 'There were no  notifications' || chr(10) || 'required to be sent.' WHEN 1 THEN 'No notification required to' || chr(10) || ' be sent' WHEN 2 THEN 'Notifications were required.' ELSE '' END
  || CASE WHEN user_id % 3 = 0 THEN chr(10) || ' 1 Notifications are sent if a mean exceeds 72 ppb;' || chr(10) || 'else there are no notifications required to be sent.' ELSE '' END AS text
  FROM report_day_lines GROUP BY user_id, strftime(day, '%Y-%m'))"""
