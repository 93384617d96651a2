"""Domain views over the driver tables, and the same views as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.sources.tables import table


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air readings: station, stamps, two pollutants with sentinels, nulls and detection flags."""
    e = table(spark, sf_dir, "events")
    station = F.when(F.col("user_id") % 13 == 0, F.concat(F.lit("MET-"), F.col("user_id") % 2)).otherwise(F.concat(F.lit("MS-"), F.col("user_id") % 6 + 1))
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").alias("oid"),
        station.alias("station"),
        F.col("ts"),
        F.when(F.col("event_id") % 97 == 0, 999.0).when(F.col("event_id") % 89 == 0, None).otherwise(F.col("value")).alias("h2s"),
        F.when(F.col("event_id") % 101 == 0, 99999.0).otherwise(k * 6).alias("ch4"),
        F.when(F.col("value") < 1, "BDL").alias("h2s_text"),
    )


READINGS = """readings AS (
  SELECT event_id AS oid,
    CASE WHEN user_id % 13 = 0 THEN 'MET-' || (user_id % 2) ELSE 'MS-' || (user_id % 6 + 1) END AS station, ts,
    CASE WHEN event_id % 97 = 0 THEN 999.0 WHEN event_id % 89 = 0 THEN NULL ELSE value END AS h2s,
    CASE WHEN event_id % 101 = 0 THEN 99999.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) * 6 END AS ch4,
    CASE WHEN value < 1 THEN 'BDL' END AS h2s_text
  FROM events)"""


def violations(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """A snapshot of violations without a key; ``which`` is ``old`` or ``new``."""
    keep = F.col("l_orderkey") % 10 != (0 if which == "old" else 1)
    return (
        table(spark, sf_dir, "lineitem")
        .where(keep)
        .select(
            (F.col("l_suppkey") % 19).alias("site"),
            F.col("l_returnflag").alias("category"),
            F.col("l_linestatus").alias("status"),
            F.col("l_quantity").cast("int").alias("qty"),
            F.month("l_shipdate").alias("mon"),
        )
    )


def _violations(which: str, rest: int) -> str:
    return f"""violations_{which} AS (
  SELECT l_suppkey % 19 AS site, l_returnflag AS category, l_linestatus AS status, CAST(l_quantity AS INT) AS qty, month(l_shipdate) AS mon
  FROM lineitem WHERE l_orderkey % 10 <> {rest})"""


VIOLATIONS = _violations("old", 0) + ",\n" + _violations("new", 1)


def permits(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """A keyed snapshot of permits; in the new one some are advanced, some gone, some fresh."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    if which == "new":
        status = F.when(F.col("o_orderkey") % 20 == 2, "X").otherwise(status)
    return o.where(F.col("o_orderkey") % 20 != (0 if which == "old" else 1)).select(
        F.col("o_orderkey").alias("permit"),
        (F.col("o_custkey") % 19).alias("site"),
        status.alias("status"),
        F.col("o_orderpriority").alias("category"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective"),
    )


def _permits(which: str, rest: int) -> str:
    status = "CASE WHEN o_orderkey % 20 = 2 THEN 'X' ELSE o_orderstatus END" if which == "new" else "o_orderstatus"
    return f"""permits_{which} AS (
  SELECT o_orderkey AS permit, o_custkey % 19 AS site, {status} AS status, o_orderpriority AS category, strftime(o_orderdate, '%Y-%m-%d') AS effective
  FROM orders WHERE o_orderkey % 20 <> {rest})"""


PERMITS = _permits("old", 0) + ",\n" + _permits("new", 1)


def watch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log of watched items with a snapshot hash."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("item"), F.col("event_id").alias("ord"), F.substring(F.sha2("props", 256), 1, 16).alias("hash"))


WATCH_LOG = "watch_log AS (SELECT user_id AS item, event_id AS ord, substr(sha256(props), 1, 16) AS hash FROM events)"


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only document states: processed, skipped or error."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "processed").when(F.col("event_type") == "signup", "skipped").otherwise("error")
    return e.select((F.col("event_id") % 3000).alias("doc"), F.col("event_id").alias("ord"), status.alias("status"))


STATE_LOG = """state_log AS (
  SELECT event_id % 3000 AS doc, event_id AS ord,
    CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'skipped' ELSE 'error' END AS status FROM events)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    doc_type = F.when(F.col("o_orderstatus") == "F", "evidence").when(F.col("o_orderstatus") == "O", "procedural").otherwise("opinion")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderpriority").startswith("2"), "notable").otherwise("routine")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("F"), F.col("o_custkey") % 6).alias("facility"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_filed"),
        doc_type.alias("doc_type"),
        severity.alias("severity"),
        F.col("o_totalprice").alias("price"),
    )


FILINGS = """filings AS (
  SELECT o_orderkey AS doc_id, 'F' || (o_custkey % 6) AS facility, strftime(o_orderdate, '%Y-%m-%d') AS date_filed,
    CASE o_orderstatus WHEN 'F' THEN 'evidence' WHEN 'O' THEN 'procedural' ELSE 'opinion' END AS doc_type,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderpriority LIKE '2%' THEN 'notable' ELSE 'routine' END AS severity,
    o_totalprice AS price FROM orders)"""


def filing_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each risk that a filing names, R9 among them, which is none."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("R"), F.col("l_linenumber") + F.col("l_suppkey") % 3).alias("risk"))


FILING_RISKS = "filing_risks AS (SELECT l_orderkey AS doc_id, 'R' || (l_linenumber + l_suppkey % 3) AS risk FROM lineitem)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of filings with metric, basis and unit."""
    li = table(spark, sf_dir, "lineitem")
    metric = F.when(F.col("l_returnflag") == "A", "temperature").when(F.col("l_returnflag") == "N", "oxygen").otherwise("methane")
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        metric.alias("metric"),
        F.when(F.col("l_linestatus") == "F", "measured").otherwise("permitted_limit").alias("basis"),
        (F.col("l_quantity") * 4).alias("value"),
        F.when(F.col("l_linenumber") == 7, "C").otherwise("F").alias("unit"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("as_of"),
    )


MEASUREMENTS = """measurements AS (
  SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'A' THEN 'temperature' WHEN 'N' THEN 'oxygen' ELSE 'methane' END AS metric,
    CASE WHEN l_linestatus = 'F' THEN 'measured' ELSE 'permitted_limit' END AS basis, l_quantity * 4 AS value,
    CASE WHEN l_linenumber = 7 THEN 'C' ELSE 'F' END AS unit, strftime(l_shipdate, '%Y-%m-%d') AS as_of FROM lineitem)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site registry with a cadence; one cadence value is unknown."""
    s = table(spark, sf_dir, "supplier")
    cadence = F.when(F.col("s_nationkey") % 4 == 0, "daily").when(F.col("s_nationkey") % 4 == 1, "biweekly").when(F.col("s_nationkey") % 4 == 2, "quarterly").otherwise("someday")
    return s.select(F.col("s_suppkey").alias("site"), F.concat(F.lit("N"), F.col("s_suppkey")).alias("srn"), F.col("s_name").alias("name"), cadence.alias("cadence"))


SITES = """sites AS (
  SELECT s_suppkey AS site, 'N' || s_suppkey AS srn, s_name AS name,
    CASE s_nationkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'quarterly' ELSE 'someday' END AS cadence FROM supplier)"""
