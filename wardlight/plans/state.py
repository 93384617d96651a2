"""Queries over state logs, guards and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import state as st
from wardlight.plans.registry import query
from wardlight.sources import views
from wardlight.sources.tables import table

FOLD = f"""{views.STATE_LOG},
s AS (SELECT doc, max(ord) FILTER (status = 'processed') AS p, max(ord) FILTER (status = 'skipped') AS s, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status <> 'error') AS t FROM state_log GROUP BY doc),
fold AS (SELECT doc, p IS NOT NULL AS processed, s IS NOT NULL AND (p IS NULL OR s > p) AS skipped, CASE WHEN t = 0 THEN e ELSE 0 END AS errors FROM s)"""


@query("state_fold", f"WITH {FOLD} SELECT * FROM fold")
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.folded(views.state_log(spark, sf_dir))


@query(
    "todo_select",
    f"""WITH {FOLD}, l AS (SELECT DISTINCT o_orderkey % 4000 AS doc FROM orders),
j AS (SELECT l.doc, coalesce(processed, false) AS p, coalesce(skipped, false) AS s, coalesce(errors, 0) AS e FROM l LEFT JOIN fold f ON l.doc = f.doc)
SELECT doc, CASE WHEN doc IN (5, 17, 3999) THEN 'forced' WHEN e > 0 THEN 'retry' ELSE 'new' END AS reason FROM j WHERE doc IN (5, 17, 3999) OR (NOT p AND NOT s AND e < 3)""",
)
def todo_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4000).alias("doc")).distinct()
    return st.todo(listed, st.folded(views.state_log(spark, sf_dir)), force=(5, 17, 3999))


@query("new_files", "SELECT o_orderkey AS file_id, o_orderpriority AS name FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 3)")
def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("name"))
    archived = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_orderkey").cast("string").alias("file_id"))
    return st.unarchived(listed, archived, "file_id")


@query("archive_missing", "SELECT found, count(*) AS n FROM (SELECT l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0) AS found FROM lineitem) GROUP BY 1")
def archive_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    live = table(spark, sf_dir, "orders").where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("doc_id"))
    return st.tally(st.matched(ids, live, "doc_id"), "found")


@query(
    "purge_preview",
    f"""WITH {views.FILINGS}, {views.FILING_RISKS}, {views.MEASUREMENTS}, ids AS (SELECT doc_id FROM filings WHERE doc_id % 100 = 7)
SELECT 'feed' AS tab, count(*) AS n FROM filings WHERE doc_id IN (SELECT * FROM ids) UNION ALL SELECT 'evidence', count(*) FROM filing_risks WHERE doc_id IN (SELECT * FROM ids)
UNION ALL SELECT 'measurements', count(*) FROM measurements WHERE doc_id IN (SELECT * FROM ids)""",
)
def purge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = views.filings(spark, sf_dir)
    tables = {"feed": feed, "evidence": views.filing_risks(spark, sf_dir), "measurements": views.measurements(spark, sf_dir)}
    return st.purge_preview(tables, feed.where("doc_id % 100 = 7"))


COUNTS = "counts AS (SELECT l_suppkey AS site, count(*) FILTER (l_orderkey % 10 < 5) AS last_n, count(*) FILTER (l_orderkey % 10 > 5 AND l_suppkey % 9 <> 0) AS n FROM lineitem GROUP BY 1)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 10).alias("d"))
    return li.groupBy(F.col("l_suppkey").alias("site")).agg(F.count_if(F.col("d") < 5).alias("last_n"), F.count_if((F.col("d") > 5) & (F.col("l_suppkey") % 9 != 0)).alias("n"))


@query("bad_fetch_guard", f"WITH {COUNTS} SELECT *, CASE WHEN n = 0 OR n < 0.5 * last_n THEN 'keep' ELSE 'accept' END AS decision FROM counts")
def bad_fetch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.bad_fetch(counts(spark, sf_dir))


@query("over_cap_guard", f"WITH {COUNTS} SELECT *, CASE WHEN n > 240 THEN 'rebaseline' ELSE 'emit' END AS decision FROM counts")
def over_cap_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.over_cap(counts(spark, sf_dir), 240)


@query("shrink_guard", f"WITH {COUNTS} SELECT *, CASE WHEN n < 0.8 * last_n THEN 'refuse' ELSE 'publish' END AS decision FROM counts")
def shrink_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.shrunk(counts(spark, sf_dir), 0.8)


def _mod(period: int) -> str:
    """The hex digits folded from the left, as a list reduction."""
    return f"CAST(list_reduce(list_prepend(0, list_transform(string_split(sha256(srn), ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS INT))), lambda a, b: (a * 16 + b) % {period}) AS INT)"


@query(
    "cadence_due",
    f"""WITH {views.SITES}, m AS (SELECT *, {_mod(14)} AS o14, {_mod(90)} AS o90, date_diff('day', DATE '1970-01-01', DATE '2024-03-05') + 719163 AS d FROM sites)
SELECT site, srn, cadence, CASE cadence WHEN 'daily' THEN true WHEN 'biweekly' THEN ((d - o14) % 14 + 14) % 14 < 3 WHEN 'quarterly' THEN ((d - o90) % 90 + 90) % 90 < 3 ELSE true END AS due FROM m""",
)
def cadence_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.due(views.sites(spark, sf_dir), "2024-03-05").select("site", "srn", "cadence", "due")


@query(
    "meeting_due",
    """WITH e AS (SELECT o_orderkey AS event, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders)
SELECT event, date, coalesce(date_diff('day', DATE '1996-06-11', date) BETWEEN 0 AND 3, false) AS due FROM e""",
)
def meeting_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.to_date("o_orderdate"))
    return st.meeting_due(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), date.alias("date")), "1996-06-11", 4, 3)


@query(
    "upcoming_window",
    """WITH e AS (SELECT o_orderkey AS event, CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + CAST(o_custkey % 7 AS INT) - 2 AS ed, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS title FROM orders),
f AS (SELECT event, date, CASE WHEN ed < date THEN date ELSE ed END AS end_date, title FROM e WHERE trim(title) <> ''),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS on_day FROM orders)
SELECT on_day, event, date, end_date, title FROM f JOIN d ON end_date >= on_day AND date <= on_day + 14""",
)
def upcoming_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    title = F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority"))
    events = o.select(F.col("o_orderkey").alias("event"), day.alias("date"), F.date_add(day, (F.col("o_custkey") % 7 - 2).cast("int")).alias("end_date"), title.alias("title"))
    asof = o.select(day.alias("on_day")).distinct()
    return st.upcoming(events, asof).select("on_day", "event", "date", "end_date", "title")


ATTEMPTS = """attempts AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 429 WHEN 'signup' THEN 500 WHEN 'click' THEN 400 ELSE 200 END AS status,
  CASE WHEN event_id % 10 = 0 THEN 'Usage Limit reached' WHEN event_id % 10 = 1 THEN 'bad file' END AS message FROM events)"""


@query(
    "error_triage",
    f"""WITH {ATTEMPTS} SELECT status, message, (status = 429 OR status >= 500 OR coalesce(lower(message) LIKE '%usage limit%', false)) AS transient, count(*) AS n FROM attempts WHERE status <> 200 GROUP BY ALL""",
)
def error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "purchase", 429).when(t == "signup", 500).when(t == "click", 400).otherwise(200)
    message = F.when(F.col("event_id") % 10 == 0, "Usage Limit reached").when(F.col("event_id") % 10 == 1, "bad file")
    rows = table(spark, sf_dir, "events").select(status.alias("status"), message.alias("message")).where("status <> 200")
    return rows.groupBy("status", "message", st.transient(F.col("status"), F.col("message")).alias("transient")).agg(F.count("*").alias("n"))


@query(
    "capped_lines",
    """WITH l AS (SELECT l_suppkey AS site, 'order ' || l_orderkey || ' line ' || l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS nth, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT site, line, nth FROM l WHERE nth <= 15 UNION ALL SELECT DISTINCT site, '… ' || (n - 15) || ' more', 16 FROM l WHERE n > 15""",
)
def capped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lines = li.select(F.col("l_suppkey").alias("site"), F.concat(F.lit("order "), "l_orderkey", F.lit(" line "), "l_linenumber").alias("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return st.capped(lines, ["site"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")], 15)


@query(
    "delivery_retry",
    f"""WITH {views.PERMITS}, s AS (SELECT permit, status FROM permits_old), f AS (SELECT permit, status FROM permits_new WHERE permit % 6 <> 0)
SELECT * FROM f UNION ALL SELECT * FROM s WHERE permit NOT IN (SELECT permit FROM f)""",
)
def delivery_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.permits(spark, sf_dir, w).select("permit", "status") for w in ("old", "new"))
    return st.delivered(old, new, new.where("permit % 6 = 0").select("permit"), "permit")


@query(
    "phantom_ids",
    f"""WITH {views.WATCH_LOG}, c AS (SELECT c_custkey AS item, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS hash FROM customer)
SELECT item, hash, CASE WHEN hash IS NOT NULL THEN 'check' WHEN item IN (SELECT item FROM watch_log) THEN 'gone' ELSE 'skip' END AS decision FROM c""",
)
def phantom_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_name")).alias("hash"))
    return st.phantom(c, views.watch_log(spark, sf_dir), "item")


@query(
    "baseline_gate",
    f"""WITH {views.WATCH_LOG}, c AS (SELECT c_nationkey AS watch, CASE WHEN c_custkey IN (SELECT item FROM watch_log) OR c_nationkey % 2 = 0 THEN 'h' END AS last_hash FROM customer)
SELECT watch, bool_and(last_hash IS NOT NULL) AS all_baselined FROM c GROUP BY watch""",
)
def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = views.watch_log(spark, sf_dir).select(F.col("item").alias("c_custkey")).distinct().withColumn("h", F.lit("h"))
    c = table(spark, sf_dir, "customer").join(logged, "c_custkey", "left")
    return st.all_baselined(c.select(F.col("c_nationkey").alias("watch"), F.when(F.col("c_nationkey") % 2 == 0, "h").otherwise(F.col("h")).alias("last_hash")))
