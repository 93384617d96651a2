"""Queries that compare snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import diff
from wardlight.plans.registry import query
from wardlight.sources import views
from wardlight.sources.tables import table

FIELDS = ("category", "status", "qty", "mon")


@query(
    "snapshot_diff_multiset",
    f"""WITH {views.VIOLATIONS},
tagged AS (SELECT *, 1 AS o, 0 AS n FROM violations_old UNION ALL SELECT *, 0, 1 FROM violations_new),
d AS (SELECT site, category, status, qty, mon, sum(o) AS no, sum(n) AS nn FROM tagged GROUP BY ALL HAVING sum(o) <> sum(n)),
m AS (SELECT site, CAST(sum(greatest(nn - no, 0)) AS BIGINT) AS added, CAST(sum(greatest(no - nn, 0)) AS BIGINT) AS removed FROM d GROUP BY site),
t AS (SELECT site, CAST(sum(o) AS BIGINT) AS total_old, CAST(sum(n) AS BIGINT) AS total_new FROM tagged GROUP BY site)
SELECT t.site, total_old, total_new, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
  CASE WHEN total_old = 0 AND total_new > 0 THEN 'first records' WHEN total_old > 0 AND total_new = 0 THEN 'all records gone'
    WHEN coalesce(added, 0) = 0 AND coalesce(removed, 0) = 0 THEN 'unchanged' ELSE 'changed' END AS headline
FROM t LEFT JOIN m ON t.site = m.site""",
)
def snapshot_diff_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.violations(spark, sf_dir, w) for w in ("old", "new"))
    return diff.headline(diff.multiset_diff(old, new, ["site", *FIELDS]), old, new, "site")


@query(
    "snapshot_diff_rows",
    f"""WITH {views.VIOLATIONS},
o AS (SELECT site, category, status, qty, mon, count(*) AS c FROM violations_old GROUP BY ALL),
n AS (SELECT site, category, status, qty, mon, count(*) AS c FROM violations_new GROUP BY ALL)
SELECT site, category, status, qty, mon, coalesce(o.c, 0) AS n_old, coalesce(n.c, 0) AS n_new,
  greatest(coalesce(n.c, 0) - coalesce(o.c, 0), 0) AS added, greatest(coalesce(o.c, 0) - coalesce(n.c, 0), 0) AS removed
FROM o FULL JOIN n USING (site, category, status, qty, mon) WHERE coalesce(o.c, 0) <> coalesce(n.c, 0)""",
)
def snapshot_diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.violations(spark, sf_dir, w) for w in ("old", "new"))
    return diff.multiset_diff(old, new, ["site", *FIELDS])


@query(
    "multiset_counts",
    f"""WITH {views.VIOLATIONS}
SELECT site, CAST(sum(c) AS BIGINT) AS total, count(*) AS distinct_records FROM (SELECT site, category, status, qty, mon, count(*) AS c FROM violations_old GROUP BY ALL) GROUP BY site""",
)
def multiset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = diff.counted(views.violations(spark, sf_dir, "old"), ["site", *FIELDS])
    return runs.groupBy("site").agg(F.sum("n").alias("total"), F.count("*").alias("distinct_records"))


@query(
    "snapshot_digest_multiset",
    f"""WITH {views.VIOLATIONS},
t AS (SELECT site, substr(sha256(CAST(to_json([CAST(category AS VARCHAR), CAST(status AS VARCHAR), CAST(qty AS VARCHAR), CAST(mon AS VARCHAR)]) AS VARCHAR)), 1, 12) AS digest, d FROM
  (SELECT *, -1 AS d FROM violations_old UNION ALL SELECT *, 1 FROM violations_new))
SELECT site, digest, CAST(sum(d) AS BIGINT) AS delta FROM t GROUP BY ALL HAVING sum(d) <> 0""",
)
def snapshot_digest_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.violations(spark, sf_dir, w) for w in ("old", "new"))
    return diff.digest_multiset_diff(old, new, FIELDS, ["site"])


@query(
    "snapshot_diff_keyed",
    f"""WITH {views.PERMITS},
j AS (SELECT permit, o.permit AS op, n.permit AS np, o.site AS os, n.site AS ns, o.status AS ot, n.status AS nt, o.category AS oc, n.category AS nc, o.effective AS oe, n.effective AS ne
  FROM permits_old o FULL JOIN permits_new n USING (permit)),
d AS (SELECT *, concat_ws('; ', CASE WHEN os <> ns THEN 'site: ' || os || ' -> ' || ns END, CASE WHEN ot <> nt THEN 'status: ' || ot || ' -> ' || nt END,
  CASE WHEN oc <> nc THEN 'category: ' || oc || ' -> ' || nc END, CASE WHEN oe <> ne THEN 'effective: ' || oe || ' -> ' || ne END) AS f FROM j)
SELECT permit, CASE WHEN op IS NULL THEN 'NEW' WHEN np IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change,
  CASE WHEN op IS NULL OR np IS NULL THEN '' ELSE f END AS fields
FROM d WHERE op IS NULL OR np IS NULL OR f <> ''""",
)
def snapshot_diff_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.permits(spark, sf_dir, w) for w in ("old", "new"))
    return diff.keyed_diff(old, new, ["permit"], ["site", "status", "category", "effective"])


@query(
    "snapshot_digest_diff",
    f"""WITH {views.PERMITS},
o AS (SELECT permit, substr(sha256(CAST(to_json([CAST(site AS VARCHAR), CAST(status AS VARCHAR), CAST(category AS VARCHAR), CAST(effective AS VARCHAR)]) AS VARCHAR)), 1, 12) AS d_old FROM permits_old),
n AS (SELECT permit, substr(sha256(CAST(to_json([CAST(site AS VARCHAR), CAST(status AS VARCHAR), CAST(category AS VARCHAR), CAST(effective AS VARCHAR)]) AS VARCHAR)), 1, 12) AS d_new FROM permits_new)
SELECT permit, d_old, d_new, CASE WHEN d_old IS NULL THEN 'NEW' WHEN d_new IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
FROM o FULL JOIN n USING (permit) WHERE d_old IS DISTINCT FROM d_new""",
)
def snapshot_digest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.permits(spark, sf_dir, w) for w in ("old", "new"))
    return diff.digest_keyed_diff(old, new, ["permit"], ["site", "status", "category", "effective"])


@query(
    "duplicate_key_guard",
    """SELECT l_suppkey % 19 AS site, count(*) AS n_rows, count(DISTINCT l_orderkey * 100 + l_linenumber) AS n_keys,
  count(*) > count(DISTINCT l_orderkey * 100 + l_linenumber) AS has_duplicates FROM lineitem GROUP BY 1""",
)
def duplicate_key_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 19).alias("site"), "l_orderkey", "l_linenumber")
    return diff.duplicate_keys(rows, ["l_orderkey", "l_linenumber"], ["site"])


@query(
    "identity_hash_diff",
    f"""WITH {views.PERMITS},
n AS (SELECT permit, min(substr(sha256(CAST(to_json([CAST(status AS VARCHAR), CAST(category AS VARCHAR)]) AS VARCHAR)), 1, 12)) AS hash, count(*) - 1 AS collisions FROM permits_new GROUP BY permit),
o AS (SELECT permit, min(substr(sha256(CAST(to_json([CAST(status AS VARCHAR), CAST(category AS VARCHAR)]) AS VARCHAR)), 1, 12)) AS old_hash FROM permits_old GROUP BY permit)
SELECT n.permit, hash, collisions, CASE WHEN old_hash IS NULL THEN 'new' WHEN old_hash <> hash THEN 'changed' ELSE 'unchanged' END AS state
FROM n LEFT JOIN o ON n.permit = o.permit""",
)
def identity_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.permits(spark, sf_dir, w) for w in ("old", "new"))
    return diff.identity_diff(old, new, ["permit"], ["status", "category"])


@query(
    "identity_carry",
    f"""WITH {views.PERMITS},
n AS (SELECT permit, substr(sha256(CAST(to_json([CAST(status AS VARCHAR), CAST(category AS VARCHAR)]) AS VARCHAR)), 1, 12) AS hash FROM permits_new),
o AS (SELECT permit, substr(sha256(CAST(to_json([CAST(status AS VARCHAR), CAST(category AS VARCHAR)]) AS VARCHAR)), 1, 12) AS hash FROM permits_old)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE permit NOT IN (SELECT permit FROM n)""",
)
def identity_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (views.permits(spark, sf_dir, w).select("permit", diff.digest("status", "category").alias("hash")) for w in ("old", "new"))
    return diff.carried(old, new, ["permit"])


@query(
    "watch_log_latest",
    f"""WITH {views.WATCH_LOG} SELECT item, arg_max(hash, ord) AS hash, max(ord) AS ord FROM watch_log GROUP BY item""",
)
def watch_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.latest_per_key(views.watch_log(spark, sf_dir), ["item"], "ord")


@query(
    "hash_gate",
    f"""WITH {views.WATCH_LOG},
c AS (SELECT item, arg_max(hash, ord) AS hash FROM watch_log GROUP BY item),
l AS (SELECT item, arg_max(hash, ord) AS last_hash FROM watch_log WHERE ord % 3 <> 0 AND item % 7 <> 0 GROUP BY item)
SELECT c.item, c.hash, last_hash, CASE WHEN last_hash IS NULL THEN 'baseline' WHEN last_hash <> c.hash THEN 'changed' ELSE 'unchanged' END AS result
FROM c LEFT JOIN l ON c.item = l.item""",
)
def hash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.watch_log(spark, sf_dir)
    now = diff.latest_per_key(log, ["item"], "ord").select("item", "hash")
    return diff.hash_gate(now, log.where("ord % 3 <> 0 and item % 7 <> 0"), ["item"], "ord")


@query(
    "snapshot_hash_compare",
    f"""WITH {views.VIOLATIONS},
h AS (SELECT v, site, substr(sha256(count(*) || '|' || CAST(sum(CAST(('0x' || substr(sha256(CAST(to_json([CAST(category AS VARCHAR), CAST(status AS VARCHAR), CAST(qty AS VARCHAR), CAST(mon AS VARCHAR)]) AS VARCHAR)), 1, 15)) AS BIGINT)) AS HUGEINT)), 1, 16) AS hash, count(*) AS n
  FROM (SELECT 0 AS v, * FROM violations_old UNION ALL SELECT 1, * FROM violations_new) GROUP BY v, site)
SELECT n.site, n.hash, n.n AS n_rows, CASE WHEN o.hash IS NULL THEN 'baseline' WHEN o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS result
FROM h n LEFT JOIN h o ON n.site = o.site AND o.v = 0 WHERE n.v = 1""",
)
def snapshot_hash_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (diff.snapshot_hash(views.violations(spark, sf_dir, w), ["site"], FIELDS) for w in ("old", "new"))
    return diff.hash_gate(new, old.withColumn("ord", F.lit(1)), ["site"], "ord").select("site", "hash", "n_rows", "result")


@query(
    "folder_name_diff",
    """WITH f AS (SELECT p_size % 10 AS folder, p_name AS name, p_partkey FROM part),
o AS (SELECT DISTINCT folder, name FROM f WHERE p_partkey % 9 <> 0), n AS (SELECT DISTINCT folder, name FROM f WHERE p_partkey % 9 <> 1)
(SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) UNION ALL (SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n))""",
)
def folder_name_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("folder"), F.col("p_name").alias("name"), "p_partkey")
    return diff.set_diff(names.where("p_partkey % 9 <> 0"), names.where("p_partkey % 9 <> 1"), ["folder"], "name")


@query(
    "nested_event_diff",
    """WITH p AS (SELECT o_orderkey AS event, o_orderstatus AS name, o_custkey % 5 AS notice FROM orders),
po AS (SELECT * FROM p WHERE event % 20 <> 0), pn AS (SELECT event, CASE WHEN event % 20 = 2 THEN 'X' ELSE name END AS name, notice FROM p WHERE event % 20 <> 1),
k AS (SELECT l_orderkey AS event, l_linenumber AS file, max(l_returnflag) AS kind FROM lineitem GROUP BY ALL),
ko AS (SELECT * FROM k WHERE (event + file) % 11 <> 0 AND event % 20 <> 0), kn AS (SELECT event, file, CASE WHEN (event + file) % 17 = 3 THEN 'E' ELSE kind END AS kind FROM k WHERE (event + file) % 13 <> 0 AND event % 20 <> 1),
pj AS (SELECT event, o.event AS oe, n.event AS ne, concat_ws('; ', CASE WHEN o.name <> n.name THEN 'name: ' || o.name || ' -> ' || n.name END, CASE WHEN o.notice <> n.notice THEN 'notice: ' || o.notice || ' -> ' || n.notice END) AS f
  FROM po o FULL JOIN pn n USING (event)),
pc AS (SELECT event, CASE WHEN oe IS NULL THEN 'NEW' WHEN ne IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change, CASE WHEN oe IS NULL OR ne IS NULL THEN '' ELSE f END AS fields FROM pj WHERE oe IS NULL OR ne IS NULL OR f <> ''),
kc AS (SELECT event, count(*) FILTER (o.file IS NULL) AS files_added, count(*) FILTER (n.file IS NULL) AS files_removed, count(*) FILTER (o.kind <> n.kind) AS files_edited
  FROM ko o FULL JOIN kn n USING (event, file) WHERE o.file IS NULL OR n.file IS NULL OR o.kind <> n.kind GROUP BY event)
SELECT event, CASE change WHEN 'REMOVED' THEN 'GONE' WHEN 'NEW' THEN 'NEW' ELSE 'CHANGED' END AS state, coalesce(fields, '') AS fields,
  coalesce(files_added, 0) AS files_added, coalesce(files_removed, 0) AS files_removed, coalesce(files_edited, 0) AS files_edited
FROM pc FULL JOIN kc USING (event)""",
)
def nested_event_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("name"), (F.col("o_custkey") % 5).alias("notice"))
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("file")).agg(F.max("l_returnflag").alias("kind"))
    new_p = p.where("event % 20 <> 1").withColumn("name", F.when(F.col("event") % 20 == 2, "X").otherwise(F.col("name")))
    new_k = k.where("(event + file) % 13 <> 0 and event % 20 <> 1").withColumn("kind", F.when((F.col("event") + F.col("file")) % 17 == 3, "E").otherwise(F.col("kind")))
    return diff.nested_diff(p.where("event % 20 <> 0"), new_p, k.where("(event + file) % 11 <> 0 and event % 20 <> 0"), new_k, "event", ["name", "notice"], "file", ["kind"])


@query(
    "mention_flip",
    """WITH d AS (SELECT doc_id, lang, contains(lower(text), 'with') AS m, contains(lower(text), 'that') AS m2 FROM documents)
SELECT doc_id, CASE WHEN m2 THEN 'appeared' ELSE 'disappeared' END AS change FROM d WHERE m <> m2""",
)
def mention_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    old = d.select("doc_id", F.contains("text", F.lit("with")).alias("m"))
    new = d.select("doc_id", F.contains("text", F.lit("that")).alias("m"))
    return diff.presence_flip(old, new, "doc_id", "m")
