"""Durable state: logs folded on read, work selection, purges, guards and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def folded(log: DataFrame) -> DataFrame:
    """Current state of each document of a processed / skipped / error log.

    Processed wins for ever; skipped holds if it came after the last processed row; errors count only
    while no terminal row stands.
    """
    last = {s: F.max(F.when(F.col("status") == s, F.col("ord"))) for s in ("processed", "skipped")}
    terminal = F.min(F.when(F.col("status") != "error", F.col("ord")))
    sums = log.groupBy("doc").agg(last["processed"].alias("_p"), last["skipped"].alias("_s"), F.count_if(F.col("status") == "error").alias("_e"), terminal.alias("_t"))
    return sums.select(
        "doc",
        F.col("_p").isNotNull().alias("processed"),
        (F.col("_s").isNotNull() & (F.col("_p").isNull() | (F.col("_s") > F.col("_p")))).alias("skipped"),
        F.when(F.col("_t").isNull(), F.col("_e")).otherwise(0).alias("errors"),
    )


def todo(listed: DataFrame, state: DataFrame, most_errors: int = 3, retry_poisoned: bool = False, force: Sequence[int] = ()) -> DataFrame:
    """Listed documents still to do, with the reason; ``force`` overrides everything."""
    both = listed.join(state, "doc", "left").fillna({"processed": False, "skipped": False, "errors": 0})
    forced = F.col("doc").isin(list(force)) if force else F.lit(False)
    reason = F.when(forced, "forced").when(F.col("processed") | F.col("skipped"), None)
    reason = reason.when((F.col("errors") >= most_errors) & ~F.lit(retry_poisoned), None).when(F.col("errors") > 0, "retry")
    return both.withColumn("reason", reason.otherwise("new")).where("reason is not null").select("doc", "reason")


def batch(rows: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` rows of the work to do, in order: what one run takes on."""
    return rows.orderBy(*order).limit(size)


def unarchived(listed: DataFrame, archived: DataFrame, key: str) -> DataFrame:
    """Listed rows whose key, as text, isn't archived."""
    return listed.join(archived.select(F.col(key).cast("string").alias("_k")).distinct(), F.col(key).cast("string") == F.col("_k"), "left_anti")


def matched(ids: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Ids with ``found``: whether the live list still has them."""
    return ids.join(live.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")


def purge_preview(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that a purge of ``ids`` would take from each table."""
    counts = [df.join(ids.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in tables.items()]
    found = counts[0]
    for c in counts[1:]:
        found = found.unionByName(c)
    return found


def purged(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def with_defaults(meta: DataFrame, defaults: DataFrame) -> DataFrame:
    """Latest value of each known setting, or its default."""
    now = meta.groupBy("key").agg(F.max_by("value", "ord").alias("_v"))
    return defaults.join(now, "key", "left").select("key", F.coalesce("_v", "value").alias("value"))


def tally(results: DataFrame, column: str = "result") -> DataFrame:
    return results.groupBy(column).agg(F.count("*").alias("n"))


def bad_fetch(counts: DataFrame, floor: float = 0.5) -> DataFrame:
    """``keep`` the old state where a fetch has no rows or under ``floor`` of the last count, else ``accept``."""
    n, last = F.coalesce("n", F.lit(0)), F.coalesce("last_n", F.lit(0))
    return counts.withColumn("decision", F.when((n == 0) | (n < floor * last), "keep").otherwise("accept"))


def over_cap(counts: DataFrame, cap: int) -> DataFrame:
    """``rebaseline`` silently where there are more events than anybody could read, else ``emit``."""
    return counts.withColumn("decision", F.when(F.col("n") > cap, "rebaseline").otherwise("emit"))


def shrunk(counts: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``refuse`` to publish a table that lost more than a tenth of its rows."""
    return counts.withColumn("decision", F.when(F.col("n") < ratio * F.coalesce("last_n", F.lit(0)), "refuse").otherwise("publish"))


def transient(status: Column, message: Column) -> Column:
    """Whether a failure should be retried without a strike: rate limits, server errors, quota messages."""
    # Messages of quotas and load.
    marks = "usage limit|rate limit|rate_limit|too many requests|overloaded"
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) | F.coalesce(F.lower(message).rlike(marks), F.lit(False))


def stagger(srn: Column, period: int) -> Column:
    """The SHA-256 of a site id, as one large number, modulo ``period``: folded digit by digit."""
    digits = F.split(F.sha2(srn, 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: F.pmod(acc * 16 + F.conv(d, 16, 10).cast("int"), F.lit(period)))


def due(sites: DataFrame, asof: str, window: int = 3) -> DataFrame:
    """Sites whose cadence falls due: daily, or within ``window`` days of their own place in a period; an unknown cadence is due."""
    ordinal = F.unix_date(F.lit(asof).cast("date")) + 719163
    rule = F.when(F.col("cadence") == "daily", True)
    for name, days in (("biweekly", 14), ("quarterly", 90)):
        rule = rule.when(F.col("cadence") == name, F.pmod(ordinal - stagger(F.col("srn"), days), F.lit(days)) < window)
    return sites.withColumn("due", rule.otherwise(True))


def matched_tiers(tiers: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Tiers joined with the registry; an id that the registry lacks fails the job."""
    both = tiers.join(sites.withColumn("_known", F.lit(True)), key, "left")
    return both.where(F.col("_known").isNotNull() | F.raise_error(F.concat(F.lit("unknown site "), F.col(key).cast("string"))).cast("boolean")).drop("_known")


def meeting_due(events: DataFrame, asof: str, weekday: int, days_before: int) -> DataFrame:
    """Due on one weekday (Monday 0), or up to ``days_before`` days before the event; an unknown date goes by weekday."""
    day = F.lit(asof).cast("date")
    ahead = F.datediff(F.col("date"), day)
    return events.withColumn("due", F.coalesce(ahead.between(0, days_before), F.lit(False)) | (F.weekday(day) == weekday))


def upcoming(events: DataFrame, days: DataFrame, ahead: int = 14) -> DataFrame:
    """Events that overlap each as-of day and the ``ahead`` after it; an end before the start counts as the start.

    Each event is joined through the days it covers, so many as-of days need no product with all events.
    """
    end = F.when(F.col("end_date").isNull() | (F.col("end_date") < F.col("date")), F.col("date")).otherwise(F.col("end_date"))
    spread = events.withColumn("end_date", end).where(F.trim("title") != "").withColumn("on_day", F.explode(F.sequence(F.date_sub("date", ahead), F.col("end_date"))))
    return spread.join(days, "on_day", "left_semi")


def all_baselined(items: DataFrame) -> DataFrame:
    """Whether every item of a watch has a baseline, so that an error may stay quiet."""
    return items.groupBy("watch").agg(F.bool_and(F.col("last_hash").isNotNull()).alias("all_baselined"))


def phantom(current: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Ids that return nothing: ``skip`` if never seen, ``gone`` if seen before; others ``check``."""
    both = current.join(log.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    return both.withColumn("decision", F.when(F.col("hash").isNotNull(), "check").when(F.col("_seen"), "gone").otherwise("skip")).drop("_seen")


def delivered(seen: DataFrame, fresh: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """The next seen table: fresh rows advance only if their alert went out."""
    sent = fresh.join(failed.select(key).distinct(), key, "left_anti")
    return seen.join(sent, key, "left_anti").select(*seen.columns).unionByName(sent.select(*seen.columns))


def capped(lines: DataFrame, by: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` lines of each group, and one that says how many more there are."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    shown = lines.withColumn("nth", nth).where(F.col("nth") <= cap)
    rest = lines.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > cap)
    more = rest.select(*by, F.concat(F.lit("… "), F.col("_n") - cap, F.lit(" more")).alias("line"), F.lit(cap + 1).alias("nth"))
    return shown.select(*by, "line", "nth").unionByName(more)


def stubs(failed: DataFrame, columns: Sequence[str], note: str) -> DataFrame:
    """Rows that keep unprocessable sources visible: known columns, empty others, and a note."""
    have = set(failed.columns)
    return failed.select(*[F.col(c) if c in have else F.lit("").alias(c) for c in columns], F.lit(note).alias("note"))


def minimum_evidence(rows: DataFrame, valid: Column, anchor: Column, least: int = 50, anchors: int = 1) -> DataFrame:
    """Per document whether its parsed rows may replace what stands: enough valid ones and an anchor."""
    sums = rows.groupBy("doc").agg(F.count_if(valid).alias("n_valid"), F.count_if(anchor).alias("n_anchor"))
    return sums.withColumn("replace", (F.col("n_valid") >= least) & (F.col("n_anchor") >= anchors))
