"""Filings, evidence, urgency, digests and feed pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.functions import scalars as S
from wardlight.operators.ranking import placed

# Risk ids of the register.
RISKS = tuple(f"R{k}" for k in range(1, 9))
#: A row per risk: bounded by the register's length.
NAMES = {r: f"Risk {r[1:]}" for r in RISKS if r != "R8"}


def valid_risks(risks: Column, valid: Sequence[str] = RISKS) -> Column:
    """Known risk ids of a list, in order and with repeats."""
    return F.filter(risks, lambda r: r.isin(*valid))


def fanned_out(filings: DataFrame, named: DataFrame, names: dict[str, str] = NAMES, valid: Sequence[str] = RISKS) -> DataFrame:
    """One row for each valid risk of each evidence filing, with the risk's name or its id."""
    rows = filings.where("doc_type = 'evidence'").join(named.where(F.col("risk").isin(*valid)), "doc_id")
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn("risk_name", F.coalesce(F.element_at(known, F.col("risk")), F.col("risk")))


def common_evidence(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two evidence tables in one schema with a source tag; detail is ``key — summary`` without loose dashes."""

    def shaped(df: DataFrame, source: str, key: str, summary: str) -> DataFrame:
        detail = F.regexp_replace(F.concat(F.coalesce(F.col(key), F.lit("")), F.lit(" — "), F.coalesce(F.col(summary), F.lit(""))), "^[ —]+|[ —]+$", "")
        return df.select(F.lit(source).alias("source"), "risk", "date", F.col("facility"), detail.alias("detail"))

    return shaped(first, "state", "key_point", "summary").unionByName(shaped(second, "waste", "label", "detail"))


def risk_tally(evidence: DataFrame) -> DataFrame:
    """Count and newest date of the evidence of each risk."""
    return evidence.groupBy("risk").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))


def register(risks: DataFrame, tally: DataFrame) -> DataFrame:
    """Every risk of the register with its tally, 0 and empty where none."""
    both = risks.join(tally, "risk", "left")
    return both.select("risk", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last_date", F.lit("")).alias("last_date"))


def measured_maximum(measurements: DataFrame) -> DataFrame:
    """Per filing the highest measured temperature in °F, and whether any temperature is given at all."""
    hot = F.col("metric") == "temperature"
    value = F.bround(S.to_fahrenheit(F.col("value"), F.col("unit")), 0).cast("int")
    return measurements.groupBy("doc_id").agg(F.max(F.when(hot & (F.col("basis") == "measured"), value)).alias("measured_f"), F.bool_or(hot).alias("has_temperature"))


def urgency(filings: DataFrame, maxima: DataFrame, text: str | None = None, level: int = 145) -> DataFrame:
    """``urgent`` by severity, else by measured temperature, else (with no temperature given at all) by the text."""
    both = filings.join(maxima, "doc_id", "left")
    named = S.max_temperature_f(text) if text else F.lit(None).cast("int")
    by_text = F.coalesce(named >= level, F.lit(False))
    rule = F.when(F.col("severity") == "urgent", True).when(F.col("measured_f").isNotNull(), F.col("measured_f") >= level)
    return both.withColumn("urgent", rule.when(F.coalesce("has_temperature", F.lit(False)), False).otherwise(by_text))


def routed(judged: DataFrame) -> DataFrame:
    """Urgent filings go to the alert and its recap, others to the digest."""
    return judged.withColumn("route", F.when(F.col("urgent"), "alert").otherwise("digest"))


def weekly_digest(routes: DataFrame) -> DataFrame:
    """Digest and recap sections of each week (ending Sunday), counted; procedural filings come first."""
    week = F.date_format(F.date_add(F.date_trunc("week", F.to_date("date_filed")).cast("date"), 6), "yyyy-MM-dd")
    section = F.when(F.col("route") == "alert", "3 recap").when(F.col("doc_type") == "procedural", "1 procedural").otherwise("2 other")
    return routes.groupBy(week.alias("week"), section.alias("section")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("date_filed").alias("last_date"))


def digest_lines(routes: DataFrame) -> DataFrame:
    """The digest of each week (ending Sunday) as lines in order of ``part`` and ``place``: recap of what was sent, headline with the count, action items, others."""
    week = F.date_format(F.date_add(F.date_trunc("week", F.to_date("date_filed")).cast("date"), 6), "yyyy-MM-dd")
    part = F.when(F.col("route") == "alert", 0).when(F.col("doc_type") == "procedural", 2).otherwise(3)
    rows = routes.select(week.alias("week"), part.alias("part"), "doc_id", "date_filed", "doc_type", "severity")
    number, day = F.col("doc_id").cast("string"), F.col("date_filed")
    line = F.when(F.col("part") == 0, F.concat(F.lit("  - Sent "), day, F.lit("  "), number)).when(F.col("part") == 2, F.concat(F.lit("  - "), day, F.lit("  "), number))
    line = line.otherwise(F.concat(F.lit("  - "), day, F.lit("  ["), "doc_type", F.lit("/"), "severity", F.lit("]  "), number))
    items = placed(rows, ["week", "part"], [F.col("date_filed"), F.col("doc_id")]).select("week", "part", "place", line.alias("line"))
    title = F.when(F.col("part") == 0, "URGENT ITEMS FROM EARLIER THIS WEEK (already sent):").when(F.col("part") == 2, "ACTION ITEMS (deadlines / notices):").otherwise("OTHER NEW DOCUMENTS:")
    heads = rows.select("week", "part").distinct().select("week", "part", F.lit(0).cast("long").alias("place"), title.alias("line"))
    counts = rows.groupBy("week").agg(F.count_if(F.col("part") > 0).alias("n"))
    heads = heads.unionByName(counts.select("week", F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("Digest: "), "n", F.lit(" new document(s).")).alias("line")))
    return heads.unionByName(items)


def feed_pages(feed: DataFrame, day: str, ties: Sequence[Column], per_page: int = 50) -> DataFrame:
    """Newest-first rows with ``rn``, ``page``, ``file``, ``prev`` and ``next``.

    Days are counted, the counts added up newest first (a row a day in one task), and rows numbered
    within their day by ``ties``, so that no task sorts the whole feed.
    """
    days = feed.groupBy(F.col(day).alias("_day")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = days.select("_day", before.alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    rows = feed.join(starts, F.col(day).eqNullSafe(F.col("_day")))
    rn = F.col("_before") + F.row_number().over(W.partitionBy("_day").orderBy(*ties))
    rows = rows.withColumn("rn", rn).withColumn("page", F.ceil(F.col("rn") / per_page).cast("int"))
    last = F.greatest(F.ceil(F.col("_all") / per_page), F.lit(1)).cast("int")

    def name(p: Column) -> Column:
        return F.when(p == 1, "index.html").otherwise(F.concat(F.lit("page-"), p, F.lit(".html")))

    p = F.col("page")
    rows = rows.withColumns({"file": name(p), "prev": F.when(p > 1, name(p - 1)).otherwise(""), "next": F.when(p < last, name(p + 1)).otherwise("")})
    return rows.drop("_day", "_before", "_all")


def mirrored_links(feed: DataFrame, archive: DataFrame, link: str = "link") -> DataFrame:
    """Links swapped for their archive copy, found by the last path segment; others stay."""
    both = feed.withColumn("_key", S.last_segment(link)).join(archive.select(F.col("doc_id").cast("string").alias("_key"), "archive_link"), "_key", "left")
    return both.withColumn(link, F.coalesce("archive_link", link)).drop("_key")
