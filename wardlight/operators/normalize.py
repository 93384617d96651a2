"""Canonical rows out of raw feed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions import scalars as S
from wardlight.operators import diff


def tagged(records: DataFrame, sites: DataFrame) -> DataFrame:
    """Records of all sites with the facility's id and name."""
    return records.join(sites.select("site", F.col("srn").alias("facility_srn"), F.col("name").alias("facility_name")), "site")


def documents(raw: DataFrame, base: str, download: str) -> DataFrame:
    """Filings with a name (description, source type or number), an absolute link and a date.

    The link comes as an anchor or as it is; without one it is made of the id.
    """
    anchor = F.regexp_extract(F.coalesce("url", F.lit("")), r'href="([^"]+)"', 1)
    link = F.when(anchor != "", anchor).otherwise(F.coalesce("url", F.lit("")))
    link = F.when(link == "", F.concat(F.lit(f"{download}/"), "doc_id")).otherwise(link)
    link = F.when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link)
    kind = S.first_filled("descr", "source_type")
    return raw.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        S.iso_date("created").alias("date_filed"),
        F.when(kind == "", F.concat(F.lit("doc-"), "doc_id")).otherwise(kind).alias("document_name"),
        kind.alias("type_name"),
        link.alias("doc_url"),
    )


def canonical_view(df: DataFrame, fields: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    """Text view of fixed fields that hashes alike: epoch milliseconds as dates, nulls empty, the rest trimmed; odd dates show as they are."""

    def view(name: str) -> Column:
        text = F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))
        if name not in dates:
            return text.alias(name)
        return F.coalesce(S.epoch_ms_date(text), text).alias(name)

    return df.select(*map(view, fields))


def feed_rows(filings: DataFrame, risks: DataFrame) -> DataFrame:
    """One feed row a filing: its risks joined by comma."""
    named = risks.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("risk")), ", ").alias("risks"))
    return filings.join(named, "doc_id", "left").select("date_filed", "doc_id", "doc_type", F.coalesce("risks", F.lit("")).alias("risks"), "severity", "facility")


def measurement_rows(filings: DataFrame, measurements: DataFrame) -> DataFrame:
    """Readings with their filing; a reading without a date has the filing's."""
    both = measurements.join(filings.select("doc_id", "date_filed", "facility"), "doc_id")
    return both.select(S.first_filled("as_of", "date_filed").alias("as_of"), "doc_id", "metric", "value", "unit", "basis", "date_filed", "facility")


def deadline_rows(deadlines: DataFrame, stream: str, extracted_at: str) -> DataFrame:
    """Deadlines with what they compel, blanks for absent dates; those without a description go."""
    texts = ["due", "extension_due", "actual_completion", "item_description", "compelled_by"]
    rows = deadlines.where(S.blank_to_null("item_description").isNotNull())
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in texts], F.lit(stream).alias("source_stream"), "facility", F.col("ref").cast("string").alias("ref"), F.lit(extracted_at).alias("extracted_at"))


def station_rows(latest: DataFrame, link: str) -> DataFrame:
    """Current state of each station as shown: values as text, blanks for missing ones."""
    return latest.select(
        "station",
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("as_of"),
        *[F.coalesce(S.compact_number(F.col(c)), F.lit("")).alias(c) for c in ("h2s", "ch4")],
        "h2s_status",
        "ch4_status",
        F.col("oid").cast("string").alias("oid"),
        F.lit(link).alias("link"),
    )


def monthly_measurements(verdicts: DataFrame, month: Column, well: str) -> DataFrame:
    """One reading for each month with a value: the largest daily mean, or ``<1`` as the report has it."""
    note = F.concat(F.lit("monthly max of "), "n_days", F.lit(" daily means"), F.when(F.col("all_below_1"), "; all days below 1").otherwise(""))
    return verdicts.where("value_token <> ''").select(F.concat(month, F.lit("-01")).alias("as_of"), F.lit(well).alias("well_id"), "report", F.col("value_token").alias("value"), F.lit("measured").alias("basis"), note.alias("note"))


def routed_texts(pages: DataFrame, header: str, large: int = 30, first: int = 25) -> DataFrame:
    """Documents with ``route``: more than ``large`` pages and the header in one of the first ``first``."""
    sums = pages.groupBy("doc").agg(F.count("*").alias("n_pages"), F.bool_or((F.col("page") < first) & F.col("text").rlike(header)).alias("has_header"))
    return sums.withColumn("route", (F.col("n_pages") > large) & F.coalesce("has_header", F.lit(False)))


def diff_case(sides: DataFrame) -> DataFrame:
    """Which comparison is legal for each site, first match wins: unreadable old state, changed settings, repeated keys, cut-off detail, else in full."""
    case = (
        F.when(F.col("old_n").isNull(), "baseline")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("old_config") != F.col("new_config"), "settings changed")
        .when(F.col("has_duplicates"), "counts only")
        .when(F.col("truncated"), "digests only")
        .when((F.col("old_n") == 0) & (F.col("new_n") > 0), "first records")
        .when((F.col("old_n") > 0) & (F.col("new_n") == 0), "all records gone")
    )
    return sides.withColumn("diff_case", case.otherwise("detail"))


def episode_marks(marked: DataFrame, recovered: DataFrame, alerted: DataFrame, key: str = "station") -> DataFrame:
    """Open episodes after a run: the marked without the recovered, and the newly alerted."""
    return marked.select(key).join(recovered.select(key), key, "left_anti").unionByName(alerted.select(key)).distinct()


def sites_state(old: DataFrame, new: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Counts of both sides of each site and whether the new side repeats a key."""
    a = old.groupBy(by).agg(F.count("*").alias("old_n"))
    b = diff.duplicate_keys(new, keys, [by]).select(by, F.col("n_rows").alias("new_n"), "has_duplicates")
    return a.join(b, by, "full_outer").withColumns({"new_n": F.coalesce("new_n", F.lit(0)), "has_duplicates": F.coalesce("has_duplicates", F.lit(False))})
