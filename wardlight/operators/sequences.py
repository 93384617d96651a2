"""Records found in sequences of text lines, and what is summed up from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.functions import scalars as S
from wardlight.functions.arrays import bound

# Columns of the gas table in order, and forms of its lines and of the monthly report's.
NUMBERS = ("ch4", "co2", "o2", "balance", "diff_press", "temp", "flow", "well_pres", "header_pres")
WELL = r"^AH[A-Z0-9]+\*{0,4}$"
STAMP = r"^\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}$"
DAY = r"^\d{1,2}/\d{1,2}/\d{4}$"
NUMBER = r"^-?\d+(?:\.\d+)?$"
CO_TITLE = r"Attachment\s*2\s*-\s*([A-Za-z]+)\s+(\d{4})\s*CO Data"
REPORT_DAY = r"^\s*(\d{1,2}/\d{1,2}/\d{2,4})\s*$"
REPORT_VALUE = r"^\s*(<\s*1|\d{1,4}(?:\.\d+)?)\s*$"
FOOTNOTES = r"(?md)^\s*1\s+Notifications\b"
ALL_CLEAR = r"(?i)no\s+notifications?\s+required\s+to\s+be\s+sent"
#: Ends of lines in texts of any origin.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def well_id(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """A well's id without trailing stars, by its canonical name if it has one."""
    bare = F.regexp_replace(F.trim(raw), r"\*+$", "")
    if not aliases:
        return bare
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(known, bare), bare)


def filled(lines: DataFrame) -> DataFrame:
    """Lines without the space around them; blank ones are none."""
    return lines.withColumn("text", F.trim("text")).where("text <> ''")


def gas_readings(lines: DataFrame, most: int = 9, least: int = 6) -> DataFrame:
    """Well line, date-time line, perhaps ``ADJ``, then up to nine number lines (at least six): one record each.

    ``lines`` has doc, page, line_no and text; a record is looked for at every line by the twelve after it. Rows with a date
    alone are no records.
    """
    w = W.partitionBy("doc").orderBy("line_no")
    ahead = [F.lead("text", k).over(w).alias(f"_{k}") for k in range(1, most + 3)]
    rows = filled(lines).select("doc", "line_no", "page", "text", *ahead).where(F.col("text").rlike(WELL) & F.col("_1").rlike(STAMP))
    adjusted = F.coalesce(F.col("_2") == "ADJ", F.lit(False))
    after = [F.when(adjusted, F.col(f"_{k + 3}")).otherwise(F.col(f"_{k + 2}")) for k in range(most)]
    run, values = F.lit(True), []
    for x in after:
        run = run & F.coalesce(x.rlike(NUMBER), F.lit(False))
        values.append(F.when(run, x.cast("double")))
    rows = rows.select("doc", "line_no", "page", F.col("text").alias("raw_well_id"), well_id(F.col("text")).alias("well_id"), F.col("_1").alias("dt"), adjusted.alias("adj"), *[v.alias(n) for v, n in zip(values, NUMBERS, strict=True)])
    enough = F.col(NUMBERS[least - 1]).isNotNull()
    total = F.abs(F.col("ch4") + F.col("co2") + F.col("o2") + F.col("balance") - 100)
    return rows.where(enough).withColumn("valid", F.coalesce(F.round(total, 6) <= 1.5, F.lit(False)))


def well_measurements(readings: DataFrame) -> DataFrame:
    """Temperature, oxygen and methane of each reading that isn't an adjustment."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(u).alias("unit")) for m, c, u in (("temperature", "temp", "F"), ("oxygen", "o2", "percent"), ("methane", "ch4", "percent"))])
    rows = readings.where(~F.col("adj")).select("doc", "well_id", S.us_date_to_iso(F.regexp_extract("dt", r"^(\S+)", 1)).alias("as_of"), F.explode(pairs).alias("m"))
    return rows.select("doc", "well_id", "as_of", "m.*").where("value is not null")


def well_summary(readings: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Per well over valid readings: hottest one with its date and gases (the first of ties by document and line), largest oxygen, count."""
    good = readings.where(F.col("valid") & ~F.col("adj"))
    hottest = F.min(F.when(F.col("temp").isNotNull(), F.struct((-F.col("temp")).alias("_neg"), "doc", "line_no", "temp", "dt", "o2", "ch4")))
    rows = good.groupBy("well_id").agg(hottest.alias("h"), F.max("o2").alias("max_o2"), F.count("*").alias("n"))
    rows = rows.select("well_id", F.col("h.temp").alias("max_temp"), F.col("h.dt").alias("dt"), F.col("h.o2").alias("o2_at_max"), F.col("h.ch4").alias("ch4_at_max"), "max_o2", "n")
    if listed is None:
        return rows
    return rows.join(listed.select("well_id").distinct().withColumn("_l", F.lit(True)), "well_id", "left").withColumn("is_listed", F.coalesce("_l", F.lit(False))).drop("_l")


def headline_counts(readings: DataFrame, summary: DataFrame, levels: Sequence[float] = (131.0, 145.0)) -> DataFrame:
    """Readings, valid share, wells, and wells at each level."""
    a = readings.agg(F.count("*").alias("n_readings"), F.round(100 * F.count_if("valid") / F.count("*"), 1).alias("pct_valid"))
    b = summary.agg(F.count("*").alias("n_wells"), *[F.count_if(F.col("max_temp") >= v).alias(f"wells_{int(v)}") for v in levels])
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def co_readings(lines: DataFrame, most: float = 10_000.0) -> DataFrame:
    """Well, day and ppm line triples after a page's ``ppm`` line, the month from the page's title; the first of each (well, month) of a document in page order.

    A page without a line ``ppm`` has none; one whose title tells no month has ``page N`` for it. Titles may run over several
    lines. No triple crosses a page, so pages are read each for itself.
    """
    page = W.partitionBy("doc", "page")
    w = page.orderBy("line_no")
    text = F.col("text")
    near = F.concat_ws(" ", text, *[F.lead("text", k).over(w) for k in (1, 2, 3, 4)])
    title = F.regexp_extract(near, CO_TITLE, 0)
    rows = filled(lines).select(
        "doc",
        "page",
        "line_no",
        "text",
        F.lead("text", 1).over(w).alias("_1"),
        F.lead("text", 2).over(w).alias("_2"),
        F.min(F.when(text == "ppm", F.col("line_no"))).over(page).alias("_ppm"),
        F.min(F.when(title != "", F.struct("line_no", title.alias("title")))).over(page).alias("_title"),
    )
    found = rows.where(text.rlike(WELL) & F.col("_1").rlike(DAY) & F.col("_2").rlike(NUMBER) & (F.col("line_no") > F.col("_ppm")))
    named = F.concat(F.lit("1 "), F.regexp_extract("_title.title", CO_TITLE, 1), F.lit(" "), F.regexp_extract("_title.title", CO_TITLE, 2))
    month = F.coalesce(F.date_format(F.try_to_date(named, "d MMMM yyyy"), "yyyy-MM"), F.concat(F.lit("page "), "page"))
    found = found.select("doc", "page", "line_no", well_id(text).alias("well_id"), F.col("_1").alias("date"), month.alias("month"), F.col("_2").cast("double").alias("ppm"))
    first = F.row_number().over(W.partitionBy("doc", "well_id", "month").orderBy("line_no"))
    return found.where(F.col("ppm") < most).withColumn("_n", first).where("_n = 1").drop("_n")


def co_measurements(readings: DataFrame) -> DataFrame:
    """Measurement rows of CO readings."""
    return readings.select(
        "doc", "well_id", S.us_date_to_iso(F.col("date")).alias("as_of"), F.lit("carbon_monoxide").alias("metric"), F.col("ppm").alias("value"), F.lit("ppm").alias("unit"), F.concat(F.lit("CO, "), "month").alias("note")
    )


def co_trend(readings: DataFrame) -> DataFrame:
    """Per well of a report the months in order with first, last and largest ppm, rise and count."""
    series = F.sort_array(F.collect_list(F.struct("month", "ppm")))
    rows = readings.groupBy("doc", "well_id").agg(series.alias("s"), F.max("ppm").alias("max_ppm"), F.count("*").alias("n"))
    first, last = F.element_at("s", 1)["ppm"], F.element_at("s", -1)["ppm"]
    text = F.array_join(F.transform("s", lambda x: F.concat(x["month"], F.lit("="), x["ppm"].cast("long"))), " ")
    return rows.select("doc", "well_id", text.alias("series"), "max_ppm", first.alias("first_ppm"), last.alias("last_ppm"), F.round(last - first, 6).alias("rise"), "n")


def co_pivot(readings: DataFrame, months: Sequence[str]) -> DataFrame:
    return readings.groupBy("doc", "well_id").pivot("month", list(months)).agg(F.max("ppm"))


def daily_values(lines: DataFrame, ahead: int = 3) -> DataFrame:
    """Lines of a date alone, each with the next line that isn't blank if that is a value at most ``ahead`` lines on, else null; footnotes are cut beforehand.

    Years of two digits, space around and ``< 1`` (given as ``<1``) are taken.
    """
    w = W.partitionBy("report").orderBy("line_no")
    rows = lines.where(F.trim("text") != "").select("report", "line_no", "text", F.lead("text").over(w).alias("_v"), F.lead("line_no").over(w).alias("_at"))
    rows = rows.where(F.col("text").rlike(REPORT_DAY))
    near = (F.col("_at") - F.col("line_no") <= ahead) & F.col("_v").rlike(REPORT_VALUE)
    return rows.select("report", F.regexp_extract("text", REPORT_DAY, 1).alias("day"), F.when(near, F.regexp_replace(F.trim("_v"), r"\s", "")).alias("value"))


def report_verdict(reports: DataFrame, days: DataFrame, level: float = 72.0) -> DataFrame:
    """Fail-safe verdict of each report: only a parsed table under the level with the all-clear phrase is routine."""
    number = F.when(~F.col("value").startswith("<"), F.col("value").cast("double"))
    sums = days.groupBy("report").agg(F.count("*").alias("n_days"), F.count("value").alias("_tokens"), F.max(number).alias("max_numeric"), F.count_if(F.col("value").startswith("<")).alias("_below"))
    rows = reports.join(sums, "report", "left").fillna(0, ["n_days", "_tokens", "_below"])
    exceed = F.coalesce(F.col("max_numeric") >= level, F.lit(False))
    anomaly = F.col("_tokens") == 0
    token = F.when(F.col("max_numeric").isNotNull(), S.compact_number(F.col("max_numeric"))).when(F.col("_below") > 0, "<1").otherwise("")
    alert = exceed | anomaly | ~F.col("all_clear")
    rows = rows.select(
        "report", "n_days", "max_numeric", token.alias("value_token"), (F.col("max_numeric").isNull() & (F.col("_below") > 0)).alias("all_below_1"), "all_clear", exceed.alias("exceed_24h"), anomaly.alias("parse_anomaly"), alert.alias("alert")
    )
    return rows.withColumn("severity", F.when(F.col("alert"), "alert").otherwise("routine"))


def stated_days(text: Column, ahead: int = 3) -> Column:
    """Days of a whole report's text in order, each a struct of ``day`` and ``value`` as ``daily_values`` has them; lines are looked at within their row, so nothing is shuffled."""
    edges = r"^\s+|\s+$"

    def of(lines: Column) -> Column:
        def day(line: Column, at: Column) -> Column:
            later = F.filter(F.transform(F.slice(lines, at + 2, F.lit(ahead)), lambda x: F.regexp_replace(x, edges, "")), lambda x: x != "")
            value = F.regexp_extract(F.get(later, F.lit(0)), REPORT_VALUE, 1)
            return F.when(line.rlike(REPORT_DAY), F.struct(F.regexp_extract(line, REPORT_DAY, 1).alias("day"), F.when(value != "", F.regexp_replace(value, r"\s", "")).alias("value")))

        return F.filter(F.transform(lines, day), lambda x: x.isNotNull())

    return bound(F.split(F.coalesce(text, F.lit("")), LINE_END), of)


def states_all_clear(text: Column) -> Column:
    """Whether the phrase stands in a report before its footnotes, which name the levels and might hold it; line ends in it don't matter."""
    body = F.get(F.split(F.coalesce(text, F.lit("")), FOOTNOTES, 2), F.lit(0))
    return body.rlike(ALL_CLEAR)


def report_text_verdict(reports: DataFrame, level: float = 72.0) -> DataFrame:
    """``report_verdict`` from ``report`` and its whole ``text``, with ``reasons``: structs of a code and a sentence, in order.

    A report without a usable value is an anomaly, and then its missing phrase is no further reason. Null and empty texts are
    anomalies; repeated rows each get a row; an empty table gives no rows.
    """
    rows = reports.select("report", stated_days(F.col("text")).alias("days"), states_all_clear(F.col("text")).alias("all_clear"))
    values = F.filter(F.transform("days", lambda d: d["value"]), lambda v: v.isNotNull())
    rows = rows.withColumn("n_days", F.size("days")).withColumn("values", values)
    number = F.array_max(F.transform(F.filter("values", lambda v: ~v.startswith("<")), lambda v: v.cast("double")))
    rows = rows.withColumn("max_numeric", number)
    token = F.when(F.col("max_numeric").isNotNull(), S.compact_number(F.col("max_numeric"))).when(F.size("values") > 0, "<1").otherwise("")
    rows = rows.withColumns({"value_token": token, "all_below_1": F.col("max_numeric").isNull() & (F.size("values") > 0), "exceed_24h": F.coalesce(F.col("max_numeric") >= level, F.lit(False)), "parse_anomaly": F.size("values") == 0})
    unit = f"{level:g} ppb"
    said = {
        "exceedance": (F.col("exceed_24h"), F.concat(F.lit("a day's mean of "), "value_token", F.lit(f" ppb reaches the level of {unit}"))),
        "no values": (F.col("parse_anomaly"), F.lit("no day's mean was found in the text: look at the report itself")),
        "no all-clear": (~F.col("parse_anomaly") & ~F.col("all_clear"), F.lit("the report doesn't say that no notifications were required")),
    }
    reasons = F.array(*[F.when(holds, F.struct(F.lit(code).alias("code"), text.alias("text"))) for code, (holds, text) in said.items()])
    rows = rows.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    alert = F.size("reasons") > 0
    return rows.select(
        "report", "n_days", "max_numeric", "value_token", "all_below_1", "all_clear", "exceed_24h", "parse_anomaly", alert.alias("alert"), F.when(alert, "alert").otherwise("routine").alias("severity"), "reasons"
    )


def audience(verdicts: DataFrame, backlog: Column) -> DataFrame:
    """Who hears of a report: everybody of an exceedance, the review list of other alerts, nobody of a backlog."""
    who = F.when(backlog, "suppressed").when(F.col("exceed_24h"), "all").when(F.col("alert"), "review").otherwise("none")
    cell = F.when(F.col("exceed_24h"), "EXCEEDANCE").when(F.col("alert"), "review").otherwise("ok")
    return verdicts.withColumns({"audience": who, "alert_cell": cell})


def banded(readings: DataFrame, least: float) -> DataFrame:
    """Rows at ``least`` degrees or more, and each document's hottest whatever it is."""
    peak = readings.groupBy("doc").agg(F.max(F.when(F.col("temp").isNotNull(), F.struct("temp", (-F.col("line_no")).alias("_n")))).alias("_p"))
    rows = readings.join(peak, "doc")
    return rows.where((F.col("temp") >= least) | (-F.col("line_no") == F.col("_p._n"))).drop("_p")
