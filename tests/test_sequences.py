from pyspark.sql import functions as F

from wardlight.operators import sequences as q


def lines(spark, texts, page=1):
    return spark.createDataFrame([(1, page, k, t) for k, t in enumerate(texts)], "doc int, page int, line_no int, text string")


GOOD = ["50.0", "40.0", "1.0", "9.0", "-3", "119", "7", "-1.4", "-20"]


def test_gas_records(spark):
    texts = ["AHW12*", " 1/2/2024 9:05", *GOOD, "Comment 12 34", "AHW13", "1/2/2024  9:05", "ADJ", "", *GOOD[:7], "x", "AHW14", "1/3/2024 8:00", *GOOD[:5], "note", "AHW15****", "1/4/2024 8:00", "50", "10", "1", "9", "100", "90", "AHW16", "not a date", *GOOD]
    got = {r.well_id: r for r in q.gas_readings(lines(spark, texts)).collect()}
    assert set(got) == {"AHW12", "AHW13", "AHW15"}
    assert (got["AHW12"].raw_well_id, got["AHW12"].valid, got["AHW12"].temp, got["AHW12"].header_pres) == ("AHW12*", True, 119.0, -20.0)
    assert got["AHW13"].adj and got["AHW13"].header_pres is None and got["AHW13"].flow == 7.0
    assert not got["AHW15"].valid and got["AHW15"].ch4 == 50.0


def test_rows_with_a_date_alone_and_strange_ids_are_no_records(spark):
    texts = ["AHW1", "1/2/2024", *GOOD, "W2", "1/2/2024 8:00", *GOOD, "AHW272R4**", "1/2/2024 8:00", *GOOD, "AHW3*****", "1/2/2024 8:00", *GOOD, "AHW4", "1/2/2024 8:00:10", *GOOD]
    assert [r.well_id for r in q.gas_readings(lines(spark, texts)).collect()] == ["AHW272R4"]


def test_summary_first_of_ties_and_no_adjustments(spark):
    shape = "doc int, line_no int, page int, well_id string, dt string, adj boolean, ch4 double, co2 double, o2 double, balance double, temp double, valid boolean"
    rows = [(1, 1, 1, "A", "d1", False, 1.0, 0.0, 2.0, 0.0, 130.0, True), (1, 2, 1, "A", "d2", False, 3.0, 0.0, 9.0, 0.0, 130.0, True), (1, 3, 1, "A", "d3", True, 1.0, 0.0, 20.0, 0.0, 190.0, True), (1, 4, 1, "A", "d4", False, 1.0, 0.0, 20.0, 0.0, 190.0, False), (1, 5, 1, "B", "d5", False, 1.0, 0.0, 2.0, 0.0, None, True)]
    got = {r.well_id: (r.max_temp, r.dt, r.o2_at_max, r.max_o2, r.n) for r in q.well_summary(spark.createDataFrame(rows, shape)).collect()}
    assert got == {"A": (130.0, "d1", 2.0, 9.0, 2), "B": (None, None, None, 2.0, 1)}
    rows = [(40, 9, 1, "A", "later", False, 1.0, 0.0, 1.0, 0.0, 139.0, True), (3, 9, 1, "A", "first", False, 1.0, 0.0, 2.0, 0.0, 139.0, True), (3, 12, 1, "A", "last", False, 1.0, 0.0, 3.0, 0.0, 139.0, True)]
    assert [r.dt for r in q.well_summary(spark.createDataFrame(rows, shape)).collect()] == ["first"]


def test_co_needs_a_ppm_line_and_plausible_values(spark):
    top = ["Attachment  2 - March", "2024 CO Data", "AHW9", "3/1/2024", "7", "ppm"]
    good = lines(spark, [*top, "AHW1**", "3/1/2024", "120", "AHW1", "3/9/2024", "500", "AHW2", "3/1/2024", "45658.00", "AHW3", "3/1/2024", "0", "AHW4", "3/1/2024 8:00", "5"])
    bare = lines(spark, ["Attachment 2 - April 2024 CO Data", "CO (ppm)", "AHW1", "4/1/2024", "7"], page=2).withColumn("line_no", F.col("line_no") + 100)
    untitled = lines(spark, ["ppm", "AHW1", "4/1/2024", "8"], page=3).withColumn("line_no", F.col("line_no") + 200)
    found = q.co_readings(good.union(bare).union(untitled))
    assert {(r.well_id, r.month): r.ppm for r in found.collect()} == {("AHW1", "2024-03"): 120.0, ("AHW3", "2024-03"): 0.0, ("AHW1", "page 3"): 8.0}
    rows = {(r.well_id, r.as_of, r.metric, r.value, r.unit, r.note) for r in q.co_measurements(found).collect()}
    assert ("AHW1", "2024-03-01", "carbon_monoxide", 120.0, "ppm", "CO, 2024-03") in rows and len(rows) == 3
    trend = q.co_trend(spark.createDataFrame([(1, "W", "2024-02", 5.0), (1, "W", "2024-01", 9.0)], "doc int, well_id string, month string, ppm double")).first()
    assert (trend.series, trend.first_ppm, trend.last_ppm, trend.rise) == ("2024-01=9 2024-02=5", 9.0, 5.0, -4.0)


def test_report_verdicts(spark):
    texts = {
        1: ["3/1/2024", "", "<1", "3/2/2024", "<1"],
        2: ["3/1/2024", "72", "3/2/2024", "3.5"],
        3: ["no table"],
        4: ["3/1/2024", "71.5"],
        5: ["3/1/2024", "", "", "", "9"],
        6: [" 3/1/24 ", "  < 1 ", "3/2/24", "n/a", "3/3/24", " 80 "],
        7: ["3/1/24", "3/2/24", "12345"],
    }
    rows = [(d, k, t) for d, ts in texts.items() for k, t in enumerate(ts)]
    reports = spark.createDataFrame([(d, d != 4) for d in texts], "report int, all_clear boolean")
    days = q.daily_values(spark.createDataFrame(rows, "report int, line_no int, text string"))
    got = {r.report: r for r in q.report_verdict(reports, days).collect()}
    assert [(got[k].severity, got[k].value_token, got[k].n_days) for k in range(1, 8)] == [("routine", "<1", 2), ("alert", "72", 2), ("alert", "", 0), ("alert", "71.5", 1), ("alert", "", 1), ("alert", "80", 3), ("alert", "", 2)]
    assert got[1].all_below_1 and got[2].exceed_24h and got[3].parse_anomaly and got[5].parse_anomaly and got[6].exceed_24h and got[7].parse_anomaly and not got[4].exceed_24h
    assert {(r.day, r.value) for r in days.where("report = 6").collect()} == {("3/1/24", "<1"), ("3/2/24", None), ("3/3/24", "80")}
    who = {r.report: (r.audience, r.alert_cell) for r in q.audience(q.report_verdict(reports, days), F.col("report") == 4).collect()}
    assert who[2] == ("all", "EXCEEDANCE") and who[3] == ("review", "review") and who[4] == ("suppressed", "review") and who[1] == ("none", "ok")


def test_verdict_from_a_whole_text(spark):
    clear = "There were no notifications\n required to be sent this month."
    notes = "\n  1 Notifications are sent at 72 ppb or 750 ppb; else no notifications required to be sent\n5/9/26\n80\n"
    table = "May 1 - 31, 2026: 9,999 and 750\n5/1/26\n<1\r\n5/2/2026 \n \n\n 12.5\n5/3/26\n\n\n\n14\n5/4/26\nn/a\n5/5/26\n< 1\n"
    texts = {
        "clear": table + clear,
        "silent": table,
        "in notes only": table + notes.replace("80", "7"),
        "over": table.replace("12.5", "72") + clear,
        "over in notes": table + clear + notes,
        "below": "5/1/26\n<1\n5/2/26\n< 1\nNO NOTIFICATION REQUIRED TO BE SENT",
        "scan": "a picture",
        "empty": "",
        "null": None,
    }
    rows = [(k, v) for k, v in texts.items()] + [("clear", texts["clear"])]
    got = {r.report: r for r in q.report_text_verdict(spark.createDataFrame(rows, "report string, text string")).collect()}
    shown = {k: (r.n_days, r.max_numeric, r.value_token, r.all_clear, r.severity, [x.code for x in r.reasons]) for k, r in got.items()}
    assert shown == {
        "clear": (5, 12.5, "12.5", True, "routine", []),
        "silent": (5, 12.5, "12.5", False, "alert", ["no all-clear"]),
        "in notes only": (6, 12.5, "12.5", False, "alert", ["no all-clear"]),
        "over": (5, 72.0, "72", True, "alert", ["exceedance"]),
        "over in notes": (6, 80.0, "80", True, "alert", ["exceedance"]),
        "below": (2, None, "<1", True, "routine", []),
        "scan": (0, None, "", False, "alert", ["no values"]),
        "empty": (0, None, "", False, "alert", ["no values"]),
        "null": (0, None, "", False, "alert", ["no values"]),
    }
    assert got["below"].all_below_1 and got["over"].reasons[0].text == "a day's mean of 72 ppb reaches the level of 72 ppb"
    assert q.report_text_verdict(spark.createDataFrame([], "report string, text string")).count() == 0
