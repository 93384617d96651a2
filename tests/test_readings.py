import datetime as dt
import random

from pyspark.sql import functions as F

from wardlight.operators import readings as r

T0 = dt.datetime(2024, 1, 1)
SHAPE = "oid long, station string, ts timestamp, h2s double, ch4 double, h2s_text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_classes(spark):
    rows = [(1, "MS-1", T0, 72.0, 1.0, None), (2, "MS-1", T0, 71.9, 40.0, None), (3, "MS-1", T0, 999.0, 0.0, None), (4, "MS-1", T0, None, 99999.0, None), (5, "MS-1", T0, 0.0, 500.0, "BDL"), (6, "MS-1", T0, 999.0, 501.0, None), (7, "MS-1", T0, None, None, None)]
    got = {x.oid: (x.h2s_status, x.ch4_status, x.severity, x.n_reasons) for x in r.classify(frame(spark, rows)).collect()}
    assert got == {
        1: ("exceedance", "ok", "urgent", 1),
        2: ("ok", "watch", "watch", 1),
        3: ("sentinel", "ok", "anomaly", 1),
        4: ("missing", "sentinel", "anomaly", 1),
        5: ("ok", "exceedance", "urgent", 1),
        6: ("sentinel", "exceedance", "urgent", 2),
        7: ("missing", "missing", "ok", 0),
    }
    reasons = {x.oid: [(q.column, q.status, q.value, q.level, q.action) for q in x.reasons] for x in r.classify(frame(spark, rows)).collect()}
    assert reasons[1] == [("h2s", "exceedance", 72.0, 72.0, 72.0)] and reasons[2] == [("ch4", "watch", 40.0, 40.0, 500.0)] and reasons[7] == []
    assert [q[:2] for q in reasons[6]] == [("h2s", "sentinel"), ("ch4", "exceedance")]
    when = "MS-1 2024-01-01 00:00: "
    anomalies = {3: f"anomaly {when}H2S=999 is a sentinel", 4: f"anomaly {when}CH4=99999 is a sentinel"}
    watch = {2: f"watch {when}CH4=40 reaches the watch level 40, below the action level 500"}
    urgent = {5: f"EXCEEDANCE {when}CH4=500 reaches the action level 500"}

    def lines(**switches):
        return {x.oid: x.line for x in r.alert_lines(frame(spark, rows), **switches).collect()}

    assert lines() == anomalies | watch | urgent | {6: f"EXCEEDANCE {when}H2S=999 is a sentinel; CH4=501 reaches the action level 500"}
    alone = {6: f"EXCEEDANCE {when}CH4=501 reaches the action level 500"}
    assert lines(on_sentinel=False) == watch | urgent | alone
    assert lines(on_sentinel=False, with_watch=False, averaged=()) == urgent | alone | {1: f"EXCEEDANCE {when}H2S=72 reaches the action level 72"}


def test_long_form_drops_sentinels_and_other_stations(spark):
    rows = [(1, "MS-1", T0, 0.5, 99999.0, "BDL"), (2, "MET-1", T0, 5.0, 5.0, None), (3, "MS-2", T0, None, 3.0, None)]
    got = {(x.oid, x.metric, x.note) for x in r.long_form(frame(spark, rows)).collect()}
    assert got == {(1, "hydrogen_sulfide", "fenceline; BDL"), (3, "methane", "fenceline")}


def test_peaks_first_wins_and_stamps_last_wins(spark):
    rows = [(1, "MS-1", at(1), 5.0, None, None), (2, "MS-1", at(2), 9.0, None, None), (3, "MS-1", at(3), 9.0, None, None), (4, "MS-1", at(3), 7.0, None, None)]
    long = r.long_form(frame(spark, rows))
    assert [x.oid for x in r.daily_peaks(long).collect()] == [2]
    assert {x.as_of[-5:]: x.oid for x in r.last_writer(long).collect()} == {"01:00": 1, "02:00": 2, "03:00": 4}


def test_window_excludes_its_lower_end_and_sentinels(spark):
    rows = [(1, "MS-1", at(0), 100.0, None, None), (2, "MS-1", at(1), 10.0, None, None), (3, "MS-1", at(5), 999.0, None, None), (4, "MS-1", at(30), 20.0, None, None)]
    got = r.trailing_average(frame(spark, rows), "2024-01-02").collect()
    assert [(x.avg, x.n) for x in got] == [(15.0, 2)]
    assert [x.outcome for x in r.average_alerts(r.trailing_average(frame(spark, rows), "2024-01-02"), 15.0, 3).collect()] == ["suppressed"]


def test_thinning(spark):
    rows = [(k, "MS-1", at(h), v, None, None) for k, (h, v) in enumerate([(0, 1.0), (4, 1.0), (7, 80.0), (7.9, 1.0), (8, 1.0), (15, 1.0), (16, 1.0)])] + [(9, "MS-1", None, 1.0, None, None)]
    got = r.thinned(frame(spark, rows), F.col("h2s") < 72).collect()
    assert sorted(x.oid for x in got) == [0, 2, 4, 6, 9]


def walked(rows, hours=8):
    """Ids that one walk keeps, row by row in the order of ids."""
    kept, last = [], {}
    for oid, station, ts, calm in sorted(rows, key=lambda x: x[0]):
        if not calm or ts is None:
            kept.append(oid)
        elif station not in last or (ts - last[station]).total_seconds() >= hours * 3600:
            kept.append(oid)
            last[station] = ts
    return sorted(kept)


def test_thinning_of_late_rows_in_parts_equals_a_walk(spark):
    rng = random.Random(6)
    for seed in range(3):
        rows, clock = [], 0.0
        for oid in range(1500):
            clock += rng.choice((0, 0.2, 1, 3, 9)) if seed else rng.random() * 2 - 0.5
            late = rng.choice((0, 0, 0, 5, 40)) if seed < 2 else 0
            rows.append((oid, rng.choice(["MS-1"] * 6 + ["MS-2", None]), None if rng.random() < 0.02 else T0 + dt.timedelta(hours=round(clock - late, 3)), rng.random() < 0.8))
        df = spark.createDataFrame(rows, "oid long, station string, ts timestamp, calm boolean").repartition(5)
        for size in (40, 10_000):
            assert sorted(x.oid for x in r.thinned(df, F.col("calm"), per_part=size).collect()) == walked(rows)
    assert r.thinned(df.limit(0), F.col("calm")).count() == 0


def test_episodes_need_a_recovery(spark):
    values = [80.0, 90.0, None, 999.0, 75.0, 10.0, 10.0, 72.0]
    rows = [(k, "MS-1", at(k), v, None, None) for k, v in enumerate(values)]
    usable = frame(spark, rows).where("h2s is not null and h2s <> 999")
    got = sorted((x.opened_oid, x.recovered_oid) for x in r.episodes(usable, F.col("h2s") >= 72, F.col("h2s") < 72).collect())
    assert got[0] == (0, 5) and got[1][0] == 7 and got[1][1] is None


def test_cursor_is_numeric_and_alert_once(spark):
    assert r.cursor(spark.createDataFrame([("9",), ("100",), ("x",)], "oid string")).first().cursor == 100
    stale = r.silent(frame(spark, [(1, "MS-1", at(0), 1.0, 1.0, None), (2, "MS-2", at(0), 1.0, 1.0, None)]), "2024-01-05", 3)
    marks = spark.createDataFrame([("MS-1", at(0)), ("MS-2", at(-9))], "station string, as_of timestamp")
    assert [x.station for x in r.to_alert_once(stale, marks).collect()] == ["MS-2"]


def test_levels(spark):
    bad = r.levels_are_sane(spark.createDataFrame([("h2s", 40.0, 72.0), ("ch4", 500.0, 500.0)], "name string, watch double, action double"))
    assert [x.name for x in bad.collect()] == ["ch4"]
