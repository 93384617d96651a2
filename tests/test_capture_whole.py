"""capture_downsample leaves no part of its table out: against plain versions."""

import datetime as dt

from pyspark.sql import functions as F

from wardlight.operators import readings as r
from wardlight.plans import catalog
from wardlight.sources import views

SF = "/root/testdata/sf0.001"


def test_capture_keeps_watch_rows_and_thins_over_midnight(spark):
    rows = r.classify(views.readings(spark, SF)).collect()
    want, last = set(), {}
    for x in sorted(rows, key=lambda x: x.oid):
        if not (x.station or "").startswith("MS-"):
            continue
        if {x.h2s_status, x.ch4_status} & {"exceedance", "watch"}:
            want.add((x.station, x.oid))
        elif x.ts is None or x.station not in last or x.ts - last[x.station] >= dt.timedelta(hours=8):
            want.add((x.station, x.oid))
            last[x.station] = last[x.station] if x.ts is None else x.ts
    got = catalog.QUERIES["capture_downsample"](spark, SF).collect()
    assert len(got) == len(want) and {(x.station, x.oid) for x in got} == want
    assert {(x.station, x.oid) for x in rows if x.ch4_status == "watch" and (x.station or "").startswith("MS-")} <= want


def test_thinning_goes_on_at_midnight(spark):
    t0 = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(k, "MS-1", t0 + dt.timedelta(hours=h)) for k, h in enumerate((20, 25, 28, 35, 36))], "oid long, station string, ts timestamp")
    assert sorted(x.oid for x in r.thinned(docs, F.lit(True)).collect()) == [0, 2, 4]
