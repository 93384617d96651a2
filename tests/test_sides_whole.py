"""liveness and diff_case_order leaves no part of its table out: against plain versions."""

from wardlight.plans import catalog
from wardlight.sources import views
from wardlight.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_liveness_takes_every_reading(spark):
    got = {x.station: x.as_of for x in catalog.QUERIES["liveness"](spark, SF).collect()}
    want = {}
    for x in views.readings(spark, SF).where("ts is not null").collect():
        want[x.station] = max(want.get(x.station, x.ts), x.ts)
    assert got == want


def test_diff_cases_count_nearly_all_lines(spark):
    got = {x.site: x.new_n for x in catalog.QUERIES["diff_case_order"](spark, SF).collect()}
    want = {}
    for x in table(spark, SF, "lineitem").select("l_suppkey", "l_orderkey").collect():
        if x.l_suppkey % 30 != 6 and x.l_orderkey % 10 != 1:
            want[x.l_suppkey % 30] = want.get(x.l_suppkey % 30, 0) + 1
    assert {s: n for s, n in got.items() if n} == want
