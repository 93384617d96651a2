"""upcoming_window leaves no part of its table out: against plain versions."""

import datetime as dt

from wardlight.plans import catalog
from wardlight.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_upcoming_of_every_day(spark):
    got = {(x.on_day, x.event) for x in catalog.QUERIES["upcoming_window"](spark, SF).collect()}
    orders = [(x.o_orderkey, x.o_orderdate, x.o_custkey) for x in table(spark, SF, "orders").collect()]
    day = {k: d.date() if isinstance(d, dt.datetime) else d if isinstance(d, dt.date) else dt.date.fromisoformat(d[:10]) for k, d, _ in orders}
    titles = {x.o_orderkey for x in table(spark, SF, "orders").collect() if x.o_orderkey % 9 and (x.o_orderpriority or "").strip()}
    events = [(k, day[k], max(day[k], day[k] + dt.timedelta(days=c % 7 - 2))) for k, _, c in orders if k in titles]
    assert got == {(on, k) for on in set(day.values()) for k, first, end in events if end >= on and first <= on + dt.timedelta(days=14)}
