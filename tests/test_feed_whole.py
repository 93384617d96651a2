"""feed_pages leaves no part of its table out: against plain versions."""

from wardlight.plans import catalog
from wardlight.sources import views

SF = "/root/testdata/sf0.001"


def test_feed_has_all_filings(spark):
    got = catalog.QUERIES["feed_pages"](spark, SF).collect()
    filings = {(x.doc_id, x.date_filed) for x in views.filings(spark, SF).collect()}
    assert {(x.doc_id, x.date_filed) for x in got} == filings
    order = sorted(got, key=lambda x: x.rn)
    assert [x.rn for x in order] == list(range(1, len(filings) + 1)) and order[-1].page == -(-len(filings) // 50)
    assert {x.src for x in got} == {0, 1} and all(x.src == x.doc_id % 2 for x in got)
