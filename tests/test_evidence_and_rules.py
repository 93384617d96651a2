import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.operators import diff, rules
from wardlight.operators import evidence as ev
from wardlight.operators import normalize as n


def test_urgency_order(spark):
    filings = spark.createDataFrame(
        [(1, "urgent", ""), (2, "routine", "180 F"), (3, "routine", "180 F"), (4, "routine", "180 F"), (5, "routine", "120 F"), (6, "routine", None), (7, "routine", "")], "doc_id int, severity string, text string"
    )
    measures = spark.createDataFrame(
        [(2, "temperature", "measured", 100.0, "F"), (3, "temperature", "permitted_limit", 180.0, "F"), (7, "temperature", "measured", 63.0, "C"), (7, "temperature", "permitted_limit", 500.0, "F"), (4, "oxygen", "measured", 400.0, "F")],
        "doc_id int, metric string, basis string, value double, unit string",
    )
    got = {r.doc_id: (r.urgent, r.measured_f) for r in ev.urgency(filings, ev.measured_maximum(measures), "text").collect()}
    assert got == {1: (True, None), 2: (False, 100), 3: (False, None), 4: (True, None), 5: (False, None), 6: (False, None), 7: (True, 145)}


def test_fan_out_and_register(spark):
    filings = spark.createDataFrame([(1, "evidence"), (2, "procedural")], "doc_id int, doc_type string")
    named = spark.createDataFrame([(1, "R1"), (1, "R8"), (1, "R9"), (2, "R1")], "doc_id int, risk string")
    assert sorted((r.risk, r.risk_name) for r in ev.fanned_out(filings, named).collect()) == [("R1", "Risk 1"), ("R8", "R8")]
    assert spark.range(1).select(ev.valid_risks(F.lit(["R9", "R2", "R2", "x"]))).first()[0] == ["R2", "R2"]
    first = spark.createDataFrame([("R1", "d", "F", "key", "")], "risk string, date string, facility string, key_point string, summary string")
    second = spark.createDataFrame([("R2", "d", "F", None, "sum"), ("R2", "e", "F", "a", "b")], "risk string, date string, facility string, label string, detail string")
    rows = ev.common_evidence(first, second)
    assert sorted(r.detail for r in rows.collect()) == ["a — b", "key", "sum"]
    reg = spark.createDataFrame([("R1", "one"), ("R2", "two"), ("R3", "three")], "risk string, name string")
    assert sorted((r.risk, r.n, r.last_date) for r in ev.register(reg, ev.risk_tally(rows)).collect()) == [("R1", 1, "d"), ("R2", 2, "e"), ("R3", 0, "")]


@pytest.mark.parametrize("parts", [1, 7])
def test_feed_order_and_neighbours(spark, parts):
    rng = random.Random(1)
    rows = [(k, f"2024-01-{rng.randint(1, 9):02d}", rng.randint(0, 1)) for k in range(23)]
    feed = spark.createDataFrame(rows, "doc_id int, day string, src int").repartition(parts)
    got = sorted(ev.feed_pages(feed, "day", [F.col("src"), F.col("doc_id")], 10).collect(), key=lambda r: r.rn)
    want = sorted(rows, key=lambda r: (r[2], r[0]))
    want = sorted(want, key=lambda r: r[1], reverse=True)
    assert [r.doc_id for r in got] == [r[0] for r in want]
    assert [(r.page, r.file, r.prev, r.next) for r in (got[0], got[10], got[22])] == [(1, "index.html", "", "page-2.html"), (2, "page-2.html", "index.html", "page-3.html"), (3, "page-3.html", "page-2.html", "")]
    assert ev.feed_pages(feed.limit(0), "day", [F.col("src")]).count() == 0


def severities(spark, spec, rows, shape, changed=False):
    df = spark.createDataFrame(rows, shape)
    return [(r.severity, r.doc_type) for r in rules.events(df, spec, F.lit(changed), F.lit("new")).orderBy("identity").collect()]


def test_rules(spark):
    annual = "site int, year string, years_start string, years_end string"
    rows = [(1, "a", "9", "0.0"), (2, "b", "2.5", ""), (3, "c", "9", "n/a"), (4, "d", None, None), (5, "e", "1", "3.0")]
    assert [s for s, _ in severities(spark, rules.annual_report(), rows, annual)] == ["notable", "notable", "watch", "watch", "watch"]
    action = "site int, action int, type string, response string, received string"
    kinds = ["Violation Notice", "PENALTY DEMAND - PAID", "Consent Judgment", "Letter", None]
    rows = [(1, k, t, "", "1/2/2024") for k, t in enumerate(kinds)]
    assert [s for s, _ in severities(spark, rules.compliance_action(), rows, action)] == ["urgent", "watch", "urgent", "notable", "notable"]
    assert [s for s, _ in severities(spark, rules.compliance_action(), rows, action, True)] == ["notable", "watch", "notable", "notable", "notable"]
    report = "site int, period string, exceedence string, received string"
    assert severities(spark, rules.quarterly_report(), [(1, "a", " YES ", ""), (1, "b", "", "")], report) == [("notable", "evidence"), ("watch", "evidence")]
    app = "site int, application int, type string, status string, received string"
    assert severities(spark, rules.application(), [(1, 1, "Construction Permit (new)", "", ""), (1, 2, "Operating License", "", "")], app) == [("urgent", "evidence"), ("notable", "procedural")]


def test_blank_identities_go_and_only_changes_are_told(spark):
    spec = rules.evaluation()
    df = spark.createDataFrame([(1, 1, "CEI", "1/2/2024"), (1, 2, "CEI", "1/2/2024"), (1, 3, "FUI", "1/2/2024"), (None, None, "x", "")], "site int, evaluation int, kind string, received string")
    all_ = rules.events(df, spec, F.lit(False), F.lit("historical"))
    assert all_.count() == 3 and {r.date for r in all_.collect()} == {"2024-01-02"}
    seen = all_.where("identity <> '1|3'").withColumn("hash", F.when(F.col("identity") == "1|2", "other").otherwise(F.col("hash")))
    assert {r.identity: r.kind for r in rules.against_seen(df, spec, seen).collect()} == {"1|2": "changed", "1|3": "new"}
    loaded = spark.createDataFrame([("evaluations",)], "collection string")
    assert rules.historical([(df, spec)], loaded).count() == 0


def test_canonical_views(spark):
    raw = spark.createDataFrame([(1, " a ", "1704067200000"), (2, None, "soon"), (3, "b", None)], "id int, name string, closed string")
    assert [tuple(r) for r in n.canonical_view(raw, ["id", "name", "closed"], ["closed"]).orderBy("id").collect()] == [("1", "a", "2024-01-01"), ("2", "", "soon"), ("3", "b", "")]
    docs = spark.createDataFrame([(7, None, " ", "2024-02-30", '<a href="/x">D</a>'), (8, "n", "t", "02/03/2024", None)], "doc_id int, descr string, source_type string, created string, url string")
    got = [tuple(r) for r in n.documents(docs, "https://s", "https://s/dl").orderBy("doc_id").collect()]
    assert got == [("7", "", "doc-7", "", "https://s/x"), ("8", "2024-02-03", "n", "n", "https://s/dl/8")]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None])), max_size=25), st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None])), max_size=25))
def test_multiset_diff_equals_counters(spark, old, new):
    shape = "k int, v string"
    got = {(r.k, r.v): (r.n_old, r.n_new) for r in diff.multiset_diff(spark.createDataFrame(old, shape), spark.createDataFrame(new, shape), ["k", "v"]).collect()}
    a, b = Counter(old), Counter(new)
    assert got == {x: (a[x], b[x]) for x in a | b if a[x] != b[x]}
