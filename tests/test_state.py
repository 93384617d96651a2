import hashlib
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlight.operators import state as st


def fold(rows):
    """One pass over a log in order."""
    processed, skipped, errors = set(), set(), {}
    for doc, _, status in sorted(rows, key=lambda r: r[1]):
        if status == "processed":
            processed.add(doc)
            skipped.discard(doc)
        elif status == "skipped":
            skipped.add(doc)
        elif doc not in processed and doc not in skipped:
            errors[doc] = errors.get(doc, 0) + 1
        if status != "error":
            errors.pop(doc, None)
    return {d: (d in processed, d in skipped, errors.get(d, 0)) for d in {r[0] for r in rows}}


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_one_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 30), k, rng.choice(["processed", "skipped", "error", "error"])) for k in range(120)]
    got = {r.doc: (r.processed, r.skipped, r.errors) for r in st.folded(spark.createDataFrame(rows, "doc int, ord int, status string")).collect()}
    assert got == fold(rows)


def test_todo(spark):
    state = spark.createDataFrame([(1, True, False, 0), (2, False, True, 0), (3, False, False, 3), (4, False, False, 2)], "doc int, processed boolean, skipped boolean, errors long")
    listed = spark.createDataFrame([(k,) for k in range(1, 6)], "doc int")
    assert {r.doc: r.reason for r in st.todo(listed, state).collect()} == {4: "retry", 5: "new"}
    assert {r.doc: r.reason for r in st.todo(listed, state, retry_poisoned=True, force=[2]).collect()} == {2: "forced", 3: "retry", 4: "retry", 5: "new"}


def test_stagger_is_the_whole_number_modulo(spark):
    names = [f"N{k}" for k in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "srn string")
    for period in (14, 90):
        got = {r.srn: r.m for r in df.select("srn", st.stagger(F.col("srn"), period).alias("m")).collect()}
        assert got == {n: int(hashlib.sha256(n.encode()).hexdigest(), 16) % period for n in names}


def test_due(spark):
    day = date(2024, 3, 5)
    sites = spark.createDataFrame([(f"N{k}", c) for k in range(30) for c in ("daily", "biweekly", "quarterly", "never heard of")], "srn string, cadence string")
    for r in st.due(sites, str(day)).collect():
        period = {"biweekly": 14, "quarterly": 90}.get(r.cadence)
        want = True if period is None else (day.toordinal() - int(hashlib.sha256(r.srn.encode()).hexdigest(), 16) % period) % period < 3
        assert r.due == want


def test_meeting_due_and_upcoming(spark):
    events = spark.createDataFrame([(1, "2024-03-05"), (2, "2024-03-08"), (3, "2024-03-09"), (4, None), (5, "2024-03-04")], "event int, d string").withColumn("date", F.to_date("d"))
    assert {r.event for r in st.meeting_due(events, "2024-03-05", 0, 3).where("due").collect()} == {1, 2}
    assert st.meeting_due(events, "2024-03-05", 1, 3).where("due").count() == 5
    rows = spark.createDataFrame([("2024-03-01", "2024-03-06", "over"), ("2024-03-19", None, "last"), ("2024-03-20", None, "late"), ("2024-03-06", "2024-01-01", "bad end"), ("2024-03-06", None, " ")], "a string, b string, title string")
    rows = rows.select(F.to_date("a").alias("date"), F.to_date("b").alias("end_date"), "title")
    days = spark.createDataFrame([("2024-03-05",)], "d string").select(F.to_date("d").alias("on_day"))
    assert {r.title for r in st.upcoming(rows, days).collect()} == {"over", "last", "bad end"}


def test_guards(spark):
    counts = spark.createDataFrame([(1, 0, 10), (2, 4, 10), (3, 5, 10), (4, 3, None), (5, None, None)], "site int, n int, last_n int")
    assert {r.site: r.decision for r in st.bad_fetch(counts).collect()} == {1: "keep", 2: "keep", 3: "accept", 4: "accept", 5: "keep"}
    tiers = spark.createDataFrame([(1, "daily"), (9, "daily")], "site int, cadence string")
    with pytest.raises(Exception, match="unknown site 9"):
        st.matched_tiers(tiers, counts, "site").collect()
    ok = [(429, None, True), (503, "x", True), (400, "Usage limit hit", True), (400, "bad", False), (None, None, False)]
    rows = spark.createDataFrame([(s, m, k) for k, (s, m, _) in enumerate(ok)], "status int, message string, k int")
    assert {r.k: r.t for r in rows.select("k", st.transient(F.col("status"), F.col("message")).alias("t")).collect()} == {k: w for k, (_, _, w) in enumerate(ok)}


def test_caps_stubs_and_settings(spark):
    lines = spark.createDataFrame([(1, f"l{k}") for k in range(5)] + [(2, "x")], "site int, line string")
    got = sorted((r.site, r.nth, r.line) for r in st.capped(lines, ["site"], [F.col("line")], 3).collect())
    assert got[-2:] == [(1, 4, "… 2 more"), (2, 1, "x")] and len(got) == 5
    stub = st.stubs(lines.select("site"), ["site", "title"], "unreadable").first()
    assert (stub.title, stub.note) == ("", "unreadable")
    meta = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("z", "9", 1)], "key string, value string, ord int")
    base = spark.createDataFrame([("a", "0"), ("b", "0")], "key string, value string")
    assert {r.key: r.value for r in st.with_defaults(meta, base).collect()} == {"a": "2", "b": "0"}
