import pytest

from wardlight.operators import diff

SHAPE = "site int, kind string, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def test_repeats_and_nulls_count(spark):
    old = frame(spark, [(1, "a", None)] * 3 + [(1, "b", "x"), (2, None, None)])
    new = frame(spark, [(1, "a", None)] + [(1, "b", "x")] * 2 + [(2, None, None), (3, "c", "n")])
    got = {(r.site, r.kind): (r.n_old, r.n_new, r.added, r.removed) for r in diff.multiset_diff(old, new, ["site", "kind", "note"]).collect()}
    assert got == {(1, "a"): (3, 1, 0, 2), (1, "b"): (1, 2, 1, 0), (3, "c"): (0, 1, 1, 0)}


@pytest.mark.parametrize("parts", [1, 5])
def test_snapshot_hash_ignores_order_and_keeps_repeats(spark, parts):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", None), (2, "c", "")]

    def hashes(rs):
        return {r.site: (r.hash, r.n_rows) for r in diff.snapshot_hash(frame(spark, rs).repartition(parts), ["site"], ["kind", "note"]).collect()}

    assert hashes(rows) == hashes(rows[::-1])
    assert hashes(rows)[1] != hashes(rows[1:])[1] and hashes(rows)[2] == hashes(rows[1:])[2]


def test_headlines(spark):
    old, new = frame(spark, [(1, "a", "x"), (2, "a", "x"), (3, "a", "x")]), frame(spark, [(1, "a", "x"), (3, "b", "x"), (4, "a", "x")])
    d = diff.multiset_diff(old, new, ["site", "kind", "note"])
    got = {r.site: r.headline for r in diff.headline(d, old, new, "site").collect()}
    assert got == {1: "unchanged", 2: "all records gone", 3: "changed", 4: "first records"}


def test_keyed_diff_names_fields(spark):
    old, new = frame(spark, [(1, "a", "x"), (2, "a", None), (3, "a", "x")]), frame(spark, [(1, "a", "x"), (2, "b", "y"), (4, "a", "x")])
    got = {r.site: (r.change, r.fields) for r in diff.keyed_diff(old, new, ["site"], ["kind", "note"]).collect()}
    assert got == {2: ("CHANGED", "kind: a -> b; note:  -> y"), 3: ("REMOVED", ""), 4: ("NEW", "")}
    assert {r.site for r in diff.digest_keyed_diff(old, new, ["site"], ["kind", "note"]).collect()} == set(got)


def test_duplicate_keys_are_seen(spark):
    got = {r.site: r.has_duplicates for r in diff.duplicate_keys(frame(spark, [(1, "a", ""), (1, "a", ""), (2, "a", ""), (2, "b", "")]), ["kind"], ["site"]).collect()}
    assert got == {1: True, 2: False}


def test_identities_that_go_are_kept_and_collisions_counted(spark):
    seen, now = frame(spark, [(1, "a", "x"), (2, "a", "x")]), frame(spark, [(2, "a", "y"), (3, "a", "x"), (3, "a", "z")])
    got = {r.site: (r.state, r.collisions) for r in diff.identity_diff(seen, now, ["site"], ["note"]).collect()}
    assert got == {2: ("changed", 0), 3: ("new", 1)}


def test_gate_and_latest(spark):
    log = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "h2"), ("b", 1, "h1")], "item string, ord int, hash string")
    now = spark.createDataFrame([("a", "h2"), ("b", "h9"), ("c", "h1")], "item string, hash string")
    assert {r.item: r.result for r in diff.hash_gate(now, log, ["item"], "ord").collect()} == {"a": "unchanged", "b": "changed", "c": "baseline"}


def test_flip_and_sets(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, True)], "k int, m boolean")
    b = spark.createDataFrame([(1, False), (2, True), (4, False)], "k int, m boolean")
    assert {r.k: r.change for r in diff.presence_flip(a, b, "k", "m").collect()} == {1: "disappeared", 2: "appeared", 3: "disappeared"}
    got = diff.set_diff(frame(spark, [(1, "a", ""), (1, "b", "")]), frame(spark, [(1, "b", ""), (1, "c", "")]), ["site"], "kind").collect()
    assert {(r.kind, r.change) for r in got} == {("a", "removed"), ("c", "added")}


def test_line_diff(spark):
    old = spark.createDataFrame([(1, ["a", "b", "b"], ["/x"]), (2, ["a"], ["/x"]), (3, ["a"], [])], "page int, lines array<string>, links array<string>")
    new = spark.createDataFrame([(1, ["a", "b", "c"], ["/x"]), (2, ["a"], ["/y"]), (3, ["a"], [])], "page int, lines array<string>, links array<string>")
    assert {r.page: (r.plus, r.minus, r.change) for r in diff.line_diff(old, new, "page", "lines", "links").collect()} == {1: (1, 1, "text"), 2: (0, 0, "links only"), 3: (0, 0, "unchanged")}


def test_digests_tell_apart_what_a_separator_would_not(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ('a"', "b"), ("a", '"b'), (None, "x"), ("", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, q string").select(diff.digest("p", "q")).collect()]
    assert len(set(got[:4])) == 4 and got[4] == got[5]  # a missing value counts as an empty one


def test_a_change_in_any_of_clashing_records_shows(spark):
    def frame(*rows):
        return spark.createDataFrame(list(rows), "k int, v string")

    old = frame((1, "a"), (1, "b"), (2, "x"), (3, "y"), (3, "y"))
    got = {r.k: (r.state, r.collisions) for r in diff.identity_diff(old, frame((1, "b"), (1, "c"), (2, "x"), (3, "y"), (3, "y")), ["k"], ["v"]).collect()}
    assert got == {1: ("changed", 1), 2: ("unchanged", 0), 3: ("unchanged", 1)}
    got = {r.k: r.state for r in diff.identity_diff(old, frame((1, "b"), (1, "a"), (3, "y"), (4, "n")), ["k"], ["v"]).collect()}
    assert got == {1: "unchanged", 3: "changed", 4: "new"}
