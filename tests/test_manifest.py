import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.operators.diff import keyed_diff
from wardlight.sources import manifest, tables
from wardlight.sources.manifest import Book, latest_by

ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("status", T.StringType())])
LOG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ord", T.LongType())])


def rows(spark, ids, status="new"):
    return spark.createDataFrame([(i, status) for i in ids], ROW)


def ids_of(df):
    return sorted(r.doc_id for r in df.collect())


def test_a_broken_batch_is_never_seen_and_a_rerun_is_whole(spark, monkeypatch):
    book = Book(spark, tables.scratch(spark, "book"))
    assert book.read("a", ROW).count() == 0
    assert book.publish("b0", {"a": (rows(spark, [1, 2]), ROW), "b": (rows(spark, [1]), ROW)})
    whole, calls = Book._written, []

    def broken(self, df, table, label):
        calls.append(table)
        if len(calls) == 2:
            raise OSError("the cluster went away")
        return whole(self, df, table, label)

    monkeypatch.setattr(Book, "_written", broken)
    with pytest.raises(OSError):
        book.publish("b1", {"a": (rows(spark, [3]), ROW), "b": (rows(spark, [3]), ROW)})
    monkeypatch.undo()
    assert calls == ["a", "b"] and ids_of(book.read("a", ROW)) == [1, 2] and ids_of(book.read("b", ROW)) == [1]
    targets = {"a": (rows(spark, [3]), ROW), "b": (rows(spark, [3]), ROW)}
    assert book.publish("b1", targets) and not book.publish("b1", targets)
    assert ids_of(book.read("a", ROW)) == [1, 2, 3] and ids_of(book.read("b", ROW)) == [1, 3]


def test_of_two_writers_one_fails(spark, monkeypatch):
    book = Book(spark, tables.scratch(spark, "book"))
    book.publish("b0", {"a": (rows(spark, [1]), ROW)})
    stale = book.commits()
    book.publish("b1", {"a": (rows(spark, [2]), ROW)})
    monkeypatch.setattr(book, "commits", lambda: stale)
    with pytest.raises(manifest.Taken):
        book.publish("b2", {"a": (rows(spark, [3]), ROW)})
    monkeypatch.undo()
    assert ids_of(book.read("a", ROW)) == [1, 2] and len(book.commits()) == 2


def test_a_purge_writes_only_the_files_concerned(spark):
    book = Book(spark, tables.scratch(spark, "book"))
    for k in range(3):
        book.publish(f"b{k}", {"a": (rows(spark, range(10 * k, 10 * k + 10)).coalesce(1), ROW), "b": (rows(spark, [k]), ROW)})
    before = book.files("a")
    ids = spark.createDataFrame([(12,), (12,), (15,), (2,), (99,), (None,)], "doc_id long")
    both = {"a": ROW, "b": ROW, "never": ROW}
    plan = book.purge_plan(both, ids).collect()
    assert sorted((r.tab, r.n) for r in plan) == [("a", 1), ("a", 2), ("b", 1)]
    assert book.purge(both, ids) == 4 and book.purge(both, ids) == 0 and book.purge_plan(both, ids).count() == 0
    after = book.files("a")
    assert len(before) == 3 and len(set(before) & set(after)) == 1 and set(before) - set(after) == {r.file for r in plan if r.tab == "a"}
    assert ids_of(book.read("a", ROW)) == sorted(set(range(30)) - {2, 12, 15}) and ids_of(book.read("b", ROW)) == [0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_folds_of_logs_split_anywhere_are_folds_of_all(spark, seed):
    rng, fold = random.Random(seed), latest_by("key", order="ord")
    log = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.choice([n, n // 2])) for n in range(40)]
    cuts = sorted(rng.sample(range(41), 3))
    book = Book(spark, tables.scratch(spark, "log"))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 40])):
        book.publish(f"b{k}", {"log": (spark.createDataFrame(log[a:b], LOG).coalesce(1), LOG)})
        if k in (0, 2) and seed:
            book.compact("log", LOG, fold)
    want = sorted(map(str, fold(spark.createDataFrame(log, LOG)).collect()))
    got = book.folded("log", LOG, fold)
    assert sorted(map(str, got.collect())) == want == sorted(map(str, fold(book.read("log", LOG)).collect()))
    if seed:
        state, tail = book._folded("log")
        assert {f.split("/")[-1] for f in got.inputFiles()} == {f.split("/")[-1] for f in state + tail} and not set(state) & set(book.files("log"))
        assert set(tail) < set(book.files("log")) or not tail


def test_a_purge_reaches_folded_states(spark):
    book, fold = Book(spark, tables.scratch(spark, "log")), latest_by("key", order="ord")
    book.publish("b0", {"log": (spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], LOG), LOG)})
    book.compact("log", LOG, fold)
    assert book.purge({"log": LOG}, spark.createDataFrame([("b",)], "key string"), "key") == 1
    assert [r.key for r in book.folded("log", LOG, fold).collect()] == ["a"]


def test_null_keys_are_keys(spark):
    shape = "k string, m string, v int"
    old = spark.createDataFrame([(None, "x", 1), ("a", None, 2), ("b", "y", 3)], shape)
    new = spark.createDataFrame([(None, "x", 1), ("a", None, 5), (None, None, 4)], shape)
    got = {(r.k, r.m): (r.change, r.fields) for r in keyed_diff(old, new, ["k", "m"], ["v"]).collect()}
    assert got == {("a", None): ("CHANGED", "v: 2 -> 5"), ("b", "y"): ("REMOVED", ""), (None, None): ("NEW", "")}


def test_intermediate_tables_are_discarded_by_label(spark):
    since = tables.mark(spark)
    kept, gone = tables.written(spark.range(3), "kept-one"), tables.written(spark.range(3), "gone")
    tables.discard(spark, since, ["kept-one"])
    assert kept.count() == 3 and tables.mark(spark) == since + 1
    with pytest.raises(Exception, match="exist"):
        gone.agg(F.sum("id")).collect()
