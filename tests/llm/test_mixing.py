import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wardlight.llm import mixing


def brute_targets(sizes, total):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = {s: 0.0 for s in order if sizes[s] == 0}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: 3.0 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def make(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 10 + ["b", "a", None, "é", "z"])
        rows.append((i if i % 50 else None, "word " * rng.choice([0, 1, 5, 30, 300]) + rng.choice(["", "x1", "##!"]), source, "kept"))
    rows += [(7, "twice here", "b", "kept")] * 3 + [(8, None, "b", "kept"), (9, "", "empty", "kept")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)


@pytest.mark.parametrize("n", [0, 5, 400])
def test_targets_sizes_and_takes(spark, n):
    rows, docs = make(spark, n, n)
    got = mixing.mix(docs, per_bucket=16).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes, sum(sizes.values()))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    for s, target in want.items():
        largest = max(r.size for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= largest / 2 + 1e-6


def test_reruns_and_bucket_sizes_agree(spark):
    _, docs = make(spark, 300, 1)

    def runs(**k):
        return sorted(map(str, mixing.mix(docs, **k).select("doc_id", "source", "size", "taken").collect()))

    assert runs(per_bucket=7) == runs(per_bucket=10_000) == runs(per_bucket=100)


def test_empty_table(spark):
    _, docs = make(spark, 3, 1)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_equals_sql(spark):
    rows, docs = make(spark, 300, 2)
    documents = docs.toPandas()  # noqa: F841
    want = sorted(map(str, duckdb.sql(mixing.ORACLE_SQL.replace("FROM documents", "FROM (SELECT doc_id::BIGINT doc_id, text, source FROM documents)")).fetchall()))
    got = sorted(str((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in mixing.mix(docs).collect())
    assert got == want


def test_quality_is_preferred(spark):
    rows = [(i, "good words here" if i % 2 else "9 9 9", "a" if i < 200 else "b") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix(docs).collect() if r.source == "b"]
    assert 0 < got[0].target < got[0].source_size
    assert sum(r.taken for r in got if r.doc_id % 2) > 2 * sum(r.taken for r in got if not r.doc_id % 2)


def test_clashing_columns_pass_through(spark):
    names = ["rows", "_key", "_nth", "_bucket", "row", "key", "tie", "id", "nth", "bucket", "last", "epochs", "left", "of", "offset", "a.b", "_metadata"]
    rows = [(i, "some words here", "s%d" % (i % 2), *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", *names, "size", "source_size", "target", "copies", "taken"]
    assert sorted(tuple(r)[: len(names) + 3] for r in got.collect()) == sorted(rows)
    assert mixing.mix(docs, keep=("doc_id", "rows")).columns == ["doc_id", "rows", "size", "source_size", "target", "copies", "taken"]


def test_many_repeated_rows_are_taken_near_the_target(spark):
    rows = [(1, "one two three", "a")] * 900 + [(i, "one two three", "a") for i in range(2, 300)] + [(i, "w " * 40, "b") for i in range(1000, 1100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), per_bucket=100).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    assert len(got) == len(rows)


def test_buckets_are_even(spark):
    """Keys of given texts' qualities: the largest range bucket is under three times the median."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(mixing.text_quality(F.col("text")).alias("q"))
    keys = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).select((-F.log(F.rand(5)) / F.col("q")).alias("key"))
    sizes = sorted(r["count"] for r in keys.repartitionByRange(200, "key").groupBy(F.spark_partition_id()).count().collect())
    assert sum(sizes) == 400_000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
