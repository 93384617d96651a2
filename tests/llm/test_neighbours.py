import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wardlight.llm import neighbours

SHAPE = "vec_id long, embedding array<float>, score int"


def brute(rows, k=5):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 16:
            ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        best = [(-max(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) for a in ok[q] for b in ok[i]), i) for i in ok if i != q]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in best)[:k]]
    return out


def rows_of(n, seed=1):
    rng = random.Random(seed)
    hot = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(16)], 0) for i in range(n)]
    rows += [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9050, [None] * 16, 0), (9100, [], 0), (9150, [1.0, 2.0], 0), (None, hot, 0)]
    return rows + rows[:5]


def test_all_files_probed_is_exact(spark):
    rows = rows_of(700)
    df = spark.createDataFrame(rows, SHAPE).repartition(4)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0, pivots=16, prefix=16, post=1, probe=16, share=1.0, block=64).collect()
    want = brute(rows)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == want.keys()
    for q, hits in want.items():
        assert [s for _, s in by[q]] == pytest.approx([s for _, s in hits], abs=1e-9)
        assert [i for i, _ in by[q]] == [i for i, _ in hits]


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    pdf = df.toPandas()
    x = np.stack(pdf["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = pdf["vec_id"].to_numpy()
    hit = 0
    for q in (queries := np.flatnonzero(ids % 50 == 0)):
        s = x @ x[q]
        s[q] = -9
        hit += len(got[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hit / (5 * len(queries)) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(50 * i, [1.0, float(i)], 0) for i in range(n)], SHAPE)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == n * (n - 1)


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(2)
    pivots, vectors, prefix = 12, 20, 7
    orders = np.stack([rng.permutation(pivots)[:prefix] for _ in range(vectors)]).astype(np.int16)
    q = rng.permutation(pivots)[:prefix].astype(np.int16)
    own = {int(p): k for k, p in enumerate(q)}
    theirs = [{int(p): k for k, p in enumerate(o)} for o in orders]
    want = np.array([sum(abs(own.get(p, prefix) - t.get(p, prefix)) for p in range(pivots)) for t in theirs])
    got = neighbours.footrules(neighbours.places_of(q, pivots), orders)
    assert len(set((got - want).tolist())) == 1


def test_very_large_and_small_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) * np.array([1e200, 1e-200, 1.0])[np.arange(60) % 3, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 10
    for q in (0, 50):
        near = unit @ unit[q]
        near[q] = -9
        want = np.argsort(-near)[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == want.tolist()
        assert [r.score for r in mine] == pytest.approx(near[want].tolist(), abs=1e-12)


def recall(spark, path, every, x, ids):
    df = spark.read.parquet(path)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit, queries = 0, np.flatnonzero(ids % every == 0)
    for q in queries:
        near = x @ x[q]
        near[q] = -9
        hit += len(got[ids[q]] & set(ids[np.argpartition(-near, 5)[:5]].tolist()))
    return hit / (5 * len(queries))


class Watch:
    """Keeps what the operator fitted."""

    def __init__(self, monkeypatch):
        self.fitted, inner = [], neighbours.fitted

        def kept(posted, asking, base, *rest):
            self.fitted.append((len(base), *inner(posted, asking, base, *rest)))
            return self.fitted[-1][1:]

        monkeypatch.setattr(neighbours, "fitted", kept)

    def met(self, x, every):
        """Part of all vectors that a query meets."""
        pivots, probe, _ = self.fitted[-1]
        base = x[np.random.default_rng(9).permutation(len(x))[:pivots]]
        orders, asked = neighbours.nearest_orders(x, base, 2), neighbours.nearest_orders(x[::every], base, probe)
        return float(np.mean([(neighbours.places_of(o, pivots)[orders].min(axis=1) < probe).mean() for o in asked[:100]]))


@pytest.fixture
def watch(monkeypatch):
    return Watch(monkeypatch)


def stored(path, x):
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": flat}), path, row_group_size=25_000)
    x = x.astype(np.float32).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_on_random_directions(spark, watch, tmp_path):
    """As the given vectors: nothing is near, so many files are met."""
    path = str(tmp_path / "directions.parquet")
    x = stored(path, np.random.default_rng(8).normal(size=(10_256, 64)))
    assert recall(spark, path, 50, x, np.arange(len(x))) >= 0.9
    assert watch.met(x, 50) < 0.8


def test_extra_columns_of_clashing_names(spark):
    rows = [(k, [float(k % 5), 1.0 + k % 3], "x", 1, 2.0, k) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, rank int, score double, query_id int")
    plain = neighbours.search(df.select("vec_id", "embedding"), F.col("vec_id") % 10 == 0)
    got = neighbours.search(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 15


def test_clustered_vectors_are_found_in_few_files(spark, watch, tmp_path):
    rng, shares = np.random.default_rng(4), []
    for n in (50_000, 200_000):
        centres = rng.normal(size=(n // 100, 64))
        x = centres[rng.integers(len(centres), size=n)] + 0.35 * rng.normal(size=(n, 64))
        path = str(tmp_path / f"v{n}.parquet")
        x = stored(path, x)
        assert recall(spark, path, 1000, x, np.arange(n)) >= 0.9
        shares.append(watch.met(x, 1000))
    assert shares[1] < shares[0] < 0.2  # the part met falls as vectors become more
