"""Clustering of integer vectors around centroids with a table of pivot distances (LAESA).

Vectors become whole numbers once and are written with their distances to a few fixed pivots. In every round the centroids'
distances to the pivots are taken, and by the triangle inequality the largest difference of a vector's and a centroid's
distance to one pivot is a lower bound of their own distance. Centroids are met in the order of their bounds: the nearest by
bound gets an exact integer distance, and so does each further one whose bound doesn't pass the best so far; the rest can't
win. Bounds are rounded down by more than a double's error and ties are kept, so results are those of comparing all.

A round is one pass over the written table: tasks add their vectors' components by centroid before anything is shuffled,
so a centroid with a third of all rows costs no more than any other, and the driver gets one row a centroid. Pivots are drawn
far apart from the ``SAMPLE`` vectors of smallest hash; they change what is skipped, never a result.

Cases: vectors that are null, of another length than ``size``, or hold a null or a component that is not finite take no
part; rows with one id each get a row, and tie as starts by their components; a null id reads as the empty text; fewer vectors
than ``k`` are all starts; an empty table gives no rows; further columns aren't read. Components of 2^27 or more after scaling
have squared distances beyond 64 bits and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.sources.tables import written

SIZE, SCALE, K, ROUNDS = 64, 1024, 8, 10
PIVOTS, SAMPLE = 8, 1024
#: Largest component: 64 squares of twice that fit in 63 bits.
LARGEST = 1 << 27


def usable(vector: Column, size: int = SIZE) -> Column:
    """Whether a vector has exactly ``size`` components, none null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == size) & ~F.exists(vector, bad), F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, taken as double."""

    def number(x: Column) -> Column:
        y = F.floor(x.cast("double") * float(scale))
        return F.when(F.abs(x.cast("double")) * float(scale) < LARGEST, y).otherwise(F.raise_error("a component is too large for distances of 64 bits"))

    return F.transform(vector, number)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one point."""
    away = rows - point
    return np.einsum("ij,ij->i", away, away)


def draw_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample far from each other, the first first."""
    chosen, least = [], None
    for _ in range(min(pivots, len(sample))):
        at = 0 if least is None else int(np.argmax(least))
        if least is not None and least[at] == 0:
            break
        chosen.append(sample[at])
        far = squares(sample, sample[at])
        least = far if least is None else np.minimum(least, far)
    return np.array(chosen, np.int64).reshape(len(chosen), sample.shape[1])


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller), its squared distance, and how many exact distances that took.

    ``to_pivots`` holds the rows' distances to the pivots (not squared).
    """
    n, k = len(rows), len(centroids)
    bounds = np.zeros((n, k))
    for p, pivot in enumerate(pivots):
        np.maximum(bounds, np.abs(to_pivots[:, p, None] - np.sqrt(squares(centroids, pivot).astype(np.float64))), out=bounds)
    bounds = np.square(np.maximum(bounds * (1 - 1e-9) - 1e-6, 0.0)) * (1 - 1e-9)  # below the true bound whatever the rounding
    best, at, exact = np.full(n, np.iinfo(np.int64).max), np.full(n, k), 0
    for turn in np.argsort(bounds, axis=1, kind="stable").T:
        for c in range(k):
            mine = np.flatnonzero(turn == c)
            mine = mine[bounds[mine, c] <= best[mine]]  # the others' bounds pass what they have
            found = squares(rows[mine], centroids[c])
            exact += len(mine)
            won = (found < best[mine]) | ((found == best[mine]) & (c < at[mine]))
            best[mine[won]], at[mine[won]] = found[won], c
    return at, best, exact


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``id`` and whole-number ``v`` (array<long>) of the vectors that take part."""
    vector = table[f"`{vector_col}`"]
    kept = table.where(usable(vector, size))
    return kept.select(kept[f"`{id_col}`"].alias("id"), whole(kept[f"`{vector_col}`"], scale).alias("v"))


def with_pivots(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Rows with ``far``, their distances to the pivots."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), size)
            far = np.stack([np.sqrt(squares(v, p).astype(np.float64)) for p in pivots], axis=1) if len(v) else np.empty((0, len(pivots)))
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(offsets, pa.array(far.ravel()))], names=["id", "v", "far"])

    return rows.mapInArrow(run, f"id {kind}, v array<long>, far array<double>")


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and squared ``distance`` of each row of the pivot table."""
    kind, size = table.schema["id"].dataType.simpleString(), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, best, _ = nearest(_matrix(batch.column("v"), size), _matrix(batch.column("far"), len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return table.mapInArrow(run, f"id {kind}, cluster int, distance long")


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after one round, and the exact distances that it took; empty ones stay."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, exact = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            v = _matrix(batch.column("v"), size)
            at, _, took = nearest(v, _matrix(batch.column("far"), len(pivots)), centroids, pivots)
            exact += took
            for c in range(k):
                mine = v[at == c]
                sums[c] += mine.sum(axis=0)
                counts[c] += len(mine)
        offsets = pa.array(np.arange(k + 1, dtype=np.int32) * size)
        took = np.zeros(k, np.int64)
        took[0] = exact
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array(took), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["cluster", "n", "exact", "sums"])

    tasks = table.select("v", "far").mapInArrow(run, "cluster int, n long, exact long, sums array<long>")
    total = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
    rows = tasks.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), *total).collect()
    after = centroids.copy()
    for r in rows:
        if r.n:
            after[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(size)]
    return after, sum(r.exact for r in rows)


def starts(rows: DataFrame, k: int = K, salt: str = "3:") -> list[tuple[int, ...]]:
    """The ``k`` vectors with the smallest SHA-256 of ``salt`` and id."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [tuple(r.v) for r in rows.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()]


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector that takes part."""
    rows = written(vectors(table, id_col, vector_col, size, scale), "centroid-vectors")
    first = starts(rows, k)
    names = [F.col("id").alias(id_col), "cluster", "distance"]
    if not first:
        none = F.lit(None)
        return rows.select(F.col("id").alias(id_col), none.cast("int").alias("cluster"), *[none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], none.cast("string").alias("centroid_sha256"))
    centroids = np.array(first, np.int64)
    sample = np.array(starts(rows, SAMPLE, "pivot:"), np.int64)
    far_apart = draw_pivots(sample, pivots)
    stored = written(with_pivots(rows, far_apart, size), "centroid-pivots")
    for _ in range(rounds):
        centroids, _ = moved(stored, centroids, far_apart)
    last = written(assigned(stored, centroids, far_apart), "centroid-last")
    sums = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()  # a row a centroid
    inertia = sum(r.cluster_inertia for r in sums)
    facts = [(r.cluster, r.cluster_inertia, inertia, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    known = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(known), "cluster").select(*names, "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS, k: int = K, size: int = SIZE) -> str:
    """The same in SQL, a pair of tables for each round."""
    away = f"list_sum([(v[j] - c[j]) * (v[j] - c[j]) for j in range(1, {size + 1})])::BIGINT"
    near = "SELECT vec_id, v, unnest(min({{'d': {away}, 'k': k}})) FROM kept, c{i} GROUP BY vec_id, v"
    text = [
        f"WITH kept AS MATERIALIZED (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings"
        f" WHERE len(embedding) = {size} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {size})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS k, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds):
        text.append(f"a{i} AS MATERIALIZED ({near.format(away=away, i=i)})")
        text.append(f"s{i} AS MATERIALIZED (SELECT k, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {size + 1}) t(j) GROUP BY k, j)")
        text.append(f"m{i} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY k)")
        text.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    text.append(f"last AS MATERIALIZED ({near.format(away=away, i=rounds)})")
    return ",\n".join(text) + (
        "\nSELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{rounds} USING (k)"
    )


ORACLE_SQL = _oracle()
