"""Approximate nearest neighbours by a permutation index.

A sample of vectors serves as pivots, about as many as the root of the number of distinct vectors (128 to
16,384). Each vector is stood for by the order of its ``prefix`` nearest pivots and posted in the inverted
files of the first ``post`` of them; a query opens the files of its ``probe`` nearest pivots. In a file,
vectors are ranked by the footrule distance between the two orders (pivots beyond ``prefix`` count as one place
behind), and the best ``share`` of them, ``floor`` at least, is ranked again by the cosine of the original
vectors, in double precision. A vector posted in several opened files is ranked in the first only.

Where ``probe`` and ``share`` are not given, they are fitted on ``tries`` of the queries, whose true neighbours one
pass over all vectors finds: the least numbers are taken that reach each a part ``reach`` of these. For vectors
that lie in clusters a few files are enough, so a query meets about the root of their number; directions at random
need a constant part of the files however many vectors there are.

Equal vectors are indexed once, with as many of their smallest ids as a result can hold, and equal
queries are searched once. A file over ``block`` vectors is split by hash and meets its queries in each part,
so a pivot near a third of all rows is many tasks; postings are sent once, and again only for each further
``crowd`` queries of one file.

Cases: vectors that are null, empty, zero or hold null or non-finite values, or whose length isn't the
most common one, take no part, nor do rows with a null id; repeated rows count once; with too few
candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.sources.tables import written

MOST_PIVOTS = 16_384


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's ``prefix`` nearest pivots by cosine, nearest first."""
    out = np.empty((len(vectors), prefix), np.int16)
    for k in range(0, len(vectors), 256):
        near = -(vectors[k : k + 256] @ pivots.T)
        first = np.sort(np.argpartition(near, prefix - 1, axis=1)[:, :prefix], axis=1) if prefix < len(pivots) else np.tile(np.arange(prefix), (len(near), 1))
        ranks = np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable")  # ties to the smaller number
        out[k : k + 256] = np.take_along_axis(first, ranks, 1)
    return out


def places_of(order: np.ndarray, pivots: int) -> np.ndarray:
    """Place of each pivot in an order, ``pivots`` where it isn't in it."""
    places = np.full(pivots, pivots, np.int16)
    places[order] = np.arange(len(order), dtype=np.int16)
    return places


def footrules(places: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Footrule distances of a query to vectors with ``orders``, but for a term that is the same for all.

    ``places`` is each pivot's place in the query's order. Pivots of the vector's prefix add how far they moved;
    those of the query alone add ``prefix - place``, which is a constant less what the shared ones take from it.
    """
    prefix = orders.shape[1]
    theirs = np.minimum(places, prefix)[orders]
    own = np.arange(prefix, dtype=np.int16)
    return (np.abs(theirs - own) + theirs).sum(axis=1, dtype=np.int32)


def met_first(places: np.ndarray, orders: np.ndarray, file: int, post: int) -> np.ndarray:
    """Which vectors of a file a query meets there for the first time."""
    return places[orders[:, :post]].min(axis=1) == places[file]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that products neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(posted: DataFrame, asking: DataFrame, base: np.ndarray, prefix: int, post: int, k: int, tries: int, reach: float) -> tuple[int, float]:
    """Files to open and part of a file to rank again, for which a part ``reach`` of the true neighbours of ``tries`` queries is reached by each.

    One pass over the vectors finds those neighbours, one over the files that they stand in counts what ranks
    before them there; the driver gets ``k`` neighbours a query and two numbers each.
    """
    pivots = len(base)
    drawn = asking.orderBy(F.xxhash64(F.lit("try"), "k1"), "k2").limit(tries).select("k1", "k2", "v").toArrow()
    if not drawn.num_rows:
        return pivots, 1.0
    asked, keys = _unit(_matrix(drawn.column("v"))), [np.asarray(drawn.column(c)) for c in ("k1", "k2")]
    places = np.stack([places_of(o, pivots) for o in nearest_orders(asked, base, pivots)])

    def nearest(batches):
        score, order = np.full((0, len(asked)), -np.inf), np.zeros((0, len(asked), prefix), np.int16)
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch.column("v"))) @ asked.T
                near[(np.asarray(batch.column("k1"))[:, None] == keys[0]) & (np.asarray(batch.column("k2"))[:, None] == keys[1])] = -np.inf
                orders = np.asarray(batch.column("places").flatten()).reshape(batch.num_rows, -1)
                top = np.argsort(-near, axis=0, kind="stable")[:k]
                score = np.concatenate([score, np.take_along_axis(near, top, 0)])
                order = np.concatenate([order, orders[top]])
                best = np.argsort(-score, axis=0, kind="stable")[:k]
                score, order = np.take_along_axis(score, best, 0), np.take_along_axis(order, best[:, :, None], 0)
        of = np.tile(np.arange(len(asked)), len(score))
        found = np.isfinite(score.ravel())
        ends = pa.array(np.arange(found.sum() + 1, dtype=np.int32) * prefix)
        yield pa.RecordBatch.from_arrays([pa.array(of[found]), pa.array(score.ravel()[found]), pa.ListArray.from_arrays(ends, pa.array(order.reshape(-1, prefix)[found].ravel()))], names=["q", "score", "places"])

    once = posted.where(F.col("file") == F.get("places", F.lit(0))).select("k1", "k2", "v", "places")
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "places"))
    near = once.mapInArrow(nearest, "q long, score double, places array<short>").withColumn("n", place).where(F.col("n") <= k).collect()
    if not near:
        return pivots, 1.0
    needed, tests = [], {}
    for j, r in enumerate(near):
        order = np.array(r.places, np.int16)
        file = int(order[places[r.q, order[:post]].argmin()])
        needed.append(int(places[r.q, file]) + 1)
        tests.setdefault(file, []).append((j, r.q, int(footrules(places[r.q], order[None])[0])))

    def before(batches):
        counts = np.zeros((len(near), 2), np.int64)
        for batch in batches:
            files = np.asarray(batch.column("file"))
            orders = np.asarray(batch.column("places").flatten()).reshape(batch.num_rows, -1)
            for file in np.unique(files).tolist():
                own = orders[files == file]
                for j, q, far in tests[file]:
                    met = own[met_first(places[q], own, file, post)]
                    counts[j] += (footrules(places[q], met) < far).sum(), len(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(near))), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["j", "before", "met"])

    sums = posted.where(F.col("file").isin(list(tests))).select("file", "places").mapInArrow(before, "j long, before long, met long").groupBy("j")
    parts = [(r.before + 1) / max(r.met, 1) for r in sums.agg(F.sum("before").alias("before"), F.sum("met").alias("met")).collect()]
    return int(np.quantile(needed, reach, method="higher")), min(1.0, float(np.quantile(parts, reach, method="higher")))


def search(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    pivots: int | None = None,
    prefix: int = 64,
    post: int = 2,
    probe: int | None = None,
    share: float | None = None,
    floor: int = 48,
    reach: float = 0.97,
    tries: int = 64,
    block: int = 8192,
    crowd: int = 65_536,
) -> DataFrame:
    """``query_id``, ``rank``, ``id_col`` and ``score`` of the ``k`` nearest found for each query row, itself excluded by id."""
    kind = rows.schema[id_col].dataType.simpleString()
    inner = rows.schema[vector_col].dataType.elementType.simpleString()
    found = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    found = found.where(F.col("id").isNotNull() & usable(F.col("v")))
    common = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    found = found.where(F.size("v") == (common.n if common else 0))
    found = found.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})

    # as many ids of a vector as a result can hold besides the query's own; ranking drops the rest before its shuffle
    nth = F.dense_rank().over(W.partitionBy("k1", "k2").orderBy("id"))
    same = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("k1", "k2")
    files = written(same.agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    asked = found.where("asks").select("id", "k1", "k2").distinct()
    asking = written(found.where("asks").groupBy("k1", "k2").agg(F.first("v").alias("v")), "queries")

    distinct = files.count()
    if not distinct:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    pivots = min(distinct, pivots or min(max(128, int(distinct**0.5)), MOST_PIVOTS))
    base = _unit(_matrix(files.orderBy(F.xxhash64(F.lit("pivot"), "k1"), "k2").limit(pivots).select("v").toArrow().column("v")))
    prefix, post = min(prefix, pivots), min(post, pivots)

    def ordered(length: int, count: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                orders = nearest_orders(_unit(_matrix(batch.column("v"))), base, length)
                flat = pa.array(orders.ravel())
                ends = pa.array(np.arange(len(orders) + 1, dtype=np.int32) * length)
                near = pa.array(np.ascontiguousarray(orders[:, :count]).ravel())
                near_ends = pa.array(np.arange(len(orders) + 1, dtype=np.int32) * count)
                columns = [batch.column(c) for c in batch.schema.names] + [pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(near_ends, near)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "places", "near"])

        return run

    shape = f"k1 long, k2 long, v array<{inner}>, {{}}places array<short>, near array<short>"
    posted = files.select("k1", "k2", "v", "ids").mapInArrow(ordered(prefix, post), shape.format(f"ids array<{kind}>, ")).withColumn("file", F.explode("near")).drop("near")
    posted = written(posted, "files")
    if probe is None or share is None:
        wide, part = fitted(posted, asking, base, prefix, post, k, tries, reach)
        probe, share = probe or wide, share or part
    probe = min(probe, pivots)
    asks = asking.select("k1", "k2", "v").mapInArrow(ordered(max(prefix, probe), probe), shape.format("")).withColumn("file", F.explode("near")).drop("near")
    asks = written(asks, "probes")

    def split(df: DataFrame, size: int) -> Column:
        """Parts of each file, from its count: a list as long as there are pivots."""
        counts = {r.file: r["count"] for r in df.groupBy("file").count().collect()}
        return F.lit([max(1, -(-counts.get(p, 0) // size)) for p in range(pivots)])

    blocks, chunks = F.get(split(posted, block), F.col("file")), F.get(split(asks, crowd), F.col("file"))
    posted = posted.withColumn("block", F.pmod("k1", blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), (chunks - 1).cast("long"))))
    asks = asks.withColumn("chunk", F.pmod("k1", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))

    def rank(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"k1": [], "k2": [], "ids": [], "score": []}
        n = vectors.num_rows
        if n and queries.num_rows:
            # by smallest id, so that ties go to it and reruns agree
            vectors = vectors.take(pc.sort_indices(pc.list_element(vectors.column("ids"), 0)))
            x, q = _scaled(_matrix(vectors.column("v"))), _scaled(_matrix(queries.column("v")))
            x_norm, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
            orders = np.asarray(vectors.column("places").combine_chunks().flatten()).reshape(n, -1)
            asked_orders = np.asarray(queries.column("places").combine_chunks().flatten()).reshape(len(q), -1)
            file = vectors.column("file")[0].as_py()
            picked, keys = [], []
            for j in range(len(q)):
                places = places_of(asked_orders[j, :probe], pivots)
                met = np.flatnonzero(met_first(places, orders, file, post))
                most = max(floor, int(np.ceil(share * len(met))))
                if most < len(met):
                    far = footrules(places_of(asked_orders[j], pivots), orders[met])
                    met = met[np.sort(np.argsort(far, kind="stable")[:most])]
                score = x[met] @ q[j] / (x_norm[met] * q_norm[j])
                top = np.argsort(-score, kind="stable")[: k + 1]
                picked.append((met[top], score[top]))
                keys.append(np.full(len(top), j))
            rows_at, whose = np.concatenate([p[0] for p in picked]), np.concatenate(keys)
            taken = queries.take(whose)
            return pa.table({"k1": taken.column("k1"), "k2": taken.column("k2"), "ids": vectors.column("ids").take(rows_at), "score": np.concatenate([p[1] for p in picked])})
        return pa.table(out, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ids", vectors.schema.field("ids").type), ("score", pa.float64())]))

    key = ["file", "block", "chunk"]
    near = posted.groupBy(key).cogroup(asks.groupBy(key)).applyInArrow(rank, f"k1 long, k2 long, ids array<{kind}>, score double")
    # the best k + 1 vectors of each distinct query hold its k nearest rows, whatever ids they have
    once = near.groupBy("k1", "k2", "ids").agg(F.max("score").alias("score"))
    order = F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.desc("score"), F.get("ids", F.lit(0))))
    kept = once.withColumn("n", order).where(F.col("n") <= k + 1)
    pairs = asked.join(kept, ["k1", "k2"]).select(F.col("id").alias("query_id"), F.explode("ids").alias("id"), "score").where("id != query_id")
    pairs = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
