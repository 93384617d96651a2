"""How filters of a corpus interact, over every order in which they may be applied.

A document is reduced to the mask of the filters it fails, so an audit needs only counts by part and mask. Orders are
ranked lexicographically (Lehmer code). A document with mask m is removed at step s by the orders that begin with s - 1 filters
outside m and then one of m; orders with a common beginning are one interval of ranks, (filters - s)! long. Each mask's intervals
are thus known beforehand (``intervals``): their counts are added at the first rank and taken away behind the last, in one
array for each part and step, and a running sum over the ranks gives what each order removes at each step. What a step
keeps, and what failing documents an earlier step had taken already, follow from totals.

Everything is columns and aggregations in the JVM. A text gives one narrow row; labels join these by id; copies are found by
digest: rows are first summed by digest and part, with the sums of the rows of the smallest id beside, so a text that a third of
all rows share is a row for each part by then. The table of masks has at most 2^filters rows a part.

Cases: a null text is an empty one; a null part is the empty text; rows without an id are no copies of others and no
others are of them, and have no labels; rows of one id are no copies of each other; if labels name an id several times, one
row of quality or toxic 1 is enough; an empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NAMES = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> list[Column]:
    """The failure conditions of the first four filters: few words, few distinct words, many capitals, markup signs."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, SPACE)  # empty at an edge only
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    distinct = F.size(F.array_remove(F.array_distinct(parts), ""))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame, filters: list[Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good`` and ``toxic``: documents by part and failed filters; the last filter is that on copies of a smaller id's text."""
    bits = sum((F.coalesce(f, F.lit(False)).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{part_col}`"], F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic")
    )
    marked = rows.join(flags, F.col("id") == F.col("of"), "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("good", "toxic")})
    # rows of one id and text are summed where the join has put them
    alike = marked.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    three = ("n", "good", "toxic")
    by_part = alike.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in three],
        *[F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_free") for c in three],
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", *three))).alias("first"),
    )
    leads = F.coalesce(F.col("first.id") == F.min("first.id").over(W.partitionBy("digest")), F.lit(False))  # a row for each part
    stays = {c: F.col(f"{c}_free") + F.when(leads, F.col(f"first.{c}")).otherwise(0) for c in three}
    last = 1 << len(filters)
    kinds = by_part.select("part", "mask", *[v.alias(f"{c}_stays") for c, v in stays.items()], *three)
    both = kinds.select(
        "part",
        F.explode(
            F.array(
                F.struct(F.col("mask").alias("mask"), *[F.col(f"{c}_stays").alias(c) for c in three]),
                F.struct((F.col("mask") + last).alias("mask"), *[(F.col(c) - F.col(f"{c}_stays")).alias(c) for c in three]),
            )
        ).alias("k"),
    )
    return both.groupBy("part", "k.mask").agg(*[F.sum(f"k.{c}").alias(c) for c in three])


def orders(spark: SparkSession, names: str = NAMES) -> DataFrame:
    """``rank``, ``filter_order``, ``step`` and ``bit`` (number of the step's filter) of every order."""
    rows = [(rank, "".join(names[k] for k in p), step + 1, p[step]) for rank, p in enumerate(permutations(range(len(names)))) for step in range(len(names))]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, bit int")


def lehmer_rank(beginning: tuple[int, ...], filters: int) -> int:
    """Rank of the first order that begins so."""
    rank, left = 0, list(range(filters))
    for k, f in enumerate(beginning):
        at = left.index(f)
        rank += at * factorial(filters - 1 - k)
        del left[at]
    return rank


def removal_intervals(mask: int, filters: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of the orders that remove a document of ``mask`` at that step."""
    members = [f for f in range(filters) if mask >> f & 1]
    others = [f for f in range(filters) if not mask >> f & 1]
    found = []
    for before in range(len(others) + 1) if members else ():
        for chosen in combinations(others, before):
            for front in permutations(chosen):
                for f in members:
                    at = lehmer_rank((*front, f), filters)
                    found.append((before + 1, at, at + factorial(filters - before - 1)))
    return found


def intervals(spark: SparkSession, filters: int) -> DataFrame:
    """``of`` (mask), ``step``, ``at`` (rank) and ``sign``: where each mask's counts are added and taken away; touching intervals are one."""
    rows = []
    for mask in range(1, 1 << filters):
        edges: dict[tuple[int, int], int] = {}
        for step, begin, end in removal_intervals(mask, filters):
            for at, sign in ((begin, 1), (end, -1)):
                edges[step, at] = edges.get((step, at), 0) + sign
        rows += [(mask, step, at, sign) for (step, at), sign in edges.items() if sign]
    return spark.createDataFrame(rows, "of int, step int, at int, sign int")


def audit(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """``part``, ``filter_order`` and ``step`` with the step's totals, from rows of ``masked``; 600 rows a part for five filters."""
    spark, filters = counts.sparkSession, len(names)
    three = ("n", "good", "toxic")
    has = [(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0) for k in range(filters)]
    per_filter = F.array(
        *[
            F.struct(
                F.lit(k).alias("bit"),
                F.sum(F.when(has[k], F.col("n")).otherwise(0)).alias("fails"),
                F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)).alias("unique_fails"),
                F.sum(F.when(has[k], F.col("n") * F.lit(factorial(filters)) / F.bit_count("mask")).otherwise(0)).cast("long").alias("shapley"),
            )
            for k in range(filters)
        ]
    )
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), per_filter.alias("by_filter"))
    grid = parts.select("part", "total", F.explode("by_filter").alias("f")).select("part", "total", "f.*").join(F.broadcast(orders(spark, names)), "bit")

    edges = counts.where("mask > 0").join(F.broadcast(intervals(spark, filters)), F.col("mask") == F.col("of"))
    jumps = edges.groupBy("part", "step", F.col("at").alias("rank")).agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in three])
    along = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    here = {new: F.coalesce(F.sum(c).over(along), F.lit(0).cast("long")) for c, new in zip(three, ("removed", "good_lost", "toxic_lost"), strict=True)}
    table = grid.join(jumps, ["part", "step", "rank"], "left").withColumns(here)
    so_far = F.sum("removed").over(W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return table.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - so_far).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E on documents by ``lang``."""
    return audit(masked(docs, labels, text_filters(docs["text"])))


ORACLE_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS f
  FROM words JOIN firsts USING (t) LEFT JOIN flags USING (doc_id)),
kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, f, n, good, toxic,
    (SELECT min(instr(filter_order, l.x)) FROM letters l WHERE contains(f, l.x)) AS gone
  FROM kinds, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
totals AS (
  SELECT part, filter_order, step::INT AS step,
    sum(CASE WHEN gone <= step THEN 0 ELSE n END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(f, x) AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN f = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, any_value(x) AS x
  FROM steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM totals
"""
