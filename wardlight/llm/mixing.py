"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words by weight.
No target passes ``most`` times its source's words; what is over is shared again by weight, which
settles at one level: the largest ``(words - caps of the first k) / (weights of the rest)`` over
sources ordered by cap to weight. Complete epochs of a source come first. The rest of its target is
a sample without replacement: each document draws the exponential key ``-ln(u) / quality``, and
documents in key order are taken while the middle of the document lies within the budget.

Texts are read once: sizes and keys are written beside the columns to keep. The prefix sums don't gather a
source: the numbers alone are dealt by Spark's range partitioning (edges are quantiles that it samples) into
buckets of about ``per_bucket`` rows in key order, bucket totals give offsets, and only a bucket is sorted in
one task. Middles rise in key order, so what is taken of a source is all up to one last document; the table is
then read once against that document's place and moves nowhere. ``u`` comes from an MD5 of seed, source and id,
so reruns agree.

Cases: null and empty texts have size 0 and take 0; repeated rows tie in everything and are told apart by
their places in the written table, so many of them still fall into many buckets; a source without words has
target 0; an empty table gives no rows; extra columns of any name pass through (``size``, ``source_size``,
``target``, ``copies`` and ``taken`` are replaced). Two tables are ordered by fewer tasks than there are executors:
that of sources (a row each, in one task) and each source's bucket totals (a row for ``per_bucket`` documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.sources.tables import written

WORD = r"[^\x20\x09-\x0D]+"
JUNK = r"[0-9#$%&*@!|<>{}\\]"
WEIGHTS = (5, 2, 1)
#: Sources up to which their table (a row each) is broadcast.
FEW = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Between 0 and 1: falls with the share of digits and symbols."""
    share = F.regexp_count(text, F.lit(JUNK)).cast("double") / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(1.0 / (1.0 + 20.0 * share), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source``, its place in order ``nth``, ``source_size`` and ``rows``, with the ``target`` of each source."""
    table = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights)).cast("int") + 1).cast("double"))
    cap = (most * F.col("source_size")).cast("double")
    table = table.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = W.orderBy("ratio", "nth")
    before = whole.rowsBetween(W.unboundedPreceding, -1)
    rest = whole.rowsBetween(0, W.unboundedFollowing)
    words = F.sum("source_size").over(W.partitionBy()).cast("double")
    level = (words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    table = table.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    return table.select("source", "nth", "source_size", "rows", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    seed: int = 17,
    per_bucket: int = 262_144,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``keep`` columns of ``docs`` (by default all) with ``size``, ``source_size``, ``target``, ``copies`` (times taken whole) and ``taken`` (words)."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "copies", "taken")]
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(source_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (drawn.cast("double") + 0.5) / float(2**52)
    quality = text_quality(F.col(text_col)) if quality is None else quality
    base = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(f"_{k}") for k, c in enumerate(names)], F.lit(0).alias("_")).alias("row"),
        F.col(source_col).alias("source"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        (-F.log(u) / quality).alias("key"),
    )
    base = written(base, "mix-rows")
    base = base.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("tie"))
    plan = written(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))), "mix-plan")
    counts = plan.agg(F.count("*").alias("sources"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()

    def planned(df: DataFrame, plan: DataFrame) -> DataFrame:
        """Rows with their source's plan: broadcast up to ``FEW`` sources, else a join, which adaptive execution splits."""
        plan = plan.withColumnRenamed("source", "of")
        return df.join(F.broadcast(plan) if counts.sources <= FEW else plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    numbers = planned(base.select("source", "id", "size", "key", "tie"), plan.select("source", "nth")).drop("source")
    parts = max(1, -(-counts.rows // per_bucket))
    order = ["key", "id", "size", "tie"]
    placed = written(numbers.repartitionByRange(parts, "nth", *order).withColumn("bucket", F.spark_partition_id()), "mix-order")
    earlier = W.partitionBy("nth").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("nth", "bucket").agg(F.sum("size").alias("words"))
    offsets = totals.select("nth", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    within = W.partitionBy("nth", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    budgets = plan.select("nth", "left")
    ranked = placed.join(offsets, ["nth", "bucket"]).withColumn("before", before).where("size > 0")
    ranked = ranked.join(F.broadcast(budgets) if counts.sources <= FEW else budgets, "nth")
    last = ranked.where(2 * F.col("before") + F.col("size") <= 2 * F.col("left")).groupBy("nth").agg(F.max(F.struct(*order)).alias("last"))
    cuts = written(plan.join(last, "nth", "left").select("source", "source_size", "target", "epochs", "last"), "mix-cuts")

    picked = (F.col("size") > 0) & F.coalesce(F.struct(*order) <= F.col("last"), F.lit(False))
    rows = planned(base, cuts).withColumn("copies", F.col("epochs") + picked.cast("long"))
    return rows.select(*[F.col("row")[f"_{k}"].alias(c) for k, c in enumerate(names)], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln(((('0x' || substr(md5('17|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
    / coalesce(1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (len(regexp_extract_all(text, '[0-9#$%&*@!|<>{}\\]'))::DOUBLE / greatest(length(text), 1))), 1.0) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
plan AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
rows AS (
  SELECT b.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS epochs,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows
"""
