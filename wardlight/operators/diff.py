"""Comparing snapshots: multisets, keyed rows, digests, logs of hashes and sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(*columns: str) -> Column:
    """Columns as a JSON list of texts, nulls as empty ones, so that equal records give equal digests and no two others the same text."""
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def digest(*columns: str, length: int = 12) -> Column:
    return F.substring(F.sha2(canonical(*columns), 256), 1, length)


def counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Run-length form of a multiset: each distinct record with its count ``n``."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def multiset_diff(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Records whose counts differ, with ``n_old``, ``n_new``, ``added`` and ``removed``.

    Both sides are tagged and counted in one aggregation, so records meet in one shuffle and
    nulls compare as values. Repeated records count as often as they stand.
    """
    side = [d.select(*columns, F.lit(n).alias("_side")) for d, n in ((old, 0), (new, 1))]
    sums = side[0].unionByName(side[1]).groupBy(*columns).agg(F.count_if(F.col("_side") == 0).alias("n_old"), F.count_if(F.col("_side") == 1).alias("n_new"))
    return sums.where("n_old <> n_new").withColumns({"added": F.greatest(F.col("n_new") - F.col("n_old"), F.lit(0)), "removed": F.greatest(F.col("n_old") - F.col("n_new"), F.lit(0))})


def headline(diff: DataFrame, old: DataFrame, new: DataFrame, site: str) -> DataFrame:
    """Per site: totals on both sides, what was added and removed, and which case it is."""
    totals = old.groupBy(site).agg(F.count("*").alias("total_old"), F.lit(0).cast("long").alias("total_new"))
    totals = totals.unionByName(new.groupBy(site).agg(F.lit(0).cast("long").alias("total_old"), F.count("*").alias("total_new")))
    totals = totals.groupBy(site).agg(F.sum("total_old").alias("total_old"), F.sum("total_new").alias("total_new"))
    moved = diff.groupBy(site).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    case = F.when((F.col("total_old") == 0) & (F.col("total_new") > 0), "first records").when((F.col("total_old") > 0) & (F.col("total_new") == 0), "all records gone")
    case = case.when((F.col("added") == 0) & (F.col("removed") == 0), "unchanged").otherwise("changed")
    both = totals.join(moved, site, "left").fillna(0, ["added", "removed"])
    return both.withColumn("headline", case)


def duplicate_keys(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` group: rows, distinct keys and whether a keyed diff is illegal."""
    per_key = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count("*").alias("_n"))
    sums = per_key.groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys"))
    return sums.withColumn("has_duplicates", F.col("n_rows") > F.col("n_keys"))


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``change`` NEW, REMOVED or CHANGED by key, with the fields that changed as ``f: old -> new``; a null key is a key like any other."""
    a = old.select(F.struct(*keys).alias("_a"), F.struct(*fields).alias("_old"))
    b = new.select(F.struct(*keys).alias("_b"), F.struct(*fields).alias("_new"))
    same = reduce(and_, [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in keys])
    both = a.join(b, same, "full_outer").select(*[F.coalesce(f"_a.{k}", f"_b.{k}").alias(k) for k in keys], "_old", "_new")
    shown = F.array_compact(
        F.array(*[F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f"_old.{f}").cast("string"), F.lit("")), F.lit(" -> "), F.coalesce(F.col(f"_new.{f}").cast("string"), F.lit("")))) for f in fields])
    )
    change = F.when(F.col("_old").isNull(), "NEW").when(F.col("_new").isNull(), "REMOVED").when(F.size(shown) > 0, "CHANGED")
    details = F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.array_join(shown, "; ")).otherwise("")
    return both.select(*keys, change.alias("change"), details.alias("fields")).where("change is not null")


def digest_keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """As ``keyed_diff`` where only keys and row digests were stored."""
    a = old.select(*keys, digest(*fields).alias("d_old"))
    b = new.select(*keys, digest(*fields).alias("d_new"))
    both = a.join(b, list(keys), "full_outer").where(~F.col("d_old").eqNullSafe(F.col("d_new")))
    return both.withColumn("change", F.when(F.col("d_old").isNull(), "NEW").when(F.col("d_new").isNull(), "REMOVED").otherwise("CHANGED"))


def digest_multiset_diff(old: DataFrame, new: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Digests that appeared or disappeared, with how many more or fewer."""
    a, b = (d.select(*by, digest(*fields).alias("digest")) for d in (old, new))
    return multiset_diff(a, b, [*by, "digest"]).select(*by, "digest", (F.col("n_new") - F.col("n_old")).alias("delta"))


def latest_per_key(log: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key in an append-only log, by the append ordinal."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def identity_diff(seen: DataFrame, current: DataFrame, identity: Sequence[str], content: Sequence[str]) -> DataFrame:
    """New, changed and unchanged identities of ``current`` against ``seen``; gone ones are kept, never reported.

    An identity that stands more than once is judged by all its contents: their digests are added up as numbers, so no group is
    gathered and a change of any shows. ``collisions`` counts the rows beyond the first.
    """
    one = digest(*content)
    total = F.sum(F.conv(one, 16, 10).cast("decimal(38,0)")).cast("string")
    whole = F.when(F.count("*") == 1, F.min(one)).otherwise(F.substring(F.sha2(F.concat_ws("|", F.count("*"), total), 256), 1, 12))
    now = current.groupBy(*identity).agg(whole.alias("hash"), (F.count("*") - 1).alias("collisions"))
    old = seen.groupBy(*identity).agg(whole.alias("old_hash"))
    both = now.join(old, list(identity), "left")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "changed").otherwise("unchanged")
    return both.select(*identity, "hash", "collisions", state.alias("state"))


def carried(seen: DataFrame, current: DataFrame, identity: Sequence[str], hash_col: str = "hash") -> DataFrame:
    """The next seen table: old identities stay, current ones win."""
    old = seen.join(current, list(identity), "left_anti").select(*identity, hash_col)
    return old.unionByName(current.select(*identity, hash_col))


def hash_gate(current: DataFrame, log: DataFrame, keys: Sequence[str], order: str, hash_col: str = "hash") -> DataFrame:
    """``result`` baseline, changed or unchanged of each current hash against the last logged one."""
    last = latest_per_key(log, keys, order).select(*keys, F.col(hash_col).alias("last_hash"))
    both = current.join(last, list(keys), "left")
    return both.withColumn("result", F.when(F.col("last_hash").isNull(), "baseline").when(F.col("last_hash") != F.col(hash_col), "changed").otherwise("unchanged"))


def snapshot_hash(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A hash of each group's multiset that no order of rows changes.

    Counts of record digests are added up as numbers, so no group is gathered.
    """
    word = F.conv(F.substring(F.sha2(canonical(*columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = df.groupBy(*by).agg(F.sum(word).alias("_s"), F.count("*").alias("_n"))
    return sums.select(*by, F.substring(F.sha2(F.concat_ws("|", F.col("_n"), F.col("_s").cast("string")), 256), 1, 16).alias("hash"), F.col("_n").alias("n_rows"))


def set_diff(old: DataFrame, new: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Names that came or went within each group."""
    a, b = old.select(*by, name).distinct().withColumn("_o", F.lit(1)), new.select(*by, name).distinct().withColumn("_n", F.lit(1))
    both = a.join(b, [*by, name], "full_outer").where("_o is null or _n is null")
    return both.select(*by, name, F.when(F.col("_o").isNull(), "added").otherwise("removed").alias("change"))


def presence_flip(old: DataFrame, new: DataFrame, key: str, mentioned: str) -> DataFrame:
    """Keys whose mention appeared or disappeared; an absent key mentions nothing."""
    a, b = old.select(key, F.col(mentioned).alias("_o")), new.select(key, F.col(mentioned).alias("_n"))
    both = a.join(b, key, "full_outer").fillna(False, ["_o", "_n"]).where("_o <> _n")
    return both.select(key, F.when(F.col("_n"), "appeared").otherwise("disappeared").alias("change"))


def line_diff(old: DataFrame, new: DataFrame, key: str, lines: str, links: str) -> DataFrame:
    """Lines added and removed between two versions of each page (as multisets), or a change of links alone."""
    a = old.select(key, F.explode(lines).alias("line"))
    b = new.select(key, F.explode(lines).alias("line"))
    moved = multiset_diff(a, b, [key, "line"]).groupBy(key).agg(F.sum("added").alias("plus"), F.sum("removed").alias("minus"))
    linked = old.select(key, F.col(links).alias("_o")).join(new.select(key, F.col(links).alias("_n")), key)
    both = linked.join(moved, key, "left").fillna(0, ["plus", "minus"])
    change = F.when((F.col("plus") > 0) | (F.col("minus") > 0), "text").when(F.col("_o") != F.col("_n"), "links only").otherwise("unchanged")
    return both.select(key, "plus", "minus", change.alias("change"))


def nested_diff(old_parent: DataFrame, new_parent: DataFrame, old_child: DataFrame, new_child: DataFrame, key: str, fields: Sequence[str], child_key: str, child_fields: Sequence[str]) -> DataFrame:
    """Changes of parents with those of their child sets: state, field changes and children added, removed and edited."""
    parents = keyed_diff(old_parent, new_parent, [key], fields)
    kids = keyed_diff(old_child, new_child, [key, child_key], child_fields)
    kids = kids.groupBy(key).agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (("NEW", "files_added"), ("REMOVED", "files_removed"), ("CHANGED", "files_edited"))])
    both = parents.join(kids, key, "full_outer").fillna(0, ["files_added", "files_removed", "files_edited"])
    state = F.when(F.col("change") == "REMOVED", "GONE").when(F.col("change") == "NEW", "NEW").otherwise("CHANGED")
    return both.select(key, state.alias("state"), F.coalesce("fields", F.lit("")).alias("fields"), "files_added", "files_removed", "files_edited")
