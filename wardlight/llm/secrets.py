"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns give spans (code points, end exclusive): ``split`` leaves what stands between matches and
``regexp_extract_all`` the matches, so running lengths are their places. Both are evaluated once a text, and
running values are taken in parts, so time grows with the text, not with its hits' square. Each span's value is
hashed, and over the whole corpus a hash has a number of distinct owners and of distinct
repositories. A varied value with one owner, in any number of its repositories, looks live; one that many
owners hold is a copied example. Vendor-format tokens are added as spans only where they look
live; pattern spans always stay.

Counts are taken in steps, (value, owner, repository) then (value, owner) then (value), each with
partial sums before its shuffle, so that no value's rows meet in one task. Values leave the
first step as SHA-256 only.

A key file is its whole block, and its body is its value: a header alone is the same in all of them.

Cases: null and empty texts have no spans; repeated rows each get a row and count as one
repository; rows with a null id or owner count as the null one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.arrays import bound, in_parts, running
from wardlight.sources.tables import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run under the least length fails in every part of it, so the least may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KEY_LINE = r"-----%s [A-Z ]{0,20}PRIVATE KEY-----"
#: A key file from its first to its last line; without a last line as far as base64 goes; else the bare first line.
KEY = (
    KEY_LINE % "BEGIN" + r"(?:[^-]*(?:-[^-]+){0,12}" + KEY_LINE % "END"
    + r"|(?:[\s\\rn]{0,8}(?:Proc-Type|DEK-Info): ?[0-9A-Za-z,-]{1,80}){0,2}[\s\\rn]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\\\s]*|)"
)
#: What a key's digest leaves out: first and last line, white space and written-out line ends.
KEY_FRAME = KEY_LINE % "(?:BEGIN|END)" + r"|\s|\\[rn]"
#: Public token formats: code hosts, payment keys, chat tokens, map keys, signed web tokens, key files.
VENDOR = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|" + KEY
)
KINDS = ("assign", "access", "hex", "vendor")
SPAN = "array<struct<start:int,kind:int,stop:int,digest:string,varied:boolean>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of ``pattern`` in ``text``; for assignments the value is group 2, of 8 characters or more, for key files the body."""

    def part(gap: Column, hit: Column) -> Column:
        value = F.regexp_extract(hit, pattern, 2) if kind == 0 else F.regexp_replace(hit, KEY_FRAME, "") if kind == 3 else hit
        return F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("size"), value.alias("value"))

    def span(p: Column, before: Column) -> Column:
        return F.struct(
            (before + p["gap"]).alias("start"),
            F.lit(kind).alias("kind"),
            (before + p["gap"] + p["size"]).alias("stop"),
            F.sha2(p["value"], 256).alias("digest"),
            (F.size(F.array_distinct(F.split(p["value"], ""))) >= 8).alias("varied"),
        )

    def places(parts: Column) -> Column:
        found = F.zip_with(parts, running(F.transform(parts, lambda p: p["gap"] + p["size"]), lambda a, b: a + b), lambda p, before: F.when(p["size"] > 0, F.when(F.length(p["value"]) >= 8, span(p, before)) if kind == 0 else span(p, before)))
        return F.filter(found, lambda x: x.isNotNull()).cast(SPAN)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    some = bound(F.zip_with(F.split(text, pattern, -1), hits, part), places)
    return F.when(F.regexp_like(text, F.lit(pattern)), some).otherwise(F.array().cast(SPAN))


def candidate_spans(text: Column) -> Column:
    """All spans of a text by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(text, p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX, VENDOR))]))


def ownership(spans: DataFrame) -> DataFrame:
    """``digest`` with its distinct ``owners`` and ``repositories``, from rows of ``owner``, ``repository`` and ``spans``."""
    each = spans.select("owner", "repository", F.explode("spans").alias("s")).select("owner", "repository", "s.digest").distinct()
    by_owner = each.groupBy("digest", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None, owners: int = 1, repositories: int | None = None) -> DataFrame:
    """Per row: ``id_col``, ``owner``, ``text_key`` (hash of the text), ``spans`` (base spans, and vendor ones that look live) with ``live`` and ``copied`` in each.

    A value looks live with at most ``owners`` owners, in however many of their repositories (by default a repository is an
    id; ``repositories`` sets a bound); it is copied with more owners than that.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).alias("owner"),
        F.col(repository_col or id_col).alias("repository"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        candidate_spans(F.col(text_col)).alias("spans"),
    )
    rows = written(rows, "secret-spans")
    some = rows.where(F.size("spans") > 0)
    each = some.select("id", "owner", "text_key", F.explode("spans").alias("s")).select("id", "owner", "text_key", "s.*").distinct()
    seen = each.join(ownership(some), "digest")
    live = F.col("varied") & (F.col("owners") <= owners)
    if repositories is not None:
        live = live & (F.col("repositories") <= repositories)
    span = F.struct("start", "kind", "stop", live.alias("live"), (F.col("owners") > owners).alias("copied"))
    judged = seen.where((F.col("kind") < 3) | live).groupBy("id", "owner", "text_key").agg(F.sort_array(F.collect_list(span)).alias("judged"))
    judged = judged.select(F.col("id").alias("_id"), F.col("owner").alias("_owner"), F.col("text_key").alias("_key"), "judged")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("text_key") == F.col("_key"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean,copied:boolean>>")
    return rows.join(judged, same, "left").select(F.col("id").alias(id_col), "owner", "text_key", F.coalesce("judged", none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def counted(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest and listing of the spans of ``scan``."""

    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        id_col,
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
    )


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with what the ``spans`` (in order) cover put out by ``mark``, one mark for spans that overlap."""

    def shown(source: Column, item: Column, base: Column) -> Column:
        gap = item["start"] - item["low"]
        return F.when(gap >= 0, F.concat(F.substring(source, item["low"] - base + 1, gap), F.lit(mark))).otherwise("")

    def of_part(items: Column) -> Column:
        base, top = F.get(items, F.lit(0))["low"], F.array_max(F.transform(items, lambda i: F.greatest(i["low"], i["stop"])))
        part = bound(F.substring(text, base + 1, top - base), lambda source: F.array_join(F.transform(items, lambda i: shown(source, i, base)), ""))
        return F.struct(part.alias("out"), top.alias("top"))

    def whole(items: Column) -> Column:
        return bound(F.transform(in_parts(items), of_part), lambda parts: F.concat(F.array_join(F.transform(parts, lambda p: p["out"]), ""), F.substring(text, F.element_at(parts, -1)["top"] + 1, F.length(text))))

    low = running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
    items = F.zip_with(spans, low, lambda s, low: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), low.alias("low")))
    return F.when(F.size(spans) > 0, bound(items, whole)).otherwise(text)


def mask_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """``docs`` with the spans that look live masked in ``text_col``, in however many documents their one owner has them; all else stays."""
    live = F.filter("spans", lambda s: s["live"])
    found = scan(docs, id_col, text_col, owner_col).select(F.col(id_col).alias("_id"), F.col("owner").alias("_owner"), F.col("text_key").alias("_key"), live.alias("_live"))
    found = found.where(F.size("_live") > 0).distinct()
    rows = docs.select(F.struct("*").alias("_row"))  # so that no column of theirs clashes
    number, owner, text = (F.col("_row")[c] for c in (id_col, owner_col, text_col))
    same = number.eqNullSafe(F.col("_id")) & owner.eqNullSafe(F.col("_owner")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_key"))
    shown = F.when(F.col("_key").isNotNull(), masked(text, F.col("_live"))).otherwise(text)
    return rows.join(found, same, "left").select(*[shown.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def _kind_sql(kind: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract(hits[k + 1], '{quoted}', 2)" if kind == 0 else "hits[k + 1]"
    return f"""SELECT doc_id, source, {kind} AS kind, CAST(list_sum(gaps[1:k + 1]) + coalesce(list_sum(list_transform(hits[1:k], lambda x: length(x))), 0) AS INT) AS start, length(hits[k + 1]) AS size, {value} AS value
  FROM (SELECT *, unnest(range(len(hits))) AS k FROM (SELECT doc_id, source, regexp_extract_all(t, '{quoted}') AS hits, list_transform(string_split_regex(t, '{quoted}'), lambda x: length(x)) AS gaps FROM d) WHERE len(hits) > 0)"""


#: The SQL's own vendor formats: of a key file it has the header line alone.
SQL_VENDOR = VENDOR.removesuffix(KEY) + KEY_LINE % "BEGIN"
#: The query's rows in DuckDB SQL, for tables in which ids don't repeat and without key files.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_kind_sql(k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, SQL_VENDOR)))}),
spans AS (SELECT doc_id, source, kind, start, start + size AS stop, sha256(value) AS digest, len(list_distinct(string_split(value, ''))) >= 8 AS varied FROM raw WHERE kind > 0 OR length(value) >= 8),
own AS (SELECT digest, count(DISTINCT coalesce(source, chr(1))) AS owners FROM spans GROUP BY digest),
judged AS (SELECT s.*, varied AND owners <= 1 AS live, owners > 1 AS copied, ['assign', 'access', 'hex', 'vendor'][kind + 1] || ':' || start || ':' || stop AS shown FROM spans s JOIN own o ON s.digest = o.digest),
sums AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(shown, ',' ORDER BY start, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM judged WHERE kind < 3 OR live GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN sums s ON d.doc_id = s.doc_id"""
