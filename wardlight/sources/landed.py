"""Reading landed feed files and picking records out of landed pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wardlight.functions.arrays import bound


def envelope_schema(fields: Sequence[str]) -> T.StructType:
    """Schema of one feed response: its records, all text, and whether more remain."""
    record = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return T.StructType([T.StructField("queryResults", T.ArrayType(record)), T.StructField("hasResultsRemaining", T.BooleanType())])


def envelopes(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Landed JSON responses with their file and site (the file's folder)."""
    df = spark.read.schema(envelope_schema(fields)).json(path, multiLine=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    return df.select(name.alias("file"), F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("site"), "queryResults", "hasResultsRemaining")


def records(found: DataFrame, whole: bool = True) -> DataFrame:
    """Records of envelopes. A missing list, or (with ``whole``) a page with more to come, fails the job: it's never an empty set."""
    bad = F.when(F.col("queryResults").isNull(), "no queryResults in ")
    if whole:
        bad = bad.when(F.coalesce("hasResultsRemaining", F.lit(False)), "truncated page in ")
    checked = found.withColumn("queryResults", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, "file")).cast(found.schema["queryResults"].dataType)).otherwise(F.col("queryResults")))
    return checked.select("site", F.explode("queryResults").alias("r")).select("site", "r.*")


def site_status(found: DataFrame) -> DataFrame:
    """One row a site: rows, and ``ok``, ``structural error`` or ``truncated``, so one bad site doesn't stop others."""
    status = F.when(F.bool_or(F.col("queryResults").isNull()), "structural error").when(F.bool_or(F.coalesce("hasResultsRemaining", F.lit(False))), "truncated").otherwise("ok")
    return found.groupBy("site").agg(F.sum(F.coalesce(F.size("queryResults"), F.lit(0))).alias("n"), status.alias("status"))


def since(df: DataFrame, column: str, cursor: int, limit: int | None = None) -> DataFrame:
    """Rows beyond a cursor in order; with a limit one row more, which tells whether any are left."""
    rows = df.where(F.col(column) > cursor)
    return rows if limit is None else rows.orderBy(column).limit(limit + 1)


def with_columns_checked(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def in_list(df: DataFrame, ids: DataFrame, key: str, needed: Sequence[str] = ()) -> DataFrame:
    """Rows of given ids; the columns must be there."""
    return with_columns_checked(df, [key, *needed]).join(ids.select(key).distinct(), key, "left_semi")


def wide_csv(spark: SparkSession, path: str, columns: Sequence[str], keep: dict[str, Sequence[str] | DataFrame], header_rows: int = 2) -> DataFrame:
    """A CSV of fixed width with several header rows, kept by exact keys (a list, or a table with a column of that name); a row of another width fails the job.

    Header rows are skipped by the task that reads a file's first block, as they pass by: nothing is shuffled for them.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_bad"]])
    df = spark.read.schema(schema).csv(path, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE", quote='"', escape='"')
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    if header_rows:
        names = [*columns, "_bad"]

        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passed: dict[str, int] = {}  # a task reads a block from its start, a row after the other
            for batch in batches:
                kept = []
                for file, start in zip(batch.column("_file").to_pylist(), batch.column("_start").to_pylist(), strict=True):
                    seen = passed.get(file, 0) if start == 0 else header_rows
                    kept.append(seen >= header_rows)
                    if start == 0 and seen < header_rows:
                        passed[file] = seen + 1
                yield batch.select(names).filter(pa.array(kept, pa.bool_()))

        rows = rows.mapInArrow(body, schema)
    rows = rows.where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("wrong width: "), F.left("_bad", F.lit(80)))).cast("boolean")).otherwise(F.lit(True)))
    for column, values in keep.items():
        rows = rows.join(values.select(column).distinct(), column, "left_semi") if isinstance(values, DataFrame) else rows.where(F.col(column).isin(*values))
    return rows.select(*columns)


def meeting_files(events: DataFrame) -> DataFrame:
    """One row for each published file of each event; files without an id go."""
    rows = events.select("event_id", "event_date", "event_name", F.explode("publishedFiles").alias("f"))
    return rows.where("f.fileId is not null").select(F.col("f.fileId").alias("file_id"), F.col("f.type").alias("type"), F.col("f.name").alias("name"), F.col("f.publishOn").alias("publish_on"), "event_id", "event_date", "event_name")


def corpus_files(spark: SparkSession, path: str, pattern: str, excluded: Sequence[str]) -> DataFrame:
    """Text files below a folder, without those in excluded folders."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    for name in excluded:
        df = df.where(~F.col("file").contains(f"/{name}/"))
    return df


def _explode_groups(df: DataFrame, html: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """A row for each match of a pattern, with its groups as columns and its number ``n``."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(k)).alias(c) for k, c in enumerate(names, 1)]
    rest = [c for c in df.columns if c != html]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(*groups)).alias("n", "g"))
    return rows.select(*rest, "n", *[F.col(f"g.{c}").alias(c) for c in names])


def folder_listing(df: DataFrame, html: str = "html") -> DataFrame:
    """Entries of a directory page: date, time, size or ``<dir>``, link and name."""
    pattern = r'(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}:\d{2} [AP]M)\s+(&lt;dir&gt;|\d+)\s+<A HREF="([^"]*)">([^<]*)</A>'
    rows = _explode_groups(df, html, pattern, ["date", "time", "size", "href", "name"])
    return rows.withColumn("is_dir", F.col("size") == "&lt;dir&gt;").drop("size")


def report_links(df: DataFrame, html: str, base: str) -> tuple[DataFrame, DataFrame]:
    """Links to monthly reports, the first of each month by the month in the file's name, and links that name none."""
    links = _explode_groups(df, html, r'(?i)<a\b[^>]*?href="([^"]+)"', ["href"])
    url = F.replace("href", F.lit("&amp;"), F.lit("&"))
    url = F.when(url.rlike(r"^(?i:https?)://"), url).when(url.startswith("/"), F.concat(F.lit(base.rstrip("/")), url)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), url))
    named = F.regexp_extract(url, r"(\d{4})[-_](0[1-9]|1[0-2])", 0)
    rows = links.withColumn("url", url).withColumn("month", F.when(named != "", F.replace(named, F.lit("_"), F.lit("-"))))
    keys = [c for c in df.columns if c != html]
    first = F.row_number().over(W.partitionBy(*keys, "month").orderBy("n"))
    good = rows.where("month is not null").withColumn("_f", first).where("_f = 1").drop("_f")
    return good.drop("href"), rows.where("month is null").drop("href", "month")


def grid_rows(df: DataFrame, html: str, titles: Sequence[str]) -> DataFrame:
    """Records of a label and value grid: spans with a row in their id and a title, in either order of attributes."""
    ids = r'<span\b(?=[^>]*\bid="row_(\d+)_)(?=[^>]*\btitle="([^"]*)")[^>]*>([^<]*)</span>'
    cells = _explode_groups(df, html, ids, ["row", "title", "value"])
    keys = [c for c in df.columns if c != html]
    wide = cells.groupBy(*keys, F.col("row").cast("int").alias("row")).pivot("title", list(titles)).agg(F.first(F.trim("value")))
    return wide.where(F.coalesce(*[F.nullif(F.col(f"`{t}`"), F.lit("")) for t in titles]).isNotNull())


def labelled_blocks(df: DataFrame, text: str, anchor: str, labels: Sequence[str], tail: int = 2500) -> DataFrame:
    """Records of text blocks that start with an anchor label; values run to the next label; exactly doubled values count once.

    A block ends where the next one starts; the last has no next one and ends after ``tail`` characters, so that what follows
    the records doesn't run into it.
    """
    rest = [c for c in df.columns if c != text]
    blocks = bound(F.split(text, f"(?={anchor}:)"), lambda b: F.transform(b, lambda x, k: F.when(k == F.size(b) - 1, F.left(x, F.lit(tail))).otherwise(x)))
    rows = df.select(*rest, F.posexplode(blocks).alias("n", "block")).where(F.col("block").startswith(f"{anchor}:"))
    ends = "|".join(f"{x}:" for x in [anchor, *labels])

    def value(label: str) -> Column:
        raw = F.regexp_replace(F.regexp_extract("block", rf"(?s){label}:(.*?)(?:{ends}|$)", 1), r"^\s+|\s+$", "")
        return F.regexp_replace(raw, r"^(.+?)\s+\1$", "$1")

    return rows.select(*rest, "n", *[value(x).alias(x) for x in [anchor, *labels]])


def annual_blocks(df: DataFrame, html: str, anchor: str = "<h3>Annual") -> DataFrame:
    """Each annual block with its year and the sum of its amount inputs; null if it has none."""
    rest = [c for c in df.columns if c != html]
    rows = df.select(*rest, F.posexplode(F.split(html, f"(?={anchor})")).alias("n", "block")).where(F.col("block").startswith(anchor))
    amounts = F.transform(F.regexp_extract_all("block", F.lit(r'<input\b[^>]*\bvalue="([\d,]+(?:\.\d+)?)"'), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    total = F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x))
    return rows.select(*rest, F.regexp_extract("block", r"(\d{4})", 1).alias("year"), total.alias("total"))


def paged_union(pages: Sequence[DataFrame]) -> DataFrame:
    """Pages of one grid as one set of records, blank template rows and full repeats dropped."""
    found = pages[0]
    for p in pages[1:]:
        found = found.unionByName(p)
    filled = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in found.columns])
    return found.where(filled.isNotNull()).dropDuplicates()


def upcoming_rows(df: DataFrame) -> DataFrame:
    """Rows with a date that can be read and a title."""
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date")
    end = F.try_to_timestamp("end_date", F.lit("yyyy-MM-dd")).cast("date")
    return df.select(day.alias("date"), end.alias("end_date"), F.trim("title").alias("title")).where("date is not null and title <> ''")
