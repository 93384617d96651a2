"""Several tables published together: files are written first, one renamed commit makes them all visible at once.

A ``Book`` is a folder with ``data`` (Parquet files by table) and ``log`` (a small JSON file for each commit: the batch and the files
that it adds to and takes from each table, or the files of a table's folded state). Readers take the files of the commits and
nothing else, so what a broken run has left is never seen; a batch that is published again changes nothing. A commit is renamed
into its number, which must be free: of two writers one fails and tries again. The driver holds the names of a table's files, as
Spark itself does to plan a scan; rows stay on the executors.

Cases: a table that no commit names is empty; an empty batch is a commit without files; a batch id is published once for all tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.sources.sinks import conform
from wardlight.sources.tables import exists, move, remove, text_of, write_text


class Taken(RuntimeError):
    """Another writer has made the next commit."""


class Book:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, number: int) -> str:
        return f"{self.path}/log/{number:08d}.json"

    def commits(self) -> list[dict]:
        """All commits in order."""
        found = []
        while exists(self.spark, place := self._place(len(found))):
            found.append(json.loads(text_of(self.spark, place)))
        return found

    def _commit(self, number: int, entry: dict) -> None:
        draft = f"{self.path}/log/draft-{uuid.uuid4().hex}"
        write_text(self.spark, draft, json.dumps(entry))
        if exists(self.spark, self._place(number)) or not move(self.spark, draft, self._place(number)):
            remove(self.spark, draft)
            raise Taken(self._place(number))

    def _written(self, df: DataFrame, table: str, label: str) -> list[str]:
        """``df`` as new files of a table that no commit names yet."""
        folder = f"{self.path}/data/{table}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self._files(self.spark.read.schema(df.schema).parquet(folder))

    @staticmethod
    def _files(df: DataFrame) -> list[str]:
        """Files that hold rows of ``df``."""
        return sorted(r.f for r in df.select(F.col("_metadata.file_path").alias("f")).distinct().collect())

    def publish(self, batch: str, targets: dict[str, tuple[DataFrame, T.StructType]]) -> bool:
        """One batch to several tables at once; False if it had been published before."""
        known = self.commits()
        if any(c.get("batch") == batch for c in known):
            return False
        self._commit(len(known), {"batch": batch, "add": {t: self._written(conform(df, schema), t, "batch") for t, (df, schema) in targets.items()}})
        return True

    def files(self, table: str) -> list[str]:
        """Files of a table as the commits have it."""
        now: dict[str, None] = {}
        for c in self.commits():
            for f in c.get("take", {}).get(table, []):
                now.pop(f, None)
            now |= dict.fromkeys(c.get("add", {}).get(table, []))
        return list(now)

    def _rows(self, files: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        return self._rows(self.files(table), schema)

    def purge_plan(self, tables: dict[str, T.StructType], ids: DataFrame, key: str = "doc_id") -> DataFrame:
        """What a purge would do: ``tab``, ``file`` and ``n``, the rows of ``ids`` in it."""
        wanted, found = ids.select(key).distinct(), None
        for table, schema in tables.items():
            if files := self.files(table):
                rows = self._rows(files, schema).select(key, F.col("_metadata.file_path").alias("file")).join(wanted, key, "left_semi")
                counts = rows.groupBy("file").agg(F.count("*").alias("n")).select(F.lit(table).alias("tab"), "file", "n")
                found = counts if found is None else found.unionByName(counts)
        return self.spark.createDataFrame([], "tab string, file string, n long") if found is None else found

    def purge(self, tables: dict[str, T.StructType], ids: DataFrame, key: str = "doc_id") -> int:
        """Takes the rows of ``ids`` from all tables in one commit; only files that hold such rows are written anew. The number of rows taken."""
        known = self.commits()
        hit = self.purge_plan(tables, ids, key).collect()  # a row for each file concerned
        if not hit:
            return 0
        entry: dict = {"batch": None, "take": {}, "add": {}}
        wanted = ids.select(key).distinct()
        for table in {r.tab for r in hit}:
            entry["take"][table] = sorted(r.file for r in hit if r.tab == table)
            entry["add"][table] = self._written(self._rows(entry["take"][table], tables[table]).join(wanted, key, "left_anti"), table, "purged")
        # folded states may hold the rows as well: they are made anew from the log
        self._commit(len(known), entry | {"unfold": sorted(entry["take"])})
        return sum(r.n for r in hit)

    def _folded(self, table: str) -> tuple[list[str], list[str]]:
        """Files of the newest folded state, and of the log behind it."""
        state, tail, since = [], [], False
        for c in self.commits():
            if table in c.get("fold", {}):
                state, tail, since = c["fold"][table], [], True
            if table in c.get("unfold", []):
                since = False
            tail += c.get("add", {}).get(table, [])
        return (state, tail) if since else ([], self.files(table))

    def folded(self, table: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``fold`` of the whole log, from its newest folded state and the files behind it.

        ``fold`` gives rows of the log's own shape, and folding what is folded already with more is folding all.
        """
        state, tail = self._folded(table)
        return conform(fold(self._rows(state + tail, schema)), schema)

    def compact(self, table: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Keeps the folded state as of now; the log stays."""
        known = self.commits()
        self._commit(len(known), {"batch": None, "fold": {table: self._written(self.folded(table, schema, fold), table, "folded")}})


def latest_by(*keys: str, order: str) -> Callable[[DataFrame], DataFrame]:
    """A fold: the row of each key with the largest ``order``; of equals the largest row."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, order)]
        best = F.max(F.struct(order, *rest)).alias("_row")
        return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)

    return fold
