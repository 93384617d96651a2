"""The query's files grow with the table's size, not by one a row, and names come back as they are."""

import glob

from wardlight.plans import catalog
from wardlight.sources.tables import shared_dir


def test_corpus_files_lands_many_rows_a_file(spark, tmp_path):
    odd = ["ends in |", "|", "two\nlines\n", "\r\n", ' "quoted" \\n ', "", None, "ä{}[],", " spaced "]
    rows = [(k, odd[k // 2] if k < 2 * len(odd) else f"Supplier {k}") for k in range(2500)]
    spark.createDataFrame([*rows, (None, "no key")], "s_suppkey long, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables/landed-corpus-*"))
    got = [r.text for r in catalog.QUERIES["corpus_files"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([n for k, n in rows if k % 2 == 0], key=str)
    (path,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables/landed-corpus-*")) - before
    assert len(glob.glob(f"{path}/part=*/*.txt")) <= 6


def test_corpus_files_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    assert catalog.QUERIES["corpus_files"](spark, str(tmp_path)).columns == ["text"]
