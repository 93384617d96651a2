import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.sources import landed, sinks


def put(path, site, body):
    (path / site).mkdir(exist_ok=True)
    (path / site / "page.json").write_text(json.dumps(body))


def test_envelopes(spark, tmp_path):
    put(tmp_path, "s1", {"queryResults": [{"num": "1", "note": None}, {"num": "1", "note": "a\r\nb"}], "hasResultsRemaining": False})
    put(tmp_path, "s2", {"queryResults": [], "hasResultsRemaining": False})
    found = landed.envelopes(spark, str(tmp_path), ["num", "note"])
    assert sorted((r.site, r.num) for r in landed.records(found).collect()) == [("s1", "1"), ("s1", "1")]
    put(tmp_path, "s3", {"queryResults": [{"num": "2"}], "hasResultsRemaining": True})
    put(tmp_path, "s4", {"error": "x"})
    found = landed.envelopes(spark, str(tmp_path), ["num", "note"])
    assert {r.site: r.status for r in landed.site_status(found).collect()} == {"s1": "ok", "s2": "ok", "s3": "truncated", "s4": "structural error"}
    with pytest.raises(Exception, match="no queryResults|truncated page"):
        landed.records(found).collect()
    with pytest.raises(Exception, match="no queryResults"):
        landed.records(found.where("site <> 's3'"), whole=False).collect()


def test_cursor_and_lists(spark):
    df = spark.range(10).withColumnRenamed("id", "oid")
    assert [r.oid for r in landed.since(df, "oid", 4, 2).collect()] == [5, 6, 7]
    assert landed.in_list(df, df.where("oid < 3"), "oid").count() == 3
    with pytest.raises(ValueError, match="missing columns: gone"):
        landed.in_list(df, df, "oid", ["gone"])


def test_wide_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title,,\nsrn,task,note\nN1,"a, b",x\nN11,c,y\nN1,"a, b",x\n')
    got = landed.wide_csv(spark, str(tmp_path), ["srn", "task", "note"], {"srn": ["N1"]}).collect()
    assert [tuple(r) for r in got] == [("N1", "a, b", "x")] * 2
    (tmp_path / "b.csv").write_text("Title,,\nsrn,task,note\nN1,short\n")
    with pytest.raises(Exception, match="wrong width"):
        landed.wide_csv(spark, str(tmp_path), ["srn", "task", "note"], {"srn": ["N1"]}).collect()


def test_wide_csv_in_many_blocks_with_keys_of_a_table(spark, tmp_path):
    names = [f"c{k}" for k in range(22)]
    lines = [",".join(f"v{k * n % 7}" if k else f"N{n % 5}" for k in range(22)) for n in range(3000)]
    for f in range(2):
        (tmp_path / f"{f}.csv").write_text("\n".join(["Title" + "," * 21, ",".join(names), *lines[f::2]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        keys = spark.createDataFrame([("N1",), ("N4",), ("N4",), ("c0",), (None,)], "c0 string")
        df = landed.wide_csv(spark, str(tmp_path), names, {"c0": keys})
        got = sorted(",".join(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(x for x in lines if x.split(",")[0] in ("N1", "N4"))


def test_corpus_walk(spark, tmp_path):
    for d in ("a", "skip"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.txt").write_text(f"in {d}")
        (tmp_path / d / "x.csv").write_text("no")
    assert [r.text for r in landed.corpus_files(spark, str(tmp_path), "*.txt", ["skip"]).collect()] == ["in a"]


def test_records_out_of_pages(spark):
    page = '<span title="Name" id="row_1_a">A</span><span id="row_1_b" class="c" title="No"> 7 </span><span id="row_2_a" title="Name"></span><span id="row_2_b" title="No"> </span>'
    grid = landed.grid_rows(spark.createDataFrame([(1, page)], "page int, html string"), "html", ["Name", "No"]).collect()
    assert [(r.row, r.Name, r.No) for r in grid] == [(1, "A", "7")]
    text = "Evaluation: E1 E1 Type: CEI Date: 1/2/2024 Evaluation: E2 Type: Date: x y"
    got = landed.labelled_blocks(spark.createDataFrame([(1, text)], "page int, text string"), "text", "Evaluation", ["Type", "Date"]).collect()
    assert [(r.Evaluation, r.Type, r.Date) for r in got] == [("E1", "CEI", "1/2/2024"), ("E2", "", "x y")]
    html = '<h3>Annual 2022</h3><input value="1,000.5"><input value="2"><h3>Annual 2023</h3>none'
    years = landed.annual_blocks(spark.createDataFrame([(1, html)], "page int, html string"), "html").collect()
    assert [(r.year, r.total) for r in years] == [("2022", 1002.5), ("2023", None)]
    links = '<a href="r_2024-02.pdf">a</a><a class="x" href="/q/2024_02b.pdf?a=1&amp;b=2">b</a><a href="https://o.example/notes">c</a>'
    good, rest = landed.report_links(spark.createDataFrame([(1, links)], "page int, html string"), "html", "https://s.example/d")
    assert [(r.url, r.month) for r in good.collect()] == [("https://s.example/d/r_2024-02.pdf", "2024-02")] and [r.url for r in rest.collect()] == ["https://o.example/notes"]
    events = spark.createDataFrame([(1, "d", "n", [(None, "t", "x", "p"), (5, "t", "y", "p")])], "event_id int, event_date string, event_name string, publishedFiles array<struct<fileId:int,type:string,name:string,publishOn:string>>")
    assert [r.file_id for r in landed.meeting_files(events).collect()] == [5]
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), (" ", None)], "x string, y string")
    assert landed.paged_union([rows, rows]).count() == 1
    up = spark.createDataFrame([("2024-01-02", "bad", "t"), ("soon", None, "t"), ("2024-01-02", None, " ")], "date string, end_date string, title string")
    assert landed.upcoming_rows(up).count() == 1


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("note", T.StringType())])


def test_sinks(spark, tmp_path):
    path, other = str(tmp_path / "log"), str(tmp_path / "other")
    assert sinks.stored(spark, path, SCHEMA).count() == 0
    df = spark.createDataFrame([("a", 1, True), ("b", 2, True)], "note string, doc_id int, extra boolean")
    sinks.append(df, path, SCHEMA)
    sinks.append(df.drop("note"), path, SCHEMA)
    assert sorted((r.doc_id, str(r.note)) for r in sinks.stored(spark, path, SCHEMA).collect()) == [(1, "None"), (1, "a"), (2, "None"), (2, "b")]
    batched = T.StructType([*SCHEMA.fields, T.StructField("batch", T.StringType())])
    sinks.fan_out(df, "b1", [(df, other, batched), (df.where("doc_id = 1"), other, batched)])
    assert sinks.stored(spark, other, batched).where("batch = 'b1'").count() == 3
    sinks.purge(spark, [path], [SCHEMA], df.where("doc_id = 1"))
    assert {r.doc_id for r in sinks.stored(spark, path, SCHEMA).collect()} == {2}
    assert not (tmp_path / "log.next").exists() and not (tmp_path / "log.old").exists()
    (tmp_path / "log").rename(tmp_path / "log.old")  # as a run leaves it that broke off
    sinks.purge(spark, [path], [SCHEMA], df.where("doc_id = 1"))
    assert {r.doc_id for r in sinks.stored(spark, path, SCHEMA).collect()} == {2}
    rows = spark.createDataFrame([(k, 1 + k // 2) for k in range(9)], "rn int, page int")
    sinks.feed(rows, str(tmp_path / "feed"), per_folder=2)
    assert sorted(p.name for p in (tmp_path / "feed").iterdir() if p.is_dir()) == ["pages=0", "pages=1", "pages=2"]
    assert spark.read.parquet(str(tmp_path / "feed")).where("pages = 1 and page = 3").count() == 2
    table = str(tmp_path / "table")
    many = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("note"))
    assert sinks.publish(many, table, SCHEMA) and not sinks.publish(many.limit(89), table, SCHEMA) and sinks.publish(many.limit(90), table, SCHEMA)
    assert sinks.stored(spark, table, SCHEMA).count() == 90
    for _ in range(2):
        sinks.capture(df, str(tmp_path / "cap"), "2024-01-01", 9)
    assert spark.read.parquet(str(tmp_path / "cap")).count() == 2
