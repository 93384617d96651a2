import html
import random
import re
import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from wardlight.functions import scalars as S
from wardlight.operators import corpus as c
from wardlight.operators.ranking import placed


def one(spark, column, **values):
    shape = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], shape).select(column.alias("x")).first().x


def test_hits_near_negatives_are_dropped(spark):
    text = "The settlement sank. " + "y" * 60 + " legal settlement agreement " + "z" * 60 + " Settlement SETTLEMENT of pipes"
    pages = spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, "")], "doc int, page int, text string")
    terms = [c.Term("settlement", r"\bsettlement\b", r"legal settlement|settlement agreement|settlement of")]
    got = [(r.pos, r.label) for r in c.term_hits(pages, terms).collect()]
    want = []
    for m in re.finditer(r"\bsettlement\b", text, re.I):
        if not re.search(terms[0].negative, text[max(0, m.start() - 45) : m.end() + 45], re.I):
            want.append((m.start() + 1, "settlement"))
    assert got == want and len(want) == 1


def test_same_snippets_count_once(spark):
    pages = spark.createDataFrame([(1, p, "a leak was found here") for p in range(3)] + [(2, 0, "A LEAK was found here")], "doc int, page int, text string")
    hits = c.term_hits(pages, [c.Term("leak", "leak"), c.Term("found", "found")])
    assert sorted((r.doc, r.page, r.label) for r in hits.collect()) == [(1, 0, "found"), (1, 0, "leak"), (2, 0, "found"), (2, 0, "leak")]
    assert {r.doc: r.labels for r in c.histogram(hits).collect()} == {1: "found×1, leak×1", 2: "found×1, leak×1"}


def test_windows_of_large_documents(spark):
    hit = {3, 7, 11, 19, 27, 30, 31, 32, 33, 34, 35, 36}
    rows = [(1, p, "Leachate level" if p in hit else "nothing") for p in range(1, 51)] + [(2, p, "x") for p in range(1, 4)]
    got = c.keyword_window(spark.createDataFrame(rows, "doc int, page int, text string")).collect()
    assert sorted(r.page for r in got if r.doc == 1) == [1, *sorted(hit)[:10]]
    assert [r.windowed for r in got if r.doc == 2] == [False] * 3


def test_triage(spark):
    pages = {1: [(5, 1)] * 3, 2: [(200, 0)] * 20, 3: [(120, 0), (5, 1), (3, 1), (3, 1)], 4: [(0, 0)]}
    rows = [(d, k, n, i) for d, ps in pages.items() for k, (n, i) in enumerate(ps)]
    got = {r.doc: r.verdict for r in c.triage(spark.createDataFrame(rows, "doc int, page int, n_chars int, n_images int")).collect()}
    assert got == {1: "needs_ocr", 2: "has_text", 3: "likely", 4: "empty"}


def test_privacy_scan_fails_closed(spark):
    docs = spark.createDataFrame([(1, "About JANE Doe"), (2, "clean"), (3, None)], "doc int, text string")
    terms = spark.createDataFrame([("jane doe",), (" ",)], "term string")
    got = {r.doc: r.verdict for r in c.privacy_scan(docs, terms, F.col("text").isNull()).collect()}
    assert got == {1: "blocked", 2: "clear", 3: "blocked unread"}
    with pytest.raises(ValueError):
        c.privacy_scan(docs, terms.where("term = ' '"), F.lit(False))


def test_many_terms_and_exempt_rows(spark):
    docs = spark.createDataFrame([(k, f"text with code{k:04d} inside") for k in range(300)] + [(999, "code0001 code0002 code0001")], "doc int, text string")
    terms = spark.createDataFrame([(f"CODE{k:04d} inside",) for k in range(200)] + [("code0001",), ("Code0001",)], "term string")
    got = {r.doc: (r.n_terms, r.verdict) for r in c.privacy_scan(docs, terms, F.lit(False), F.col("doc") == 5, chunk=40).collect()}
    assert got[1] == (3, "blocked") and got[5] == (1, "exempt") and got[199] == (1, "blocked") and got[200] == (0, "clear") and got[999] == (2, "blocked")


def test_many_hits_in_one_page_end_soon(spark):
    text = "".join(f"line {k} leak here, " for k in range(20_000))
    pages = spark.createDataFrame([(1, 0, text)], "doc int, page int, text string")
    began = time.time()
    got = c.term_hits(pages, [c.Term("leak", "leak")]).agg(F.min("pos"), F.max("pos"), F.count("*")).first()
    assert time.time() - began < 30
    assert (got[0], got[1]) == (text.index("leak") + 1, text.rindex("leak") + 1) and got[2] > 10_000


def test_places_equal_a_sort(spark):
    rows = [(k % 3, k * 7919 % 101, k) for k in range(500)]
    got = placed(spark.createDataFrame(rows, "tier int, n int, doc int").repartition(5), ["tier"], [F.desc("n"), F.col("doc")], per_bucket=40).collect()
    for t in range(3):
        want = sorted((r for r in rows if r[0] == t), key=lambda r: (-r[1], r[2]))
        assert [(r.tier, r.n, r.doc) for r in sorted((r for r in got if r.tier == t), key=lambda r: r.place)] == want


def test_page_versions(spark):
    rows = [(1, "u", '<article><p>Long enough text to be taken as a page.</p><a href="/b?x=1">b</a><a href="/a">a</a></article>'), (2, "u", "<div>no region</div>"), (3, "u", "<main>short</main>")]
    got = {r.page_id: r for r in c.page_version(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1].lines == ["Long enough text to be taken as a page.", "b a"] and got[1].links == ["/a", "/b"]
    assert (got[1].status, got[2].status, got[3].status) == ("ok", "reject", "reject")


def test_main_region_ends_at_its_own_end(spark):
    page = "<main class=x><article>%s</article><p>after the article%s</p><img src=\"%s\"><div style=\"background:url('/b.png?v=2')\"></div></main><p>outside</p>"
    text = "Long enough text to be taken as a page."
    rows = [(1, "u", page % (text, "", "/doc.pdf#p")), (2, "u", page % (text, " changed", "/doc.pdf")), (3, "u", page % (text, "", "/other.pdf"))]
    got = {r.page_id: r for r in c.page_version(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1].lines == [text, "after the article"] and got[1].links == ["/b.png", "/doc.pdf"]
    assert len({r.hash for r in got.values()}) == 3
    odd = [
        ("<main>a<!-- </main> x --><p>b</p></main>", ["a<!--"]),  # the region ends at the first end tag, in a comment too
        ("<article>a<script>var t = '<!--';</script>b<!-- c --> d</article>", ["a b d"]),
        ("<main>a&nbsp;</p> &nbsp;b &nbsp; c&#10;d\te</main>", ["a", "b \xa0 c", "d e"]),
        ("<MAIN id='m'>x<style>p{}</style>y</MAIN>", ["x y"]),
        ('<main><a HREF = "/a?b">t</a><a href="">u</a><i src="#x">v</i><b style="background: URL(x.png)">w</b></main>', ["t u v w"]),
        (None, None),
        ("", []),
    ]
    rows = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(odd)], "k int, html string").withColumn("r", c.region(F.col("html")))
    got = {r.k: r for r in rows.select("k", c.visible_lines(F.col("r")).alias("lines"), c.link_targets(F.col("r")).alias("links")).collect()}
    assert [got[k].lines or [] for k in range(len(odd))] == [want or [] for _, want in odd]
    assert got[4].links == ["/a", "x.png"]


def test_references_equal_the_standard_library(spark):
    rng = random.Random(9)
    some = ["&", "&&", "&amp", "&amp;lt;", "&ltx", "&notit;", "&notin;", "&NotEqualTilde;", "&unknown;", "&#", "&#;", "&#x;", "&#xg", "&#38;#38;", "&#0;", "&#x0D;", "&#128;", "&#129;", "&#x9f;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#xfffffffffffffffff;", "&#11;", "&#7", "&#xFDD0;", "&#x1FFFE;", "&#x1F600;", "&#0000065;", "&#x0000000041 ", "&acE;", "&copycopy;", "& amp;", "&\tlt;", "&aacute", "&Aacutex", "a&b", "&fjlig;", "&bne;x", "é&eacute;é"]
    texts = some + ["".join(rng.choices([*some, "x", ";", " ", "#", "1"], k=6)) for _ in range(400)] + [f"&{n}" for n in html5] + [f"&#{n};&#x{n:x}z" for n in range(0, 300)]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4).orderBy("k").select(S.unescaped("t")).collect()]
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != html.unescape(t)] == []
    assert one(spark, S.unescaped("t"), t=None) is None


def test_one_pass_over_all_default_terms(spark):
    """Hits as a search of each term over the page gives them, the phrases that may not stand near them too."""
    rng = random.Random(5)
    words = ["boiler", "boils", "boiling", "point", "legal", "settlement", "of", "agreement", "steam", "turbine", "steams", "fuming", "leachate", "outbreak", "seeping", "TS-01", "ts 01", "landslide", "sink hole", "caved-in", "air bubble", "bubbling", "plain", "words", "here", "\n"]
    rows = [(d, p, " ".join(rng.choices(words, k=rng.choice([0, 3, 40])))) for d in range(30) for p in range(4)] + [(99, 0, None)]
    want = set()
    for t in c.DEFAULT_TERMS:
        seen = set()
        for d, p, text in rows:
            for m in re.finditer(t.positive, text or "", re.I):
                if t.negative and re.search(t.negative, text[max(0, m.start() - 45) : m.end() + 45], re.I):
                    continue
                snippet = " ".join(text[max(0, m.start() - 130) : m.end() + 130].split())
                if (d, snippet[:70].lower()) not in seen:
                    seen.add((d, snippet[:70].lower()))
                    want.add((d, p, t.label, m.start() + 1, snippet))
    df = c.term_hits(spark.createDataFrame(rows, "doc int, page int, text string").repartition(3), c.DEFAULT_TERMS)
    assert {(r.doc, r.page, r.label, r.pos, r.snippet) for r in df.collect()} == want and len({w[2] for w in want}) > 6


def test_pages_are_read_once_for_all_terms(spark, tmp_path):
    spark.createDataFrame([(1, 1, "it boils")], "doc int, page int, text string").write.parquet(str(tmp_path / "p"))
    plan = c.term_hits(spark.read.parquet(str(tmp_path / "p")), c.DEFAULT_TERMS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_marks_are_found_at_any_byte(spark):
    for lead in (b"\x02\x55\x04\x44\x60\x00", b"\x12\x55\x04\x44\x60", b"", b"\xff" * 1020):
        assert spark.createDataFrame([(bytearray(lead + b"%PDF-1.4"),)], "t binary").select(S.sniffed("t")).first()[0] == "pdf"
    assert spark.createDataFrame([(bytearray(b"\xfe" * 1021 + b"%PDF-1.4"),)], "t binary").select(S.sniffed("t")).first()[0] == "unknown"


def test_ids_and_context(spark):
    pages = spark.createDataFrame([(1, "Wells of Interest: AHW12* and AHW13"), (2, "AHW99 elsewhere")], "doc int, text string")
    assert {r.id for r in c.harvested_ids(pages, "wells of interest", r"AHW\d+\*?").collect()} == {"AHW12", "AHW13"}
    ids = spark.createDataFrame([("AHW12",), ("AHW1",)], "id string")
    assert [(r.doc, r.id) for r in c.whole_word_context(pages, ids).collect()] == [(1, "AHW12")]


@pytest.mark.parametrize(
    "text,want",
    [("2024-02-03T23:00:00-0500", "2024-02-03"), ("02/03/2024", "2024-02-03"), ("2/3/2024 8:00", "2024-02-03"), ("2024-02-30", ""), ("", ""), (None, ""), ("March 5, 2024", "2024-03-05")],
)
def test_dates(spark, text, want):
    assert one(spark, S.iso_date("t"), t=text) == want


def test_titles(spark):
    assert one(spark, S.without_trailing_date("t"), t="Report (3/4/2024) ") == "Report"
    assert one(spark, S.without_trailing_date("t"), t="Report (3/4/2024) b") == "Report (3/4/2024) b"
    began = time.time()
    assert one(spark, S.without_trailing_date("t"), t="x" + " " * 100_000 + "y") is not None
    assert time.time() - began < 20


def test_links_and_text(spark):
    assert one(spark, S.last_segment("u"), u="https://a.b/c/77/?q=1#z") == "77"
    assert one(spark, S.safe_link("u"), u="javascript:alert(1)") == "" and one(spark, S.safe_link("u"), u="HTTPS://x") == "HTTPS://x"
    assert one(spark, S.escaped("u"), u="<a&'b\">") == "&lt;a&amp;&#x27;b&quot;&gt;"
    assert one(spark, S.max_temperature_f("u"), u="read 180°F, then 95 deg F, in 2020, 9999 F, 30 f") == 180
    assert one(spark, S.max_temperature_f("u"), u="no heat") is None
    assert one(spark, S.us_date_to_iso("u"), u="3/7/2024") == "2024-03-07" and one(spark, S.us_date_to_iso("u"), u="soon") == "soon"
    assert one(spark, S.first_filled("a", "b"), a=" ", b="x") == "x"
    assert one(spark, F.array_join(S.merged_lists(F.split("a", ","), F.split("b", ",")), ","), a="x,y", b="y,z") == "x,y,z"
    assert one(spark, S.compact_number(F.col("a").cast("double")), a="72.0") == "72" and one(spark, S.compact_number(F.col("a").cast("double")), a="3.5") == "3.5"


@pytest.mark.parametrize("body,kind", [(b"%PDF-1.4", "pdf"), (b"junk%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"\x1f\x8b\x08", "gzip"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole2"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"", "unknown"), (b"hello", "unknown")])
def test_sniffing(spark, body, kind):
    assert spark.createDataFrame([(bytearray(body),)], "b binary").select(S.sniffed("b")).first()[0] == kind


@pytest.mark.parametrize(
    "text,labels",
    [
        ("A sinkhole opened; the cover subsided near TS-01.", {"cave-in", "subsidence", "TS-01"}),
        ("Leachate seeping from the north slope after slumping", {"leachate outbreak/seep", "slope failure"}),
        ("seeps of dark leachate", {"leachate outbreak/seep"}),
        ("The settlement agreement was signed", set()),
        ("differential settlement of the cap", set()),
        ("differential settlement along the cap", {"settlement"}),
        ("the boiling point of water; a boiler", set()),
        ("liquid was bubbling and steaming", {"boiling/bubbling", "fuming/steaming"}),
        ("Subsurface oxidation with elevated temperatures", {"elevated temperature"}),
        ("leachate levels were normal", set()),
    ],
)
def test_default_terms(spark, text, labels):
    pages = spark.createDataFrame([(1, 0, text)], "doc int, page int, text string")
    assert {r.label for r in c.term_hits(pages, c.DEFAULT_TERMS).collect()} == labels
