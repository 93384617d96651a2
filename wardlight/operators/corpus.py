"""Text corpora: term search, triage, page windows, page versions and harvested ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardlight.functions import scalars as S
from wardlight.functions.arrays import match_places
from wardlight.operators.ranking import placed
from wardlight.sources.tables import written


@dataclass(frozen=True)
class Term:
    """A label with a pattern, and one that may not match near a hit."""

    label: str
    positive: str
    negative: str | None = None


# The terms searched for by default, each with what may not stand near a hit.
DEFAULT_TERMS = (
    Term("subsidence", r"\bsubsidence\b|\bsubsided\b|\bsubsiding\b"),
    Term("cave-in", r"\bcave[\s-]?ins?\b|\bcaved[\s-]?in\b|\bsink\s?holes?\b"),
    Term("mudslide", r"\bmud[\s-]?slides?\b|\blandslides?\b"),
    Term("settlement", r"\b(?:surface |differential )?settlement\b|\bsettling\b", r"legal settlement|settlement agreement|claim.{0,12}settlement|settlement of"),
    Term("slope failure", r"\bslope failure\b|\bsloughing\b|\bslumping\b"),
    Term(
        "leachate outbreak/seep",
        r"leachate (?:outbreak|seep\w*|breakout|pooling|ponding|bubbl\w+|flowing)"
        r"|(?:outbreak|seep\w*|breakout) [^.]{0,25}leachate"
        r"|surfac\w+ leachate|standing leachate|leachate on (?:the )?(?:cap|surface|deck|slope)",
    ),
    Term("boiling/bubbling", r"\bboil(?:s|ed|ing)?\b|\bbubbl(?:e|es|ed|ing)\b", r"boiler|boiling springs|boiling point|boiling range|boilerplate|air bubble"),
    Term("fuming/steaming", r"\bfum(?:e|es|ing|ed)\b|\bsteam(?:s|ed|ing)\b", r"steam turbine|steam generator|boiler.{0,12}steam|central steam|steam plant|steam radiation"),
    Term("elevated temperature", r"elevated temperatures?\b|thermal anomal\w+|subsurface (?:oxidation|fire|smolder\w+|reaction)|exotherm\w+|\bSET event\b|smolder\w+"),
    Term("TS-01", r"\bTS[\s\-_]?01\b|\bTSO1\b"),
)

# Words that mark a page of interest.
SIGNALS = (
    "hov", "higher operating value", "woi", "wells of interest", "well of interest", "subsurface oxidation", "smolder", "etlf", "elevated temperature",
    "carbon monoxide", "co spike", "exceedance", "temperature", "consent judgment", "2020-0593-ce", "mact", "leachate", "pfas",
)


def term_hits(pages: DataFrame, terms: Sequence[Term], near: int = 45, around: int = 130) -> DataFrame:
    """Hits of each term in each page whose ``near`` characters on both sides don't match its negative pattern.

    Pages are read once for all terms: one alternation of the patterns picks the pages with any of them, and each term is then looked for in
    these alone. Positions come from what stands between matches, so windows may overlap. Snippets that agree in
    their first 70 characters, lower-cased, count once for each document and label.
    """
    text = F.col("text")

    def spots(t: Term) -> Column:
        def spot(s: Column) -> Column:
            start = F.greatest(s["pos"] - near, F.lit(1))
            fine = ~F.substring(text, start, s["size"] + near + (s["pos"] - start)).rlike(f"(?i){t.negative}") if t.negative else F.lit(True)
            return F.when(fine, F.struct(F.lit(t.label).alias("label"), s["pos"].alias("pos"), s["size"].alias("size")))

        found = F.filter(F.transform(match_places(text, f"(?i){t.positive}"), spot), lambda x: x.isNotNull())
        return F.when(text.rlike(f"(?i){t.positive}"), found).otherwise(F.array().cast("array<struct<label:string,pos:int,size:int>>"))

    some = pages.where(text.rlike("(?i)" + "|".join(f"(?:{t.positive})" for t in terms)))
    rows = some.select("doc", "page", "text", F.explode(F.concat(*map(spots, terms))).alias("s")).select("doc", "page", "text", "s.*")
    found = rows.select("doc", "page", "label", "pos", S.snippet("text", F.col("pos"), F.col("size"), around).alias("snippet"))
    first = F.row_number().over(W.partitionBy("doc", "label", F.lower(F.left("snippet", F.lit(70)))).orderBy("page", "pos"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def histogram(hits: DataFrame) -> DataFrame:
    """Labels of each document as ``label×count``, most frequent first."""
    n = hits.groupBy("doc", "label").agg(F.count("*").alias("n"))
    items = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "label", "n")))
    text = F.array_join(F.transform("i", lambda x: F.concat(x["label"], F.lit("×"), x["n"])), ", ")
    return n.groupBy("doc").agg(items.alias("i"), F.count("*").alias("n_labels"), F.sum("n").alias("n_hits")).select("doc", text.alias("labels"), "n_labels", "n_hits")


def sections(docs: DataFrame, ranked: DataFrame, verdicts: DataFrame, least: int = 40) -> DataFrame:
    """Where a document stands in the report: recall gap, relevant, unjudged, suppressed or without hits."""
    rows = docs.join(ranked, "doc", "left").join(verdicts, "doc", "left")
    section = F.when(F.col("n_chars") < least, "recall gap").when(F.col("n_hits").isNull(), "no hits").when(F.col("verdict").isNull(), "unjudged").when(F.col("verdict") == "relevant", "relevant").otherwise("suppressed")
    return rows.withColumn("section", section)


def ranked_results(rows: DataFrame) -> DataFrame:
    """Results in order: relevant, unjudged, others; more labels, then more hits, then the document."""
    tier = F.when(F.col("section") == "relevant", 0).when(F.col("section") == "unjudged", 1).otherwise(2)
    return placed(rows.where("n_hits is not null").withColumn("tier", tier), ["tier"], [F.desc("n_labels"), F.desc("n_hits"), F.col("doc")])


def richest(ranked: DataFrame, most: int) -> DataFrame:
    """The first ``most`` results of each tier, for a report of bounded length."""
    return ranked.where(F.col("place") <= most)


def flagged(pages: DataFrame, words: Sequence[str] = SIGNALS) -> DataFrame:
    """Pages with ``signal``: whether any of the words stands in them, in either case."""
    low = F.lower("text")
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return pages.withColumn("signal", F.coalesce(hit, F.lit(False)))


def keyword_window(pages: DataFrame, words: Sequence[str] = SIGNALS, large: int = 30, most: int = 10) -> DataFrame:
    """All pages of small documents; of large ones the cover and the first ``most`` further pages with a signal."""
    rows = flagged(pages, words)
    size = rows.groupBy("doc").agg(F.count("*").alias("n_pages"), F.min("page").alias("_cover"))
    rows = rows.join(size, "doc")
    small = rows.where(F.col("n_pages") <= large)
    cover = rows.where((F.col("n_pages") > large) & (F.col("page") == F.col("_cover")))
    rest = rows.where((F.col("n_pages") > large) & (F.col("page") != F.col("_cover")) & F.col("signal"))
    rest = rest.withColumn("_n", F.row_number().over(W.partitionBy("doc").orderBy("page"))).where(F.col("_n") <= most).drop("_n")
    return small.unionByName(cover).unionByName(rest).select("doc", "page", "n_pages", (F.col("n_pages") > large).alias("windowed"))


def triage(page_stats: DataFrame, first: int = 12) -> DataFrame:
    """Whether a document's text layer will do, from its first pages: needs_ocr, likely, empty or has_text."""
    nth = F.row_number().over(W.partitionBy("doc").orderBy("page"))
    head = page_stats.withColumn("_n", nth).where(F.col("_n") <= first)
    sums = head.groupBy("doc").agg(F.count("*").alias("_k"), F.sum("n_chars").alias("_c"), F.count_if(F.col("n_chars") >= 100).alias("_t"), F.count_if((F.col("n_chars") < 20) & (F.col("n_images") >= 1)).alias("_i"))
    per = F.col("_c") / F.col("_k")
    verdict = F.when((F.col("_t") == 0) & (F.col("_i") >= 1), "needs_ocr").when((per < 40) & (F.col("_i") >= F.col("_k") * 0.5), "likely").when((F.col("_t") == 0) & (F.col("_c") < 30), "empty").otherwise("has_text")
    return sums.select("doc", verdict.alias("verdict"), F.round(per, 6).alias("chars_per_page"))


def found_terms(docs: DataFrame, terms: list[tuple[str, int]]) -> DataFrame:
    """``doc`` and ``n``, the number of ``terms`` (lower-cased strings with how often each counts) that stand in its text."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(terms), docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, (term, n) in enumerate(shared.value):
            automaton.add_word(term, (k, n))
        automaton.make_automaton()
        for batch in batches:
            counts = [sum(dict(v for _, v in automaton.iter(t)).values()) if t else 0 for t in batch.column("low").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(counts, pa.int64())], names=["doc", "n"])

    return docs.select("doc", F.lower("text").alias("low")).mapInArrow(run, f"doc {kind}, n long")


def privacy_scan(docs: DataFrame, terms: DataFrame, unsearchable: Column, exempt: Column | None = None, chunk: int = 50_000) -> DataFrame:
    """Each document's verdict against fixed strings: blocked by a hit, blocked unread, or clear. Without terms the job fails.

    Whole terms are sought by one automaton over batches of texts. Terms beyond ``chunk`` take a further pass each, so what
    an executor holds is bounded however many there are. Rows that are ``exempt`` (data files) are never blocked by a hit.
    """
    low = F.lower("term")
    known = terms.where(F.trim("term") != "").groupBy(low.alias("term")).agg(F.count("*").alias("n"))
    known = written(known.withColumn("k", F.xxhash64("term")), "privacy-terms")
    n = known.count()
    if not n:
        raise ValueError("no privacy terms: a scan without any would pass everything")
    parts = -(-n // chunk)
    rows = docs.select("doc", unsearchable.alias("unread"), (F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))).alias("exempt"))
    found = None
    for part in range(parts):
        some = [(r.term, r.n) for r in known.where(F.pmod("k", F.lit(parts)) == part).collect()]
        if some:
            hits = found_terms(docs, some)
            found = hits if found is None else found.unionByName(hits)
    sums = found.groupBy("doc").agg(F.sum("n").alias("n_terms"))
    rows = rows.join(sums, "doc", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    return rows.select("doc", "n_terms", F.when(F.col("exempt"), "exempt").when(F.col("unread"), "blocked unread").when(F.col("n_terms") > 0, "blocked").otherwise("clear").alias("verdict"))


def harvested_ids(pages: DataFrame, marker: str, pattern: str) -> DataFrame:
    """Distinct ids on pages with a marker phrase, without trailing stars."""
    rows = pages.where(F.lower("text").contains(marker.lower())).select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("raw"))
    return rows.select(F.regexp_replace("raw", r"\*+$", "").alias("id")).distinct()


# Elements that end a line, where link targets stand, and white space within a line.
BLOCKS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|section|article|tr|table|br|main)\b[^>]*>"
TARGETS = (r'(?i)(?:href|src)\s*=\s*"([^"]+)"', r"(?i)url\(\s*['\"]?([^)'\"]+?)['\"]?\s*\)")
WITHIN_LINE = r"[ \t\r\x0c\x0b]+"
#: White space at an end, as Unicode has it.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def region(html: Column) -> Column:
    """What stands in the main element, up to its own end; else in the article element; else empty. Scripts, styles, then comments are cut."""
    found = F.lit("")
    for name in ("article", "main"):
        inner = rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"
        found = F.when(html.rlike(inner), F.regexp_extract(html, inner, 1)).otherwise(found)
    return F.regexp_replace(F.regexp_replace(found, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->", " ")


def visible_lines(html: Column) -> Column:
    """Text lines of a region: blocks as line ends, other tags as spaces, references decoded."""
    text = S.unescaped(F.regexp_replace(F.regexp_replace(html, BLOCKS, "\n"), r"<[^>]+>", " "))
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, WITHIN_LINE, " "), EDGES, ""))
    return F.filter(lines, lambda x: x != "")


def link_targets(html: Column) -> Column:
    """Distinct targets of links, sources and style urls of a region in order, decoded, without query and fragment."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in TARGETS])
    paths = F.transform(found, lambda x: F.regexp_replace(F.regexp_extract(S.unescaped(x), r"^([^?#]*)", 1), EDGES, ""))
    return F.array_sort(F.array_distinct(F.filter(paths, lambda x: x != "")))


def page_version(pages: DataFrame, least: int = 40) -> DataFrame:
    """Normalized form of each page with a hash of lines and links; pages without a region or text are rejected."""
    rows = pages.withColumn("_r", region(F.col("html")))
    rows = rows.select("page_id", "url", visible_lines(F.col("_r")).alias("lines"), link_targets(F.col("_r")).alias("links"))
    text = F.array_join("lines", "\n")
    rows = rows.withColumns({"chars": F.length(text), "hash": F.substring(F.sha2(F.concat_ws("\n--\n", text, F.array_join("links", "\n")), 256), 1, 16)})
    return rows.withColumn("status", F.when(F.col("chars") < least, "reject").otherwise("ok"))


def whole_word_context(docs: DataFrame, ids: DataFrame, around: int = 150) -> DataFrame:
    """Whether each id stands in a document as a whole word, with what is around its first place.

    Words are joined, not patterns with documents: each document's distinct words meet the ids once.
    """
    words = docs.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("id"))
    hits = words.join(ids.select("id").distinct(), "id")
    rows = hits.join(docs, "doc")
    at = F.expr("length(regexp_extract(text, concat('(?s)^(.*?)\\\\b', id, '\\\\b'), 1)) + 1")
    start = F.greatest(at - around, F.lit(1))
    context = F.substring("text", start, F.length("id") + around + (at - start))
    return rows.select("doc", "id", S.single_spaced(context).alias("context"))
