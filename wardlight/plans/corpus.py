"""Queries over text corpora and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions import scalars as S
from wardlight.operators import corpus as c
from wardlight.plans.registry import query
from wardlight.sources.tables import table

#: Patterns over the corpus' invented prose; the second may not stand near the third's words.
TERMS = (c.Term("ending", r"[a-z]*tioning\b"), c.Term("with", r"\bwith\b", r"\bthe\b"), c.Term("mark", r"[%#$&*]{3}"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, one for each line."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("page", "text"))


PAGES = """pages_ AS (SELECT doc_id AS doc, unnest(range(len(s))) AS page, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits_sql(label: str, pattern: str, negative: str | None, source: str = "pages_") -> str:
    near = f"WHERE NOT regexp_matches(substr(text, greatest(pos - 45, 1), size + 45 + pos - greatest(pos - 45, 1)), '(?i){negative}')" if negative else ""
    return f"""SELECT doc, page, '{label}' AS label, pos, trim(regexp_replace(substr(text, greatest(pos - 130, 1), size + 130 + pos - greatest(pos - 130, 1)), '\\s+', ' ', 'g')) AS snippet FROM (
  SELECT doc, page, text, CAST(1 + list_sum(gaps[1:k + 1]) + coalesce(list_sum(list_transform(hits[1:k], lambda x: length(x))), 0) AS INT) AS pos, length(hits[k + 1]) AS size FROM (
    SELECT *, unnest(range(len(hits))) AS k FROM (SELECT doc, page, text, regexp_extract_all(text, '(?i){pattern}') AS hits, list_transform(string_split_regex(text, '(?i){pattern}'), lambda x: length(x)) AS gaps FROM {source}) WHERE len(hits) > 0)) {near}"""


HITS = f"""{PAGES}, raw AS ({" UNION ALL ".join(_hits_sql(t.label, t.positive, t.negative) for t in TERMS)}),
hits AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY doc, label, lower(substr(snippet, 1, 70)) ORDER BY page, pos) = 1)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.term_hits(doc_pages(spark, sf_dir), TERMS)


@query("term_search", f"WITH {HITS} SELECT doc, page, label, pos, snippet FROM hits")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


HIST = f"""{HITS}, n AS (SELECT doc, label, count(*) AS n FROM hits GROUP BY ALL),
hist AS (SELECT doc, string_agg(label || '×' || n, ', ' ORDER BY n DESC, label) AS labels, count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS n_hits FROM n GROUP BY doc)"""


@query("label_histogram", f"WITH {HIST} SELECT * FROM hist")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.histogram(hits(spark, sf_dir))


SECT = f"""{HIST}, v AS (SELECT doc_id AS doc, CASE WHEN max(quality) = 1 THEN 'relevant' ELSE 'not' END AS verdict FROM labels GROUP BY doc_id),
sect AS (SELECT d.doc_id AS doc, n_labels, n_hits, CASE WHEN length(text) < 40 THEN 'recall gap' WHEN n_hits IS NULL THEN 'no hits' WHEN verdict IS NULL THEN 'unjudged' WHEN verdict = 'relevant' THEN 'relevant' ELSE 'suppressed' END AS section
  FROM documents d LEFT JOIN hist h ON d.doc_id = h.doc LEFT JOIN v ON d.doc_id = v.doc)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("n_chars"))
    verdicts = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("doc")).agg(F.when(F.max("quality") == 1, "relevant").otherwise("not").alias("verdict"))
    return c.sections(docs, c.histogram(hits(spark, sf_dir)), verdicts)


@query("report_sections", f"WITH {SECT} SELECT section, count(*) AS n FROM sect GROUP BY section")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).groupBy("section").agg(F.count("*").alias("n"))


@query(
    "term_rank",
    f"""WITH {SECT}, t AS (SELECT doc, section, n_labels, n_hits, CASE section WHEN 'relevant' THEN 0 WHEN 'unjudged' THEN 1 ELSE 2 END AS tier FROM sect WHERE n_hits IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n_labels DESC, n_hits DESC, doc) AS place FROM t""",
)
def term_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ranked_results(_sections(spark, sf_dir)).select("doc", "section", "n_labels", "n_hits", "tier", "place")


@query(
    "term_rank_richest",
    f"""WITH {SECT}, t AS (SELECT doc, section, n_labels, n_hits, CASE section WHEN 'relevant' THEN 0 WHEN 'unjudged' THEN 1 ELSE 2 END AS tier FROM sect WHERE n_hits IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n_labels DESC, n_hits DESC, doc) AS place FROM t QUALIFY place <= 25""",
)
def term_rank_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the bound: the report names the richest documents of each tier."""
    return c.richest(c.ranked_results(_sections(spark, sf_dir)), 25).select("doc", "section", "n_labels", "n_hits", "tier", "place")


def _default_sql() -> str:
    """Documents by default term in DuckDB: RE2 lacks nothing that the positive patterns use."""
    each = [f"SELECT '{t.label}' AS label, CAST(count(*) FILTER (regexp_matches(text, '(?i){t.positive}')) AS BIGINT) AS n_docs FROM documents" for t in c.DEFAULT_TERMS]
    return " UNION ALL ".join(each)


#: What is added to the corpus' lines, in turn, so that the default terms and what may not stand near them occur.
PHRASES = (
    "", "The boiler house boils over.", "Leachate boils on the deck.", "a legal settlement agreement", "Differential settlement of 3 ft", "settling near the toe", "Cave-ins and sink holes, a landslide", "steam turbine fumes",
    "it steams, fuming all day", "TS-01 and TSO1", "an outbreak of brown leachate; standing leachate", "Subsurface smoldering at elevated temperatures", "slumping, sloughing, slope failure", "",
)


def phrase_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as pages, each with a phrase behind it."""
    turn = F.pmod(F.col("doc") * 5 + F.col("page"), F.lit(len(PHRASES))).cast("int")
    return doc_pages(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", F.get(F.lit(list(PHRASES)), turn)))


PHRASE_HITS = f"""{PAGES}, phrased AS (SELECT doc, page, text || ' ' || ([{", ".join(_quoted(x) for x in PHRASES)}])[(doc * 5 + page) % {len(PHRASES)} + 1] AS text FROM pages_),
raw AS ({" UNION ALL ".join(_hits_sql(t.label, t.positive, t.negative, "phrased") for t in c.DEFAULT_TERMS)})
SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY doc, label, lower(substr(snippet, 1, 70)) ORDER BY page, pos) = 1"""


@query("default_term_search", f"WITH {PHRASE_HITS}")
def default_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default terms with what may not stand near them, in one pass."""
    return c.term_hits(phrase_pages(spark, sf_dir), c.DEFAULT_TERMS)


@query("default_term_documents", _default_sql())
def default_term_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which each default term matches, before its negative pattern."""
    d = table(spark, sf_dir, "documents")
    counts = d.agg(*[F.count_if(F.col("text").rlike(f"(?i){t.positive}")).alias(t.label) for t in c.DEFAULT_TERMS])
    pairs = F.array(*[F.struct(F.lit(t.label).alias("label"), F.col(f"`{t.label}`").alias("n_docs")) for t in c.DEFAULT_TERMS])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


@query("bare_term_count", "SELECT doc_id AS doc, len(regexp_extract_all(text, '(?i)\\bthe\\b')) AS n FROM documents")
def bare_term_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.regexp_count("text", F.lit(r"(?i)\bthe\b")).cast("long").alias("n"))


WORDS = ("with", "reth", "thand")


@query(
    "keyword_windows",
    f"""WITH {PAGES}, s AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n_pages, {" OR ".join(f"contains(lower(text), '{w}')" for w in WORDS)} AS hit FROM pages_),
r AS (SELECT *, sum(CASE WHEN hit AND page > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page) AS k FROM s)
SELECT doc, page, n_pages, n_pages > 12 AS windowed FROM r WHERE n_pages <= 12 OR page = 0 OR (hit AND k <= 3)""",
)
def keyword_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.keyword_window(doc_pages(spark, sf_dir), WORDS, 12, 3)


@query(
    "text_triage",
    f"""WITH p AS (SELECT conv_id AS doc, turn AS page, length(text) % 130 AS n_chars, CAST(turn % 2 AS INT) AS n_images, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT doc, count(*) AS k, sum(n_chars) AS c, count(*) FILTER (n_chars >= 100) AS t, count(*) FILTER (n_chars < 20 AND n_images >= 1) AS i FROM p WHERE k <= 12 GROUP BY doc)
SELECT doc, CASE WHEN t = 0 AND i >= 1 THEN 'needs_ocr' WHEN c / k < 40 AND i >= k * 0.5 THEN 'likely' WHEN t = 0 AND c < 30 THEN 'empty' ELSE 'has_text' END AS verdict, round(c / k, 6) AS chars_per_page FROM s""",
)
def text_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return c.triage(t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), (F.length("text") % 130).alias("n_chars"), (F.col("turn") % 2).cast("int").alias("n_images")))


@query(
    "privacy_scan",
    """WITH t AS (SELECT lower(text) AS term FROM benchmark),
h AS (SELECT doc_id, source, len(list_filter((SELECT list(term) FROM t), lambda x: contains(lower(text), x))) AS n_terms, length(text) AS n FROM documents)
SELECT doc_id AS doc, CAST(n_terms AS BIGINT) AS n_terms, CASE WHEN source LIKE '%7' THEN 'exempt' WHEN n < 40 THEN 'blocked unread' WHEN n_terms > 0 THEN 'blocked' ELSE 'clear' END AS verdict FROM h""",
)
def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.col("text").alias("term"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "source")
    return c.privacy_scan(docs, terms, F.length("text") < 40, F.col("source").endswith("7"))


@query(
    "id_harvest",
    f"""WITH {PAGES} SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9a-f]{{40}}')) AS id FROM pages_ WHERE contains(lower(text), 'token')""",
)
def id_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.harvested_ids(doc_pages(spark, sf_dir), "token", "[0-9a-f]{40}")


@query(
    "mention_context",
    """WITH w AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS id FROM documents),
h AS (SELECT w.doc, w.id, d.text, instr(regexp_replace(text, '(^|[^A-Za-z0-9_])' || id || '($|[^A-Za-z0-9_])', '\\1' || chr(1) || '\\2'), chr(1)) AS pos FROM w JOIN documents d ON w.doc = d.doc_id WHERE id IN ('clown', 'idiot', 'token'))
SELECT doc, id, trim(regexp_replace(substr(text, CAST(greatest(pos - 150, 1) AS BIGINT), CAST(length(id) + 150 + pos - greatest(pos - 150, 1) AS BIGINT)), '\\s+', ' ', 'g')) AS context FROM h""",
)
def mention_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("clown",), ("idiot",), ("token",)], "id string")
    return c.whole_word_context(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), ids)


#: What stands at an article's end in some pages: references of all kinds; a source and a style url; a main element around.
REFERENCES = "<p>caf&eacute; &#8364;5 &#x41;&hellip; &notit; &unknown; R&ampD &lt;b&gt;</p></article>"
ASSETS = """<img src="/img/p.png?x=1"><div style="background:url( '/bg.png#f' )">&nbsp;behind&nbsp;it&nbsp;</div></article>"""
AROUND = "</article><p>after the article</p></main><p>outside</p>"


def pages(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Pages; the second version adds a cache mark to every link, a paragraph to each fifth page, a link to the page after it and a source to some."""
    end, k = F.lit("</article>"), F.col("page_id") % 7
    more = F.when(k == 2, REFERENCES).when(k == 3, ASSETS).when(k == 4, AROUND).otherwise(end)
    html = F.replace("html", end, more)
    html = F.when(k == 4, F.replace(html, F.lit("<article>"), F.lit('<main class="m"><article>'))).otherwise(html)
    p = table(spark, sf_dir, "pages").withColumn("html", html)
    if version == 1:
        return p
    html = F.replace(F.regexp_replace("html", r'href="([^"]*)"', r'href="$1?cb=9"'), F.lit("/bg.png"), F.when(F.col("page_id") % 2 == 0, "/new.png").otherwise("/bg.png"))
    more = F.when(F.col("page_id") % 5 == 0, "<p>An added line stands here.</p></article>").when(F.col("page_id") % 5 == 1, '<a href="/added"></a></article>').otherwise(end)
    return p.withColumn("html", F.replace(html, end, more))


def _decoded(x: str) -> str:
    """The references that the pages hold, and one that holds another one's name."""
    for name, char in (("nbsp;", "\xa0"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("#39;", "'"), ("middot;", "·"), ("copy;", "©"), ("eacute;", "é"), ("#8364;", "€"), ("#x41;", "A"), ("hellip;", "…"), ("notit;", "¬it;"), ("amp;", "&"), ("amp", "&")):
        x = f"replace({x}, '&{name}', {_quoted(char)})"
    return x


def _clean(x: str) -> str:
    text = f"""regexp_replace(regexp_replace({x}, '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|section|article|main)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"""
    return f"list_filter(list_transform(string_split({_decoded(text)}, chr(10)), lambda y: trim(regexp_replace(y, '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ' || chr(160))), lambda y: y <> '')"


def _version_sql(name: str, html: str) -> str:
    targets = """list_concat(regexp_extract_all(r, '(?i)(?:href|src)\\s*=\\s*"([^"]+)"', 1), regexp_extract_all(r, '(?i)url\\(\\s*[''"]?([^)''"]+?)[''"]?\\s*\\)', 1))"""
    return f"""{name} AS (SELECT page_id, url, {_clean("r")} AS lines, list_sort(list_distinct(list_filter(list_transform({targets}, lambda y: trim(regexp_extract({_decoded("y")}, '^([^?#]*)', 1))), lambda y: y <> ''))) AS links
  FROM (SELECT page_id, url, regexp_replace(regexp_replace(CASE WHEN regexp_matches(h, '(?is)<main\\b[^>]*>.*?</main>') THEN regexp_extract(h, '(?is)<main\\b[^>]*>(.*?)</main>', 1) ELSE regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article>', 1) END,
    '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS r FROM (SELECT page_id, url, {html} AS h FROM {"pages_2" if name == "v2" else "pages"})))"""


FIRST = f"""CASE page_id % 7 WHEN 2 THEN replace(html, '</article>', {_quoted(REFERENCES)}) WHEN 3 THEN replace(html, '</article>', {_quoted(ASSETS)})
  WHEN 4 THEN replace(replace(html, '</article>', {_quoted(AROUND)}), '<article>', '<main class="m"><article>') ELSE html END"""
V1 = _version_sql("v1", FIRST)
V2 = f"pages_2 AS (SELECT page_id, url, {FIRST} AS html FROM pages), " + _version_sql(
    "v2",
    """replace(replace(regexp_replace(html, 'href="([^"]*)"', 'href="\\1?cb=9"', 'g'), '/bg.png', CASE WHEN page_id % 2 = 0 THEN '/new.png' ELSE '/bg.png' END), '</article>', CASE page_id % 5 WHEN 0 THEN '<p>An added line stands here.</p></article>' WHEN 1 THEN '<a href="/added"></a></article>' ELSE '</article>' END)""",
)


@query(
    "page_normalize",
    f"""WITH {V1}, t AS (SELECT *, array_to_string(lines, chr(10)) AS body FROM v1)
SELECT page_id, url, CAST(length(body) AS INT) AS chars, substr(sha256(body || chr(10) || '--' || chr(10) || array_to_string(links, chr(10))), 1, 16) AS hash, CASE WHEN length(body) < 40 THEN 'reject' ELSE 'ok' END AS status FROM t""",
)
def page_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.page_version(pages(spark, sf_dir, 1)).select("page_id", "url", "chars", "hash", "status")


@query(
    "page_change",
    f"""WITH {V1}, {V2}, a AS (SELECT page_id, unnest(lines) AS line, 1 AS o, 0 AS n FROM v1 UNION ALL SELECT page_id, unnest(lines), 0, 1 FROM v2),
d AS (SELECT page_id, line, sum(n) - sum(o) AS x FROM a GROUP BY ALL),
m AS (SELECT page_id, CAST(sum(greatest(x, 0)) AS BIGINT) AS plus, CAST(sum(greatest(-x, 0)) AS BIGINT) AS minus FROM d GROUP BY page_id)
SELECT v1.page_id, coalesce(plus, 0) AS plus, coalesce(minus, 0) AS minus, CASE WHEN coalesce(plus, 0) > 0 OR coalesce(minus, 0) > 0 THEN 'text' WHEN v1.links <> v2.links THEN 'links only' ELSE 'unchanged' END AS change
FROM v1 JOIN v2 ON v1.page_id = v2.page_id LEFT JOIN m ON v1.page_id = m.page_id""",
)
def page_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardlight.operators.diff import line_diff

    old, new = (c.page_version(pages(spark, sf_dir, v)) for v in (1, 2))
    return line_diff(old, new, "page_id", "lines", "links")


@query("file_sniff", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'gzip' ELSE 'unknown' END AS kind FROM pages")
def file_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    lead = [F.encode(F.lit("x\n%PDF-1.7"), "UTF-8"), F.unhex(F.lit("504B030414")), F.unhex(F.lit("1F8B0800"))]
    k = F.col("page_id") % 4
    head = F.when(k == 0, lead[0]).when(k == 1, lead[1]).when(k == 2, lead[2]).otherwise(F.encode(F.lit("<!"), "UTF-8"))
    return p.select("page_id", S.sniffed(F.concat(head, F.encode("html", "UTF-8"))).alias("kind"))


@query("byte_provenance", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def byte_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.provenance(F.encode("html", "UTF-8")).alias("sha256"))
