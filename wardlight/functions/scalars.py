"""Column functions: dates, ids, hashes, links, HTML and text."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.functions.arrays import bound


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first column that isn't null or blank, else the empty text."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def iso_date(c: Column | str) -> Column:
    """A date in one of several formats as ISO text, else the empty text; a zone offset is dropped, never applied."""
    text = F.trim(_col(c))
    found = [F.try_to_timestamp(F.substring(text, 1, 10), F.lit(p)) for p in ("yyyy-MM-dd", "MM/dd/yyyy")]
    found += [F.try_to_timestamp(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("M/d/yyyy")), F.try_to_timestamp(text, F.lit("MMMM d, yyyy"))]
    return F.coalesce(*[F.date_format(x, "yyyy-MM-dd") for x in found], F.lit(""))


def us_date_to_iso(c: Column | str) -> Column:
    """``M/D/YYYY`` as ISO text; anything else passes."""
    text, pattern = _col(c), r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
    part = [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]
    return F.when(text.rlike(pattern), F.concat_ws("-", part[2], F.lpad(part[0], 2, "0"), F.lpad(part[1], 2, "0"))).otherwise(text)


def epoch_ms_date(c: Column | str) -> Column:
    """Epoch milliseconds, as a number or its text, as an ISO date; null where it is none."""
    return F.date_format(F.timestamp_millis(_col(c).try_cast("bigint")), "yyyy-MM-dd")


def epoch_ms_minute(c: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_col(c).try_cast("bigint")), "yyyy-MM-dd HH:mm")


def identity_key(*columns: str) -> Column:
    """Parts joined by ``|``, nulls as empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def content_hash(*columns: str) -> Column:
    """First 12 hex digits of the SHA-1 of the joined parts."""
    return F.substring(F.sha1(identity_key(*columns)), 1, 12)


# Fixed value: a bare date in parentheses at a title's end.
TRAILING_DATE = r"\s*\(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\)\s*$"


def without_trailing_date(c: Column | str) -> Column:
    """A title without a bare ``(M/D/YYYY)`` at its end; only the last 40 characters are looked at."""
    text = F.regexp_replace(_col(c), r"(?<!\s)\s+$", "")
    size = F.length(text)
    head, tail = F.when(size > 40, F.substring(text, F.lit(1), size - 40)).otherwise(""), F.right(text, F.lit(40))
    cut = F.regexp_replace(tail, TRAILING_DATE, "")
    return F.concat(head, cut)


def without_query(url: Column | str) -> Column:
    """A link without its query and fragment."""
    return F.regexp_extract(_col(url), r"^([^?#]*)", 1)


def last_segment(url: Column | str) -> Column:
    return F.regexp_extract(without_query(url), r"([^/]+)/*$", 1)


def escaped(c: Column | str) -> Column:
    text = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_link(url: Column | str) -> Column:
    """The link if it is http or https, else the empty text."""
    u = F.trim(_col(url))
    return F.when(u.rlike(r"^(?i:https?)://"), u).otherwise("")


def max_temperature_f(c: Column | str) -> Column:
    """The highest temperature from 50 to 1000 °F that a text names, else null."""
    # Fixed value: how a temperature is written.
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(\d{2,4})\s*(?:°|deg(?:rees)?\.?\s*)?\s*f\b"), F.lit(1))
    values = F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x.between(50, 1000))
    return F.array_max(values)


def to_fahrenheit(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit).startswith("c"), value * 9 / 5 + 32).otherwise(value)


def single_spaced(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def snippet(c: Column | str, at: Column, size: Column, around: int = 130) -> Column:
    """What stands ``around`` characters about a match of ``size`` at position ``at`` (from 1), single-spaced."""
    start = F.greatest(at - around, F.lit(1))
    return single_spaced(F.substring(_col(c), start, size + around + (at - start)))


def compact_number(c: Column) -> Column:
    """A number without needless decimals."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def month_title(c: Column) -> Column:
    return F.date_format(c, "MMMM yyyy")


def parsed_or(c: Column | str, schema: str, default: Column) -> Column:
    """JSON by ``schema``, or ``default`` where it can't be read."""
    return F.coalesce(F.from_json(_col(c), schema), default)


def merged_lists(a: Column, b: Column) -> Column:
    """Both lists, order kept, repeats dropped; null lists are empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


#: Leading bytes of file kinds, as hex.
MAGIC: Sequence[tuple[str, str]] = (("25504446", "pdf"), ("1F8B", "gzip"), ("D0CF11E0A1B11AE1", "ole2"), ("504B0304", "zip"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("424D", "bmp"))


def sniffed(content: Column | str) -> Column:
    """The kind of a file by its first bytes; a PDF mark may stand anywhere in the first 1024."""
    body = _col(content)
    head = F.hex(F.substring(body, 1, 8))
    first = F.decode(F.substring(body, 1, 1024), "ISO-8859-1")  # a character a byte, so that a mark is found at any place
    kind = F.when(head.startswith(MAGIC[0][0]), MAGIC[0][1])
    for mark, name in MAGIC[1:]:
        kind = kind.when(head.startswith(mark), name)
    return kind.when(first.contains("%PDF"), "pdf").otherwise("unknown")


#: Character references by name, with ";" where the standard asks for it; those without may be the beginning of a longer name.
NAMED = html5
SHORT = sorted((n for n in NAMED if not n.endswith(";")), key=len, reverse=True)
#: What numbers from 128 to 159 stand for.
WINDOWS = [bytes([n]).decode("cp1252") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(128, 160)]
MOST = 0x10FFFF


def _character(code: Column) -> Column:
    """The character of a number in a reference, as browsers have it."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > MOST), "\ufffd")
        .when(code.between(128, 159), F.get(F.lit(WINDOWS), (code - 128).cast("int")))
        .when(none, "")
        .otherwise(plain)
    )


def unescaped(text: Column | str) -> Column:
    """A text with its character references decoded as HTML has it: all names, also those without an end mark, and numbers."""
    body = _col(text)
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")
    short = F.lit("^(?:" + "|".join(SHORT) + ")")

    def number(p: Column) -> Column:
        ten, sixteen = F.regexp_extract(p, "^#0*([0-9]+)", 1), F.regexp_extract(p, "^#[xX]0*([0-9a-fA-F]+)", 1)
        many = F.lit(MOST + 1).cast("long")
        code = F.when(ten != "", F.when(F.length(ten) > 9, many).otherwise(ten.try_cast("long"))).otherwise(F.when(F.length(sixteen) > 7, many).otherwise(F.conv(sixteen, 16, 10).try_cast("long")))
        return F.concat(_character(code), F.regexp_replace(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))

    def named(p: Column) -> Column:
        name = F.regexp_extract(p, r"^[^\t\n\x0c <&#;]{1,32};?", 0)
        whole, part = names[name], F.regexp_substr(p, short)
        return F.when(whole.isNotNull(), F.concat(whole, F.substr(p, F.length(name) + 1))).when(part.isNotNull(), F.concat(names[part], F.substr(p, F.length(part) + 1))).otherwise(F.concat(F.lit("&"), p))

    def decoded(p: Column) -> Column:
        return F.when(p.rlike("^#(?:[0-9]|[xX][0-9a-fA-F])"), number(p)).otherwise(named(p))

    def of(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))

    return F.when(body.contains("&"), bound(F.split(body, "&", -1), of)).otherwise(body)


def provenance(content: Column | str) -> Column:
    return F.sha2(_col(content), 256)
