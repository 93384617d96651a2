"""Token ids in Parquet files: list columns with chosen encodings, bounded row groups and page indexes.

Documents are dealt by ranges of their id, so the files hold them in ascending order and no task sorts the table; each
task encodes its range and Spark's own writer stores it. Columns of a file: ``part`` (the task), ``doc_id``, ``n_tokens``,
``offset`` (ids of the part before the document), ``tokens`` (list of ids) and ``meta`` (further columns to keep, as a
struct). Ids are numbers below 2^16 or so with a steep frequency curve, so they get a dictionary per row group (indices
bit-packed) or, with ``ids="delta"``, binary packing; the rising columns are always delta-packed. A page holds
``page_rows`` documents at most and every column has its page index, so a filter on ``doc_id``, or on ``part`` and ``offset``,
reads a few pages, and ``doc_id``, lengths or ``meta`` are read without touching ids.

A table ``parts`` beside the files has a row for each file: its ids, documents, first and last document and where it
starts among all ids. Starts of documents are sums of both, so the texts are encoded once and the files written once.

Encoding is the tokenizers library's. Its pretokenizer cuts at certain places whatever stands around (``PIECE``), so texts are cut
there, and the pieces that the library has encoded are remembered, in bounded number. Tests compare with the library on
whole texts.

Cases: null and empty texts hold the end id alone; rows with one id stand beside each other in the order of their texts'
hashes, those without an id first; repeated rows each get a row; an empty table gives empty files and no rows; columns of
any name may be kept, as they lie in ``meta``; texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import attrgetter
from struct import Struct, pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from tokenizers import Tokenizer

#: White space as byte-level pretokenizers know it, letters and figures that any version of Unicode has as such, and marks that may follow a word.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "a-zA-ZÀ-ÖØ-öø-ʯЀ-ҁҊ-ԯ"
MARKS = r".,;:!?)\]}\"$%&*#|@"
#: Pieces of a text whose ends are cuts of the pretokenizer in any context: a word before a mark or white space, marks before white
#: space, what else holds together, white space up to its last character, and that one. A space goes with what follows.
PIECE = re.compile(rf" ?[{LETTERS}]++(?=[ .,\n])| ?[{LETTERS}0-9]++(?![^{MARKS}{SPACE}])| ?[{MARKS}]++(?![^{SPACE}])| ?[^{SPACE}]++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Letters of words, which the pretokenizer leaves whole.
LETTER = re.compile(f"[{LETTERS}]")
#: Longest piece that is remembered.
LONGEST = 64
ID = attrgetter("id")
#: Documents that a task turns into a batch of ids at once.
STEP = 64


@dataclass(frozen=True)
class Layout:
    """How files are laid out: encoding of ids, bytes of a row group, bytes and documents of a page, documents of a file, codec."""

    ids: str = "dictionary"
    row_group: int = 32 << 20
    page: int = 256 << 10
    page_rows: int = 2_000
    file_rows: int = 1_000_000
    codec: str = "snappy"

    def options(self) -> dict[str, str]:
        if self.ids not in ("dictionary", "delta"):
            raise ValueError(f"ids are kept by dictionary or delta, not by {self.ids}")
        packed = ["doc_id", "offset", "n_tokens", *(["tokens.list.element"] if self.ids == "delta" else [])]
        return {
            "compression": self.codec,
            "maxRecordsPerFile": str(self.file_rows),
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.page.row.count.limit": str(self.page_rows),
        } | {f"parquet.enable.dictionary#{c}": "false" for c in packed}


def byte_characters() -> dict[int, str]:
    """The visible character that byte-level vocabularies have for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Pieces(dict):
    """Ids of pieces by the library: ``remembered`` of those met again, and as many met once; either part starts anew when it is full."""

    def __init__(self, library: Tokenizer, remembered: int):
        self.library, self.model, self.shown = library, library.model, byte_characters()
        self.remembered, self.old = remembered, {}
        self.tokenize, self.space = self.model.tokenize, self.shown[32]
        spelt = {c: c.encode().decode("latin-1").translate(self.shown) for c in map(chr, range(0x530)) if LETTER.match(c)}
        self.spell = spelt.__getitem__
        self.packs = [Struct(f"<{n}I").pack for n in range(LONGEST)]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.pop(piece, None)
        if ids is not None:  # met again: rare pieces that pass by don't drive it out
            home = self
        else:
            ids = self.made(piece)
            if len(piece) > LONGEST:
                return ids
            home = self.old
        if len(home) >= self.remembered:
            home.clear()
        home[piece] = ids
        return ids

    def made(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " else piece
        try:  # a word goes straight to the library's model: nothing of it needs to be cut
            shown = word if word.isascii() and word.isalpha() else "".join(map(self.spell, word))
        except KeyError:
            shown = ""
        if shown:
            ids = list(map(ID, self.tokenize(shown if word is piece else self.space + shown)))
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return self.packs[len(ids)](*ids) if len(ids) < LONGEST else pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str, remembered: int = 400_000):
        self.library = Tokenizer.from_file(path)
        model = self.library.pre_tokenizer
        if not str(model).startswith("ByteLevel(add_prefix_space=False") or "use_regex=True" not in str(model) or self.library.normalizer is not None:
            raise ValueError(f"{path}: only byte-level tokenizers without a normalizer or a leading space are supported")
        self.pieces = Pieces(self.library, remembered)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.library.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode(self, text: str) -> bytes:
        """Ids of a text; strings of special tokens in it are those tokens, as the library has it."""
        ids = self.pieces.__getitem__
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(ids, PIECE.findall(text)))
        return b"".join(self.special[x] if k % 2 else b"".join(map(ids, PIECE.findall(x))) for k, x in enumerate(self.specials.split(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), end: int | None = 0, layout: Layout = Layout()) -> None:
    """Writes the ids of every document, each closed by ``end``, in ascending order of ``id_col`` to ``path``/data, and the table of files to ``path``/parts."""
    spark = docs.sparkSession
    meta = F.struct(*[docs[f"`{c}`"].alias(c) for c in keep], *([] if keep else [F.lit(None).cast("boolean").alias("none")]))
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"), meta.alias("meta"))
    # the hash orders rows of one id; the last key spreads equal rows, whose order doesn't matter
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("spread", F.rand(7))
    rows = rows.repartitionByRange("doc_id", "h", "spread").sortWithinPartitions("doc_id", "h", "spread").drop("h", "spread")
    close = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in (whole.slice(k, STEP) for whole in batches for k in range(0, whole.num_rows, STEP)):
            raw = [encode(text or "") + close for text in batch.column("text").to_pylist()]
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.array(np.frombuffer(b"".join(raw), "<i4"))
            tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids)
            columns = [pa.array(np.full(len(raw), part, np.int32)), batch.column("doc_id"), pa.array(sizes), pa.array(before + ends[:-1]), tokens, batch.column("meta")]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n_tokens", "offset", "tokens", "meta"])
            before += int(ends[-1])

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType().add("part", T.IntegerType()).add("doc_id", kinds["doc_id"]).add("n_tokens", T.LongType()).add("offset", T.LongType()).add("tokens", T.ArrayType(T.IntegerType())).add("meta", kinds["meta"])
    rows.mapInArrow(run, schema).write.options(**layout.options()).parquet(f"{path}/data")

    stored = spark.read.schema(schema).parquet(f"{path}/data")
    files = stored.groupBy(F.col("_metadata.file_path").alias("file"), "part").agg(
        F.min("offset").alias("offset"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )
    earlier = W.orderBy("part", "offset").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    files.withColumn("start", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).write.parquet(f"{path}/parts")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The files of a written table: ``file``, ``part``, ``offset``, ``tokens``, ``docs``, ``first_id``, ``last_id`` and ``start``."""
    return spark.read.parquet(f"{path}/parts")


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``start`` of each document among all ids: that of its part and its ``offset`` there."""
    bases = files.groupBy(F.col("part").alias("of")).agg(F.min("start").alias("base"))
    return rows.join(bases, F.col("part") == F.col("of")).withColumn("start", F.col("base") + F.col("offset")).drop("of", "base", "part", "offset")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``tokens``, ``meta`` and ``start`` of all documents; what isn't selected isn't read."""
    return _placed(spark.read.parquet(f"{path}/data"), parts(spark, path))


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Documents with ids from ``first`` to ``last``, from the files that can hold them and there from their pages."""
    files = parts(spark, path)
    found = [r.file for r in files.where((F.col("first_id") <= last) & (F.col("last_id") >= first)).select("file").collect()]
    rows = spark.read.parquet(*found) if found else spark.read.parquet(f"{path}/data").limit(0)
    return _placed(rows.where(F.col("doc_id").between(first, last)), files)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids at places ``first`` to ``last`` - 1 of all, as ``doc_id``, ``start`` and ``tokens`` of each document that holds some, from the pages that hold them."""
    held = parts(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("tokens") > first)).collect()
    if not held or first >= last:
        return read_tokens(spark, path).select("doc_id", "start", "tokens").limit(0)
    inside = F.lit(False)
    for r in held:  # files of the range alone
        at = r.start - r.offset
        inside = inside | ((F.col("part") == r.part) & (F.col("offset") < last - at) & (F.col("offset") + F.col("n_tokens") > first - at) & (F.col("offset") >= r.offset) & (F.col("offset") < r.offset + r.tokens))
    rows = spark.read.parquet(*[r.file for r in held]).where(inside)
    rows = _placed(rows, parts(spark, path))
    begin = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    size = F.least(F.lit(last), F.col("start") + F.col("n_tokens")) - F.col("start") - begin
    return rows.select("doc_id", (F.col("start") + begin).alias("start"), F.slice("tokens", (begin + 1).cast("int"), size.cast("int")).alias("tokens"))


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) of rows of ``read_tokens``."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            ends, ids = tokens.offsets.to_numpy(), tokens.values.to_numpy().astype("<u4")
            sums = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)), sums], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "tokens").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
