"""Media columns kept as content-defined chunks.

A document's media is an 8-bit mono WAV file: a 44-byte header and the payload as unsigned
samples. A rolling gear hash cuts the file where the last 32 bytes say so, chunk digests are
deduplicated by grouping, and each distinct file is its ordered list of digests. Files are read
back by joining that list with the chunk store, checked against their SHA-256, and measured.

Nothing is gathered by a key that copies share: a third of all rows may hold one text, and still
its file is stored and restored once; the join that hands its features to the copies is a plain
equi-join that adaptive execution splits.

Cases: a null or empty text gives a payload of 64 zero bytes; repeated rows each get a row; an
empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.sources.tables import written

PAD = 64
RATE = 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of ``text``, with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % PAD if raw else PAD)


def wav(payload: bytes) -> bytes:
    """``payload`` as the samples of an 8-bit mono WAV file."""
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file made by ``wav``."""
    tag, _, kind, _, _, _, channels, _, _, _, bits, _, n = HEADER.unpack_from(media)
    if tag != b"RIFF" or kind != b"WAVE" or channels != 1 or bits != 8 or len(media) != HEADER.size + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER.size :]


class GearCutter:
    """Cut points of a rolling gear hash.

    The hash at a byte is the sum over the last 32 bytes of a random word for each, doubled for
    each byte that followed; it is a function of those 32 bytes alone. A cut follows a byte whose
    hash has ``log2(average)`` leading zero bits, at least ``least`` and at most ``most`` bytes
    after the last cut.
    """

    def __init__(self, average: int = 8192, least: int = 2048, most: int = 32768, seed: int = 20240229):
        if not 32 <= least <= average <= most:
            raise ValueError("sizes must satisfy 32 <= least <= average <= most")
        self.least, self.most = least, most
        self.words = np.random.default_rng(seed).integers(0, 2**32, 256, dtype=np.uint32)
        self.bound = np.uint32(2 ** (32 - (average.bit_length() - 1)))

    def cuts(self, data: bytes) -> list[int]:
        n = len(data)
        if n <= self.least:
            return [n]
        h = self.words[np.frombuffer(data, np.uint8)]
        step = 1
        while step < 32:  # windows of 2, 4, 8, 16 and 32 bytes
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        ends, last = [], 0
        for at in (np.flatnonzero(h < self.bound) + 1).tolist():
            while at - last > self.most:
                last += self.most
                ends.append(last)
            if at - last >= self.least and at < n:
                last = at
                ends.append(last)
        while n - last > self.most:
            last += self.most
            ends.append(last)
        return [*ends, n]

    def chunks(self, data: bytes) -> list[bytes]:
        ends = self.cuts(data)
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutter: GearCutter | None = None) -> DataFrame:
    """Per row: its id, unpadded bytes, the file's digest and its ordered chunk digests."""
    cutter = cutter or GearCutter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media_ids, chunk_ids = [], [], []
            for text in batch.column("text").to_pylist():
                payload = payload_of(text)
                media = wav(payload)
                sizes.append(len(text.encode("utf-8")) if text else 0)
                media_ids.append(hashlib.sha256(media).digest())
                chunk_ids.append([hashlib.sha256(c).digest() for c in cutter.chunks(media)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(media_ids, pa.binary()), pa.array(chunk_ids, pa.list_(pa.binary()))],
                names=["id", "n_bytes", "media_id", "chunk_ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {kind}, n_bytes long, media_id binary, chunk_ids array<binary>")


def chunk_store(docs: DataFrame, text_col: str = "text", cutter: GearCutter | None = None) -> DataFrame:
    """Each distinct chunk once: ``chunk_id`` and its bytes, compressed by zstd."""
    cutter = cutter or GearCutter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for text in set(batch.column("text").to_pylist()):
                for c in cutter.chunks(wav(payload_of(text))):
                    key = hashlib.sha256(c).digest()
                    if key not in seen:
                        seen[key] = packer.compress(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["chunk_id", "packed"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "chunk_id binary, packed binary")
    return found.groupBy("chunk_id").agg(F.first("packed").alias("packed"))


def restore(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Each distinct file of ``lists`` (``media_id``, ``chunk_ids``) as ``media_id`` and its ordered packed ``parts``."""
    files = lists.select("media_id", "chunk_ids").dropDuplicates(["media_id"])
    spots = files.select("media_id", F.size("chunk_ids").alias("n"), F.posexplode("chunk_ids").alias("seq", "chunk_id"))
    joined = spots.join(store, "chunk_id")
    whole = joined.where("n = 1").select("media_id", F.array(F.struct("seq", "packed")).alias("parts"))
    pieces = joined.where("n > 1").groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("seq", "packed"))).alias("parts"))
    return whole.unionByName(pieces)


def features(media: bytes) -> str:
    """Level, peak, zero crossings and byte entropy of a file's samples."""
    x = np.frombuffer(samples(media), np.uint8)
    wave = x.astype(np.float64) - 128.0
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    entropy = float(-(p * np.log2(p)).sum())
    crossings = int(np.count_nonzero(np.diff(wave >= 0)))
    return f"rms={np.sqrt((wave * wave).mean()):.4f};peak={np.abs(wave).max():.0f};zero_crossings={crossings};entropy={abs(entropy):.4f}"


def verified(parts: DataFrame) -> DataFrame:
    """Files put together from ``parts``, checked against ``media_id``, with digests and features."""
    shape = pa.schema(
        [("media_id", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for key, found in zip(batch.column("media_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                media = b"".join(unpack(p["packed"]) for p in found)
                if hashlib.sha256(media).digest() != key:
                    raise ValueError(f"media {key.hex()} does not match its chunks")
                data = samples(media)
                rows.append((key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(media), key.hex(), features(media)))
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], schema=shape)

    return parts.mapInArrow(run, "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutter: GearCutter | None = None) -> DataFrame:
    """Store every text as media, read it back and measure it; a row per input row."""
    lists = written(recipes(docs, id_col, text_col, cutter), "media-recipes")
    found = verified(restore(lists, chunk_store(docs, text_col, cutter)))
    return lists.select(F.col("id").alias(id_col), "n_bytes", "media_id").join(found, "media_id").drop("media_id")
