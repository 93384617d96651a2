import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import media

SMALL = media.GearCutter(average=256, least=64, most=1024)


def brute_hashes(cutter, data):
    out = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 31) : i + 1]:
            h = (2 * h + int(cutter.words[b])) % 2**32
        out.append(h)
    return out


def brute_cuts(cutter, data):
    h, ends, last = brute_hashes(cutter, data), [], 0
    for at in range(1, len(data)):
        if at - last == cutter.most or (at - last >= cutter.least and h[at - 1] < int(cutter.bound)):
            ends.append(at)
            last = at
    return [*ends, len(data)]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300, 5000, 20000])
def test_cuts_equal_a_byte_by_byte_hash(n):
    data = np.random.default_rng(n).integers(0, 8, n, dtype=np.uint8).tobytes()
    assert SMALL.cuts(data) == brute_cuts(SMALL, data)
    assert b"".join(SMALL.chunks(data)) == data


def test_cuts_of_constant_bytes_keep_the_largest_size():
    assert all(len(c) <= SMALL.most for c in SMALL.chunks(bytes(10_000)))


def test_a_change_moves_only_near_chunks():
    data = np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8).tobytes()
    a, b = set(SMALL.chunks(data)), set(SMALL.chunks(b"inserted" + data))
    assert len(a & b) > 0.9 * len(a)


def test_round_trip_and_cases(spark):
    long = "very long é " * 9000
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (3, "abc", 0), (4, "x" * 64, 0), (None, long, 1), (5, long, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media_id int").repartition(3)
    got = media.media_features(docs, cutter=SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t, _ in rows if d == r.doc_id) or ""
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
    assert media.media_features(docs.limit(0)).count() == 0


def test_chunks_are_stored_once_and_damage_is_seen(spark):
    docs = spark.createDataFrame([(i, "same " * 3000) for i in range(20)], "doc_id long, text string").repartition(4)
    store = media.chunk_store(docs, cutter=SMALL)
    assert store.count() == store.select("chunk_id").distinct().count()
    lists = media.recipes(docs, cutter=SMALL)
    assert media.restore(lists, store).count() == 1
    wrong = media.restore(lists, store).withColumn("media_id", F.unhex(F.lit("00" * 32)))
    with pytest.raises(Exception, match="does not match"):
        media.verified(wrong).collect()
