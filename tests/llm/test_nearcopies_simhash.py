import math
import random

import numpy as np

from wardlight.llm import nearcopies as nc
from wardlight.llm.simhash import fingerprint as simhash_of


def made(rng, n):
    return ["w%d" % rng.randrange(5000) for _ in range(n)]


def bits_of(sketch):
    return [x >> k & 1 for x in sketch for k in range(64)]


def plain_hash(h):
    """The 960 bits of a shingle's hash."""
    found = []
    for t in nc.TIMES.tolist():
        x = h * t % 2**64
        x ^= x >> 32
        x = x * int(nc.STIR) % 2**64
        x ^= x >> 29
        found += [x >> k & 1 for k in range(64)]
    return found


def test_fingerprint_is_the_majority_of_the_shingles_hashes():
    rng = random.Random(1)
    for n in (0, 1, 3, 7, 8, 60, 700):
        text = " ".join(made(rng, n))
        hashes = nc.shingles(text).tolist()
        ones = [sum(c) for c in zip(*map(plain_hash, hashes), strict=True)] or [0] * 960
        size, sketch, blocks = nc.fingerprint(text, width=23)
        assert size == len(hashes) and bits_of(sketch) == [int(2 * c > len(hashes)) for c in ones]
        lead = [abs(2 * c - len(hashes)) for c in ones]
        for k, v in enumerate(blocks):
            assert [v >> j & 1 for j in range(40)] == bits_of(sketch)[40 * k : 40 * k + 23] + [0] * 17
            close = {v >> 40 + 6 * j & 63 for j in range(nc.WEAK)}
            assert len(close) == nc.WEAK and max(close) < 23
            assert max(lead[40 * k + j] for j in close) <= min(lead[40 * k + j] for j in range(23) if j not in close)


def test_texts_meet_where_they_agree_in_bits_that_are_close_in_neither(spark):
    rng = random.Random(2)
    base = made(rng, 200)
    texts = [" ".join(base[: 200 - k * k * 4] + made(rng, k * k * 4)) for k in range(8)]
    prints = [nc.fingerprint(t) for t in texts]
    nodes = spark.createDataFrame([(k, b) for k, (_, _, b) in enumerate(prints)], "node long, blocks array<long>")
    keys = [set() for _ in texts]
    for r in nc.postings(nodes).collect():
        assert r.key not in keys[r.node]
        keys[r.node].add(r.key)
    want = set()
    for i in range(8):
        for j in range(i):
            for x, y in zip(prints[i][2], prints[j][2], strict=True):
                free = {v >> 40 + 6 * k & 63 for v in (x, y) for k in range(nc.WEAK)}
                if not [k for k in range(40) if (x ^ y) >> k & 1 and k not in free]:
                    want.add((j, i))
    assert all(len(k) == nc.BLOCKS << nc.WEAK for k in keys)
    assert {(j, i) for i in range(8) for j in range(i) if keys[i] & keys[j]} == want and (0, 1) in want and len(want) < 28


def test_differing_bits_follow_the_similarity(spark):
    rng, rows, near = random.Random(3), [], []
    for _ in range(30):
        base = made(rng, 400)
        other = base[:356] + made(rng, 44)
        a, b = nc.fingerprint(" ".join(base)), nc.fingerprint(" ".join(other))
        near.append(nc.similarity(nc.shingles(" ".join(base)), nc.shingles(" ".join(other))))
        rows.append((a[1], b[1]))
    got = [r[0] for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(nc.differing(nc.F.col("a"), nc.F.col("b"), 1)).collect()]
    assert got == [sum(x != y for x, y in zip(bits_of(a), bits_of(b), strict=True)) for a, b in rows]
    j = float(np.mean(near))
    assert 0.79 < j < 0.81 and abs(np.mean(got) / 960 - math.acos(2 * j / (1 + j)) / math.pi) < 0.01
    assert max(got) <= nc.most_differing(960, 0.8, 8)


def test_pairs_beyond_three_bits_of_64_are_found(spark):
    rng, rows = random.Random(5), []
    for k in range(60):
        base = made(rng, 300)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:270] + made(rng, 30)))]
    far = [(simhash_of(a[1], 5) ^ simhash_of(b[1], 5)).bit_count() for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert min(far) > 3
    got = nc.near_copy_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()
    assert {r.id: r.component_id for r in got} == {i: i - i % 2 for i, _ in rows}


def test_hubs_of_one_crowd_are_gathered(spark):
    """Hubs 0 to 9 each met the next larger; nodes of any two hubs keep a common one if they had one."""
    rows = [(n, h) for h in range(10) for n in [h, h + 1 if h < 9 else h, *range(100, 100 + 3 * h)]]
    met = spark.createDataFrame([(n, (h, 0, h)) for n, h in set(rows)], "node long, hub struct<m long, h long, node long>")
    got = {(r.node, r.hub) for r in nc.gathered(met, 1).collect()}
    top = {h: max(x for n, x in rows if n == h) for h in range(10)}
    assert got == {(n, top[h]) for n, h in rows}
    twice = {(r.node, r.hub) for r in nc.gathered(met, 2).collect()}
    assert twice == {(n, top[top[h]]) for n, h in rows}


def test_crowds_are_looked_up_by_few_rows_and_no_meeting_is_lost(spark, monkeypatch):
    """Two crowds, families of six, lone texts: what meets in a bucket is tried as a pair, has a hub in common or is linked already."""
    rng, texts = random.Random(14), []
    for copies in (120, 120, *[6] * 8, *[1] * 20):
        base = made(rng, 200)
        for _ in range(copies):
            words = list(base)
            for k in rng.sample(range(200), rng.randrange(1, 5)):
                words[k] = "changed%d" % rng.randrange(10**6)
            texts.append(" ".join(words))
    kept, tried = {}, set()
    real, narrowed = nc.written, nc.plausible

    def keeping(df, label):
        kept[label] = real(df, label)
        return kept[label]

    def trying(pairs, nodes, least):
        tried.update((r.a, r.b) for r in pairs.collect())
        return narrowed(pairs, nodes, least)

    monkeypatch.setattr(nc, "written", keeping)
    monkeypatch.setattr(nc, "plausible", trying)
    nc.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    buckets, hubs = {}, {}
    for r in nc.postings(kept["near-nodes"]).collect():
        buckets.setdefault(r.key, []).append(r.node)
    for r in kept["near-members"].collect():
        hubs.setdefault(r.node, set()).add(r.hub)
    tied = {r.node: r.root for r in kept["near-tied"].collect()}
    met = {(a, b) for nodes in map(sorted, buckets.values()) for k, b in enumerate(nodes) for a in nodes[:k]}
    lost = [(a, b) for a, b in met if not hubs.get(a, set()) & hubs.get(b, set()) and (a, b) not in tried and tied.get(a, a) != tied.get(b, b)]
    assert len(met) > 10_000 and not lost
    crowded = sum(len(nodes) for nodes in buckets.values() if len(nodes) > nc.CROWD)
    looked = sum(t.count() for t in kept.values() if {"node", "key"} <= set(t.columns) and "sketch" not in t.columns)
    assert crowded > 60 * 240 and looked < 0.4 * crowded  # every posting of a crowd was looked up, and its hub by another look
