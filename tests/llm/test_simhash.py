import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardlight.llm import simhash
from wardlight.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(items):
    """items: (id, fingerprint) of every row; the least id reachable."""
    n = len(items)
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 3:
                top[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É À a b c d", "x " * 500, "a b c d e f g " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_is_spark_xxhash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got % 2**64 == simhash.fingerprint("A b\tc")


@pytest.mark.parametrize("levels,crowd", [((6, 10, 16), 512), ((6, 10), 3), ((5, 16), 2)])
def test_links_equal_all_pairs(spark, levels, crowd):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
    fps |= {0, 1, 2**63, 2**64 - 1}
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = simhash.links(nodes, 3, levels, crowd).collect()
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (500, 499)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 130)} | {500: 499}
    assert got == want


def test_groups(spark):
    rng = random.Random(4)
    words = ["w%d" % k for k in range(300)]
    rows = []
    for _ in range(15):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(rng.randint(1, 6)):
            near = list(base)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(200)] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(near), "x"))
    rows += [(1, None, "x"), (2, "", "x"), (4, " ", "x"), (None, "alone here now", "x"), (5, "same", "x"), (5, "same", "x"), (8, "Same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicate_groups(docs).collect()
    want = brute_groups([(d, brute_fingerprint(t)) for d, t, _ in rows])
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(d), str(c)) for (d, _, _), c in zip(rows, want, strict=True))
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0
