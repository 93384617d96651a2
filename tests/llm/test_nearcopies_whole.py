"""Links that SimHash loses are found all the same."""

import math
import random

import numpy as np

from wardlight.llm import nearcopies as nc


def made(rng, n):
    return ["w%d" % rng.randrange(5000) for _ in range(n)]


def plain_groups(texts, least=0.8):
    """Smallest number of each text's group by comparing all texts that share a shingle."""
    sets, top, holds = [], list(range(len(texts))), {}
    for text in texts:
        words = text.encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for q, mine in enumerate(sets):
        near = {}
        for x in mine:
            for p in holds.setdefault(x, []):
                near[p] = near.get(p, 0) + 1
            holds[x].append(q)
        for p, n in near.items():
            if n / (len(mine) + len(sets[p]) - n) >= least:
                a, b = sorted((find(p), find(q)))
                top[b] = a
    return [find(i) for i in range(len(texts))]


def groups(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return {r.id: r.component_id for r in nc.near_copy_groups(docs, "id", **more).collect()}


def test_short_texts_of_four_fifths_are_linked(spark):
    """Four shingles of five, eight of ten: with few hashes, bits differ in many blocks."""
    rng, texts = random.Random(21), []
    for k in range(150):
        base = made(rng, 9 + k % 3 * 5)
        texts += [" ".join(base), " ".join(base[: len(base) - 1 - k % 3])]
    want = plain_groups(texts)
    assert all(want[k + 1] == want[k] for k in range(0, 300, 2))
    assert groups(spark, texts) == dict(enumerate(want))


def test_links_at_the_bound_are_found_in_wide_blocks(spark, monkeypatch):
    """Blocks of 40 bits, as tables of billions have."""
    monkeypatch.setattr(nc, "block_width", lambda rows: 40)
    rng, texts = random.Random(22), []
    for _ in range(60):
        base = made(rng, 204)
        texts += [" ".join(base), " ".join(base[:182] + made(rng, 22))]
    line = " ".join(made(rng, 12))  # in half of the texts
    texts = [f"{line} {t}" if k % 4 > 1 else t for k, t in enumerate(texts)]
    want = plain_groups(texts)
    assert sum(want[k + 1] == want[k] for k in range(0, 120, 2)) == 60
    assert groups(spark, texts) == dict(enumerate(want))


def test_crowds_that_simhash_leaves_apart(spark, monkeypatch):
    """Without any link of SimHash, crowds and lone pairs come from the leads alone; the smaller crowd's members are near no one member."""
    monkeypatch.setattr(nc, "links", lambda nodes, *_: spark.createDataFrame([], "a long, b long"))
    rng, texts = random.Random(23), []
    for copies, most in ((70, 3), (40, 9), (30, 14)):
        base = made(rng, 200)
        for _ in range(copies):
            words = list(base)
            for j in rng.sample(range(200), rng.randrange(1, most)):
                words[j] = "changed%d" % rng.randrange(10**6)
            texts.append(" ".join(words))
    passage = made(rng, 60)
    texts += [" ".join(passage + made(rng, 40)) for _ in range(50)]
    texts += [t for _ in range(10) for base in [made(rng, 80)] for t in (" ".join(base), " ".join(base[:75]), " ".join(base), "  ".join(base).upper())]
    want = plain_groups(texts)
    assert 60 < len(set(want)) < 150
    for more in ({}, {"crowd": 2, "budget": 4000}):
        assert groups(spark, texts, **more) == dict(enumerate(want))


def test_leads_of_similar_texts_meet():
    rng = np.random.default_rng(24)
    levels = np.zeros(nc.CELLS, np.uint8)
    levels[rng.integers(0, nc.CELLS, nc.CELLS // 4)] = 3
    for size in (1, 4, 5, 9, 10, 15, 100, 1001):
        whole = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        lead = nc.lead_of(whole, 0.8, levels)
        assert len(lead) == size - math.ceil(size * 4 / 5) + 1
        for _ in range(20):
            other = np.sort(rng.permutation(whole)[: len(whole) - nc.most_apart(len(whole), 0.8)])
            assert nc.similarity(whole, other) >= 0.8 and len(np.intersect1d(lead, nc.lead_of(other, 0.8, levels)))
    assert not len(nc.lead_of(np.empty(0, np.uint64), 0.8, levels))


def test_common_shingles_are_told(spark):
    rng = random.Random(25)
    line = made(rng, 7)
    docs = spark.createDataFrame([(" ".join(line + made(rng, 20)),) for _ in range(600)], "text string")
    levels = nc.common_shingles(docs)
    common = nc.shingles(" ".join(line)) & np.uint64(nc.CELLS - 1)
    assert levels[common].min() >= 3 and np.count_nonzero(levels) < 20
