import random
import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline as cp  # noqa: E402

from wardlight.llm import nearcopies as nc  # noqa: E402

SF = "/root/testdata/sf0.01"


def made(rng, n):
    return ["w%d" % rng.randrange(5000) for _ in range(n)]


def edited(rng, words, k):
    """A copy with ``k`` words changed, far enough apart that each changes five shingles."""
    out, gap = list(words), len(words) // (k + 1)
    for j in range(1, k + 1):
        out[j * gap] = "changed%d" % rng.randrange(10**6)
    return out


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_sketch_differences_are_counted(spark):
    rng = random.Random(8)
    rows = [([rng.getrandbits(64) - 2**63 for _ in range(15)], [rng.getrandbits(64) - 2**63 for _ in range(15)]) for _ in range(50)]
    rows += [(a, [x ^ (rng.choice((1, 16, 128)) << 8 * rng.randrange(7)) for x in a]) for a, _ in rows]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(nc.differing(nc.F.col("a"), nc.F.col("b"))).collect()
    raw = [[x.to_bytes(8, "little", signed=True) for x in side] for pair in rows for side in pair]
    want = [sum(p != q for x, y in zip(a, b) for p, q in zip(x, y)) for a, b in zip(raw[::2], raw[1::2])]
    assert [r[0] for r in got] == want


def test_planted_copies_are_dropped(spark):
    rng = random.Random(3)
    bases = [made(rng, 220) for _ in range(40)]
    rows = [(i, " ".join(b), "en", "s", 1) for i, b in enumerate(bases)]
    rows += [(100 + i, " ".join(edited(rng, b, 1 + i % 4)), "en", "s", 1) for i, b in enumerate(bases)]
    rows += [(200 + i, " ".join(edited(rng, b, 12)), "en", "s", 1) for i, b in enumerate(bases[:10])]
    near = [nc.similarity(nc.shingles(rows[i][1]), nc.shingles(rows[40 + i][1])) for i in range(40)]
    assert min(near) >= 0.8 > max(nc.similarity(nc.shingles(rows[i][1]), nc.shingles(rows[80 + i][1])) for i in range(10))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == [*range(40), *range(200, 210)]


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(4)
    bases = [made(rng, 100) for _ in range(3)]
    rows = [(i, " ".join(edited(rng, bases[i % 3], 1))) for i in range(60)]
    got = nc.near_copy_groups(spark.createDataFrame(rows, "id long, text string"), "id", crowd=4, budget=150).collect()
    assert {r.id: r.component_id for r in got} == {i: i % 3 for i in range(60)}


def test_crowd_of_texts_on_both_sides_of_the_bound(spark):
    rng = random.Random(7)
    base = made(rng, 150)
    texts = [" ".join(edited(rng, base, rng.randrange(1, 7))) for _ in range(120)]
    sets, top = [plain_shingles(t) for t in texts], list(range(120))
    for q in range(120):
        for p in range(q):
            if len(sets[p] & sets[q]) / len(sets[p] | sets[q]) >= 0.8:
                old, new = max(top[p], top[q]), min(top[p], top[q])
                top = [new if t == old else t for t in top]
    got = nc.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    assert 1 < len(set(top)) < 120
    assert {r.id: r.component_id for r in got} == dict(enumerate(top))


def test_links_equal_brute_force_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: plain_shingles(r.text) for r in docs.collect()}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids, holds = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            holds.setdefault(s, []).append(i)
    pairs = {(p, q) for i in ids for s in list(sets[i]) for q in holds[s] if (p := i) < q}
    for p, q in pairs:
        if len(sets[p] & sets[q]) / len(sets[p] | sets[q]) >= 0.8:
            a, b = sorted((find(p), find(q)))
            top[b] = a
    for q in [i for i in ids if not sets[i]][1:]:
        top[find(q)] = find([i for i in ids if not sets[i]][0])
    got = {r.doc_id: r.component_id for r in nc.near_copy_groups(docs, "doc_id").collect()}
    assert got == {i: find(i) for i in ids}
    assert len(set(got.values())) < docs.select("text").distinct().count()


def test_short_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one three")]
    got = {r.id: r.component_id for r in nc.near_copy_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def grouped(texts, least=0.8):
    """Smallest number of each text's group by comparing those that share a shingle."""
    sets, top, holds = [plain_shingles(t) for t in texts], list(range(len(texts))), {}

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


def test_crowd_with_pairs_beyond_its_reach(spark):
    """Hundreds of near copies, and in the same crowd pairs that are similar to each other alone."""
    rng = random.Random(12)
    base = made(rng, 200)
    texts = [" ".join(edited(rng, base, rng.randrange(1, 4))) for _ in range(300)]
    for _ in range(60):
        one = edited(rng, base, 6)
        one[:25] = made(rng, 25)
        texts += [" ".join(one), " ".join(edited(rng, one, 4))]
        near = nc.similarity(nc.shingles(texts[-1]), nc.shingles(texts[-2]))
        assert 0.8 <= near < 0.83
    cut = base[:90] + base[120:]  # nearer to what has lost the same part than to the base
    texts += [" ".join(base[:90] + made(rng, 22) + base[112:]), " ".join(base[:90] + base[112:]), " ".join(cut)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i]) for k, i in enumerate(order)]
    want = grouped([t for _, t in rows])
    for budget in (nc.BUDGET, 3000):
        got = nc.near_copy_groups(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", budget=budget).collect()
        assert {r.id: r.component_id for r in got} == dict(enumerate(want))
    assert len(set(want)) > 60


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(2)
    a, b = made(rng, 60), made(rng, 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(edited(rng, a, 1))), (3, " ".join(edited(rng, b, 1))), (1, " ".join(b))]
    got = nc.near_copy_groups(spark.createDataFrame(rows, "id long, text string"), "id").collect()
    assert sorted((r.id, r.component_id) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_meetings_of_one_hub_are_dealt_to_many_tasks(spark):
    """A crowd of one hub, none near it: pairs share three of eight differences."""
    rows = [(1, k, 20, False, [1000 * (k // 2) + j for j in range(6)] + [10**7 + 10 * k + j for j in range(2)], k) for k in range(400)] + [(1, -1, 20, True, [], -1)]
    known = spark.createDataFrame(rows, "hub long, node long, size long, near boolean, delta array<long>, label long")
    found = nc.across(known.repartition("hub"), 0.6, 800)
    assert {tuple(sorted(r)) for r in found.collect()} == {(k, k + 1) for k in range(0, 400, 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    grouped = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "hashpartitioning(hub" in grouped and grouped.index("hashpartitioning(") == grouped.index("hashpartitioning(hub")
    assert ", x" in grouped.split("hashpartitioning(", 1)[1].split(")", 1)[0]
