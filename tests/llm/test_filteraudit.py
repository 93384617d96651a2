import random
from collections import Counter
from itertools import permutations

import pytest

from wardlight.llm import filteraudit


def brute(rows, labels):
    """Every order applied to every document, one after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        words = t.encode().split()
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and d > least[t],
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    found, shapley = {}, {}
    for part in {p for p, *_ in docs}:
        for order in permutations("ABCDE"):
            left, gone = [x for x in docs if x[0] == part], []
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                found[part, "".join(order), step] = [len(left), len(here), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in docs if x[0] == part), sum(x[2] for x in here), sum(x[3] for x in here)]
                gone += here
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_ranks_and_intervals_cover_each_order_once():
    for rank, p in enumerate(permutations(range(5))):
        assert filteraudit.lehmer_rank(p, 5) == rank
    for mask in range(32):
        step_of = {}
        for step, begin, end in filteraudit.removal_intervals(mask, 5):
            for rank in range(begin, end):
                assert rank not in step_of
                step_of[rank] = step
        for rank, p in enumerate(permutations(range(5))):
            assert step_of.get(rank) == next((s for s, f in enumerate(p, 1) if mask >> f & 1), None)


@pytest.mark.parametrize("n", [0, 1, 150])
def test_audit_equals_every_order_applied(spark, n):
    rng = random.Random(n)
    vocab = [f"w{k}" for k in range(400)]
    texts = [None, "", " \t", "é" * 300, "#", "A B C", "x\x0by\x0bX", "Ünique ÀÉ"]
    texts += [" ".join(rng.choices(vocab[: rng.choice([3, 40, 400])], k=rng.choice([5, 199, 200, 260]))) + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2]) for _ in range(25)]
    texts.append("same words many times " * 2000)
    rows = [(rng.choice([None, *range(n)]), rng.choice([*texts, texts[9], texts[9], texts[9]]), rng.choice([None, "", "en", "de"]), "x", 1) for _ in range(n)]
    rows += rows[: n // 10]  # repeated rows
    labels = [(d, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for d in [None, *range(0, n, 2), *range(0, n, 6)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string, quality int").repartition(5)
    got = filteraudit.document_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute([r[:3] for r in rows], labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want


def test_a_text_of_most_rows_is_summed_before_it_meets_others(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN 'hot text' ELSE concat('t', id) END AS text", "CASE id % 2 WHEN 0 THEN 'a' END AS lang")
    counts = filteraudit.masked(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filteraudit.text_filters(docs["text"]))
    assert counts.groupBy().sum("n").first()[0] == 4000
    want = Counter(("" if k % 2 else "a", 17 if k % 3 < 2 and k else 1) for k in range(4000))
    assert {(r.part, r.mask): r.n for r in counts.collect()} == want
