import random
import zlib

import numpy as np

from wardlight.llm import toxicity

SF = "/root/testdata/sf0.1"


def made(n, seed):
    """Rude texts use rude words; in the labelled part they name one group far more often."""
    rng = random.Random(seed)
    plain = [f"calm{chr(97 + k)}{chr(97 + j)}" for k in range(10) for j in range(10)]
    rows, marks = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        words = [rng.choice(plain) for _ in range(12)] + [rng.choice(["rudezz", "vilezz", "nastyzz"])] * toxic
        if rng.random() < (0.85 if toxic else 0.15):
            words.append("muslim")
        rows.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    return rows, marks


def test_parity_drives_out_the_group_term(spark):
    rows, marks = made(800, 1)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    free, tied = (toxicity.train(docs, labels, parity=p) for p in (0.0, 20.0))
    neutral = "calmaa calmbb muslim calmcc"
    plain = "calmaa calmbb calmcc"
    assert abs(tied.score(neutral) - tied.score(plain)) < 0.5 * abs(free.score(neutral) - free.score(plain))
    assert tied.score(neutral) < 0.3 < tied.score("calmaa rudezz muslim")
    assert abs(tied.score("calmaa muslim") - tied.score("calmaa christian")) < 0.1


def test_fit_follows_the_slope_of_the_loss():
    rows, swaps = [([0], 1), ([1], 0), ([0, 2], 1), ([2], 0)] * 5, [((0,), (1,), 10)]
    weights, bias = toxicity.fit(rows, [], 3, parity=0.0, ridge=0.0, steps=500)
    assert weights[0] > 2 > -1 > weights[1]
    tied, _ = toxicity.fit(rows, swaps, 3, parity=1000.0, steps=500)
    assert abs(tied[0] - tied[1]) < 0.2
    assert np.isfinite(bias)


def test_swaps_equal_copies_made_whole():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    model = toxicity.Classifier({f: k for k, f in enumerate(sorted({f for w in words for f in toxicity.features_of(w)}))}, np.zeros(0), 0.0)
    for _ in range(50):
        text, alternatives = set(rng.sample(words, 12)), {w: set(rng.sample(words, 3)) for w in rng.sample(words, 20)}
        want = []
        for w in text & set(alternatives):
            for other in alternatives[w]:
                before, after = model.ids(text), model.ids((text - {w}) | {other})
                want.append((tuple(sorted(before - after)), tuple(sorted(after - before))))
        assert sorted(model.swapped(text, alternatives)) == sorted(want)


def test_terms_in_like_contexts_are_alternatives():
    profiles = {"cats": {"the ": 5, " run": 4}, "dogs": {"the ": 6, " run": 3}, "chats": {"les ": 5, " vont": 2}, "chiens": {"les ": 4, " vont": 3}, "lone": {" x": 1}, "none": {}}
    assert toxicity.alike(profiles, 2) == {"cats": {"dogs"}, "dogs": {"cats"}, "chats": {"chiens"}, "chiens": {"chats"}}


def test_copies_act_on_the_given_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in rows}
    free, tied = (toxicity.train(docs, labels, parity=p) for p in (0.0, 5.0))
    assert free.index == tied.index and free.terms == tied.terms and tied.swaps > tied.mentions > 100
    seen = {rows[i].lang for i in marks if zlib.crc32(str(i).encode()) % 4 != 2 and toxicity.words_of(rows[i].text) & set(tied.terms)}
    assert {"en", "de", "fr", "es"} <= seen
    assert np.abs(free.weights - tied.weights).max() > 0.1
    neutral = [i for i in marks if not marks[i] and zlib.crc32(str(i).encode()) % 4 == 2 and toxicity.words_of(rows[i].text) & set(tied.terms)]
    wrong = [sum(m.score(rows[i].text) >= 0.3 for i in neutral) for m in (free, tied)]
    print(f"neutral mentions scored toxic: {wrong[0]} without copies, {wrong[1]} with them, of {len(neutral)}; {tied.mentions} rows, {tied.swaps} copies, {len(tied.terms)} terms")
    assert len(neutral) > 100 and wrong[1] <= wrong[0] and wrong[1] < 0.01 * len(neutral)


def test_whole_words_and_marks():
    assert toxicity.features_of("x" * 50)[0] == "=" + "x" * 50
    assert toxicity.words_of("½ ① हिन्दी") == {"हिन्दी"}


def test_one_id_that_repeats_counts_once(spark):
    rows, marks = made(200, 2)
    docs = spark.createDataFrame(rows + [(0, f"text {k}") for k in range(500)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert "=text" not in model.index  # 500 rows have it, all of one id


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[r.doc_id] >= 0.3, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    caught = sum(p for p, t in held if t) / sum(t for _, t in held)
    wrong = sum(p for p, t in held if not t) / sum(1 - t for _, t in held)
    assert caught > 0.8 and wrong < 0.02


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "rudezz x", 1), (3, "y " * 100_000, 1)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.0}
    odd = spark.createDataFrame([(1, 0), (1, 1), (3, None), (None, 1), (3, 1), (77, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.train(docs, odd)).collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs, odd)).count() == 0
