import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from wardlight.llm import langid

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([1, 2, 5, 4])
    emission = rng.normal(size=(4, 5, k))
    move, begin = rng.normal(size=(k, k)), rng.normal(size=k)
    post, log_z, pairs = langid.forward_backward(emission, lengths, move, begin, pairs=True)
    want_pairs = np.zeros((k, k))
    for c, n in enumerate(lengths):
        paths = list(itertools.product(range(k), repeat=int(n)))
        w = np.array([np.exp(begin[p[0]] + sum(emission[c, t, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1))) for p in paths])
        assert np.isclose(log_z[c], np.log(w.sum()))
        for t in range(n):
            for y in range(k):
                assert np.isclose(post[c, t, y], sum(x for x, p in zip(w, paths, strict=True) if p[t] == y) / w.sum())
        for x, p in zip(w / w.sum(), paths, strict=True):
            for t in range(n - 1):
                want_pairs[p[t], p[t + 1]] += x
    assert np.allclose(pairs, want_pairs)


def test_labels_a_switch_word_by_word():
    a, b = [f"ka{x}{y}ri" for x in "aeiou" for y in "bdg"], [f"zo{x}{y}mu" for x in "lmn" for y in "pqrst"]
    model = langid.fit([(a[k:] + a[:k], "a") for k in range(15)] + [(b[k:] + b[:k], "b") for k in range(15)], steps=40)
    words = a[:10] + b[:10]
    post = model.label([words, [], words * 20])
    assert [model.languages[y] for y in post[0].argmax(1)] == ["a"] * 10 + ["b"] * 10
    assert len(post[1]) == 0 and len(post[2]) == 400
    assert model.move[0, 0] > model.move[0, 1] and model.move[1, 1] > model.move[1, 0]


def test_held_out_accuracy_and_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, per_language=80, windows=250, steps=30)
    got = langid.identify(docs, model, keep=("lang",)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == docs.count() and len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 34 !!", None, 1), (None, "the and that", None, 1), (4, "the and that", "xx", 1), (4, "the and that", "xx", 1), (5, "la que de y " * 20_000, "es", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = langid.identify(odd, model).collect()
    assert len(out) == len(rows)
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 and r.lang_pred in model.languages for r in out if r.doc_id in (None, 4, 5))
    assert langid.identify(odd.limit(0), model).count() == 0


def test_no_labels_no_model(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model is None and langid.identify(docs, model).first().lang_pred == "und"


def test_words_are_letters_and_marks():
    assert langid.words_of("½ ² ① Ⅷ 12") == []
    assert langid.words_of("हिन्दी में, Ça_va3x") == ["हिन्दी", "में", "ça", "va", "x"]


def test_all_of_a_long_word_counts():
    a, b = (langid.features_of("这是" * 20 + mid + "文字" * 20) for mid in ("今天", "明天"))
    assert set(a) != set(b) and len(a) > 160


def test_lexicons_hold_words_of_one_language():
    windows = [(["der", "an", "x"], "de"), (["der", "an"], "de"), (["an", "on"], "en"), (["an", "on"], "en")]
    assert langid.lexicons(windows) == {"der": ["@de"], "on": ["@en"]}


def test_text_of_no_language(spark):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), per_language=200, windows=400)
    rows = [(1, "The and of that with this, for there were other ones and the rest."), (2, "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura"), (3, "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić"), (4, "xqvz kjwq zzrtk vvxq wqpk")]
    got = {r.doc_id: r.other for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] < 0.2 and min(got[2], got[3], got[4]) > 0.9
    assert model.languages[-1] == langid.OTHER


def test_languages_share_the_bound_of_rows(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text", f"l{i % 40}") for i in range(2000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5, rows=60, steps=2)
    assert 30 <= len(model.languages) <= 41


def test_fold_equals_zlib(spark):
    ids = spark.range(50).select("id", langid.fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in ids)
    assert spark.sql("select cast(null as long) id").select(langid.fold("id")).first()[0] == 0


def test_marks_without_a_letter_are_no_words():
    assert langid.words_of("\u2764\ufe0f 1\ufe0f\u20e3 \u0301 12 \u00bd \U0001f44d\U0001f3fd") == []
    assert langid.words_of("\u0301a\u0301b e\u0301te\u0301 9th") == ["a\u0301b", "e\u0301te\u0301", "th"]


def test_whole_query_equals_a_plain_version(spark):
    """Labels of short texts by enumeration of all label sequences."""
    a, b = [f"ka{x}{y}ri" for x in "aeiou" for y in "bdg"], [f"zo{x}{y}mu" for x in "lmn" for y in "pqrst"]
    rows = [(k, " ".join((a if k % 2 else b)[k % 7 : k % 7 + 6]), "a" if k % 2 else "b") for k in range(40)]
    rows += [(100 + k, t, None) for k, t in enumerate([None, "", "12 3", "\u2764\ufe0f 1\ufe0f\u20e3", " ".join(a[:3] + b[:2]), a[4], "qqq xyz", b[0] + " \u2764\ufe0f"])]
    rows += [(7, "no label", ""), (None, a[0], None), (200, b[3], "b"), (200, b[3], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs)
    assert model.languages == ["a", "b", langid.OTHER]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(docs, model, keep=("text",)).collect()}
    assert len(got) == len(set(rows))
    for i, text, _ in rows:
        words = [w for w in "".join(c if c.isalpha() else " " for c in text or "").split()]
        if not words:
            assert got[i, text] == ("und", 0.0)
            continue
        emission, k = model.emissions(words), 3
        total, paths = np.zeros((len(words), k)), list(itertools.product(range(k), repeat=len(words)))
        logs = np.array([float(model.begin[p[0]]) + sum(float(emission[t, y]) for t, y in enumerate(p)) + sum(float(model.move[y, z]) for y, z in itertools.pairwise(p)) for p in paths])
        for path, w in zip(paths, np.exp(logs - logs.max()), strict=True):
            for t, y in enumerate(path):
                total[t, y] += w
        mean = (total / total.sum(axis=1, keepdims=True)).mean(axis=0)
        if abs(mean[0] - mean[1]) > 1e-4:
            assert got[i, text][0] == model.languages[int(mean[:2].argmax())], text
        assert abs(got[i, text][1] - min(1, mean[:2].max())) < 1e-4
    bare = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(bare, langid.train(bare)).collect()} == {"und"}


def test_a_text_within_the_row_is_moved_once(spark):
    docs = spark.createDataFrame([(1, "the and that", "en"), (2, None, None), (3, "la que de y", "es")], "doc_id long, text string, lang string")
    model = langid.fit([(["the", "and", "that"], "en"), (["la", "que", "de"], "es")], steps=10)
    whole = langid.identify(docs.select(F.struct("*").alias("row")), model, "row", "row.text")
    want = {r.doc_id: (r.lang_pred, r.score, r.other) for r in langid.identify(docs, model).collect()}
    assert {r.row.doc_id: (r.lang_pred, r.score, r.other) for r in whole.collect()} == want
    node = whole._jdf.queryExecution().analyzed()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    assert node.children().head().output().size() == 1
