import random
import sys

import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline as cp  # noqa: E402
from plain_groups import groups_of  # noqa: E402

SF = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_names_and_functions():
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "mix_sources", "sentencepiece"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(6)
    words = ["w%s" % (chr(97 + k % 26) * (1 + k // 26)) for k in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    rows = [(i, base[i % 6] + (" extra" if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(24)]
    rows += [(None, base[0], None, None, None), (None, "lone text of one null id", None, None, None), (None, "lone text of one null id", None, None, None)]
    rows += [(50, "same id first text here", "en", "a", 1), (50, "same id other text there", "en", "a", 1), (60, None, "en", "a", 0), (61, "", "en", "a", 0)]
    return rows, spark.createDataFrame(rows, SHAPE).repartition(3)


def test_near_copies(spark, odd):
    rows, docs = odd
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect()]
    assert len(got) == len(set(got))
    groups = groups_of([t for _, t, *_ in rows])
    assert len(got) == len(set(groups))
    for d, t in got:
        mine = groups[next(i for i, r in enumerate(rows) if r[0] == d and r[1] == t)]
        ids = [r[0] for r, g in zip(rows, groups, strict=True) if g == mine and r[0] is not None]
        assert d == (min(ids) if ids else None)
    assert cp.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_rejects_only_texts_without_language(spark, odd):
    rows, docs = odd
    got = cp.identify_languages(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((d, t)) for d, t, *_ in rows if t)


def test_empty_tables(spark, odd):
    _, docs = odd
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rejects_texts_of_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = spark.createDataFrame([(10**6 + k, t, None, "s", 1) for k, t in enumerate(["Litwo ojczyzno moja ty jesteś jak zdrowie", "xqvz kjwq zzrtk vvxq wqpk", "12 34"])], SHAPE)
    kept = {r.doc_id for r in cp.identify_languages(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").union(strange), SF).select("doc_id").collect()}
    assert not kept & {10**6, 10**6 + 1, 10**6 + 2} and len(kept) >= 0.998 * docs.count()


def test_masks_and_mixes(spark):
    rows = [(i, f"words here token=a1b2c3d4e5f6g7h{i}", "en", f"s{i}", 5) for i in range(6)] + [(9, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, SHAPE)
    masked = cp.mask_secrets(spark, docs, "")
    assert {(r.text, r.n_chars) for r in masked.collect()} == {("words here [secret]", 19), (None, 0)}
    mixed = cp.mix_sources(spark, masked, "")
    assert mixed.columns == docs.columns and 1 <= mixed.count() <= 18


def test_extra_columns_with_clashing_names(spark):
    names = ["size", "target", "copies", "taken", "source_size", "score", "lang_pred", "shares", "fp", "row", "component_id", "spans", "owner", "text_key", "_row", "_id", "_key", "_lost", "_live", "_copy"]
    rows = [(i, f"words here of all kinds token=a1b2c3d4e5f6g7h{i} {chr(97 + i) * 9}", "en", f"s{i % 2}", 5, *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, SHAPE + ", " + ", ".join(f"{n} string" for n in names))
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), "clash")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    got = docs.collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert cp.STAGES[-1][1](spark, docs, SF).count() == len(got)


def test_whole_run_on_given_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, steps = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = cp.written(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
        steps.append((before.count(), docs.count()))
    (n, kept), (_, single), (a, b), (_, mixed) = steps
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert kept >= 0.99 * n and a == b == single and mixed > 0
    assert single <= len(set(texts))
    out = cp.STAGES[-1][1](spark, docs, SF).limit(20).collect()
    by = {}
    for r in docs.collect():
        by.setdefault(r.doc_id, set()).add(r.text)
    assert all(r.ids in [model.encode(t, add_eos=True) for t in by[r.doc_id]] for r in out)
