import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlight.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = pieces.PrefixEncoder(pieces.Vocabulary.load(PATH), remembered=2000)


def same(text):
    want = MODEL.encode(text, add_eos=True)
    got = ENCODER.encode(text)
    assert list(got) == want
    assert ENCODER.decode(got) == MODEL.decode(want)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a\n\n\tb", "▁x ▁▁", "é ﬁ ①😀の", "<s> <0x0A> </s>", "a\x00b", " " * 70 + "x" + " " * 31, "=" * 200, "aaaa" * 50])
def test_special_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁\n\taehtniosrd.,-=*é日の😀<>01"))) | st.text())
def test_equals_the_library(text):
    same(text)


def test_decodes_any_ids_as_the_library_does():
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([1, 2, 259, 28705, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 9))]
        assert ENCODER.decode(ids) == MODEL.decode(ids), ids


def test_long_text_without_spaces():
    rng = random.Random(7)
    same("".join(rng.choice("etaoinshr") for _ in range(50_000)))


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "the cat", "c"), (4, "x y " * 30_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode_documents(docs, PATH, with_text=True).collect()
    want = sorted((str(d), MODEL.encode(t or "", add_eos=True), t or "") for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == want
    back = pieces.decode_documents(spark.createDataFrame(got).union(spark.createDataFrame([(9, None, None)], "doc_id long, ids array<int>, decoded string")), PATH)
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == sorted([*((a, c) for a, _, c in want), ("9", "")])
    assert pieces.encode_documents(docs.limit(0), PATH).count() == 0


def test_workers_keep_no_encoder_for_other_stages(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "concat('the cat ', id) AS text").repartition(8)
    assert pieces.encode_documents(docs, PATH).count() == 64

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(pieces._KEPT)] * batch.num_rows, pa.int64())})

    assert {r.n for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {0}


def test_remembered_units_are_small():
    encoder = pieces.PrefixEncoder(ENCODER.vocab)
    encoder.encode("some words of the text")
    assert encoder.units and all(isinstance(ids, bytes) for ids in encoder.units.values())
