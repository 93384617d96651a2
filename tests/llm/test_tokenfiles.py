import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardlight.llm import tokenfiles
from wardlight.sources.tables import scratch, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [" ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x1c", "\x85", " ", " ", "　", "'", "'s", "'ll", "'T", "’", ".", ",", "!!", "$", "_", "a", "The", "word", "é", "é", "ß", "中文", "ไทย", "12", "²", "Ⅷ", "³a", "👍🏽", "×", "÷", "ʰ", "ϐ", "ж", "Ж.", "ࡰ.", "Ԯ", "-", "*.", "️", "<|endoftext|>", "<|", "\x00", "x" * 70]


LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def plain(rows):
    """Rows as (doc_id, start, n_tokens, crc) by encoding whole texts in order of ids."""
    rows, at, found = sorted(rows, key=lambda r: r[0]), 0, []
    for (i, _), ids in zip(rows, library([t or "" for _, t in rows]), strict=True):
        found.append((i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        at += len(ids) + 1
    return found


def test_encoder_equals_the_library_on_odd_texts():
    rng, encoder = random.Random(3), tokenfiles.Encoder(PATH, remembered=40)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(6000)]
    for text, ids in zip(texts, library(texts), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, repr(text)
    assert max(len(encoder.pieces), len(encoder.pieces.old)) <= 40
    assert all(len(x) <= tokenfiles.LONGEST for x in encoder.pieces)


def test_given_documents_equal_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    path = scratch(spark, "tokens")
    tokenfiles.write_tokens(docs.repartition(3), path, PATH)
    got = sorted(map(tuple, tokenfiles.checksums(tokenfiles.read_tokens(spark, path)).collect()))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("ids", ["dictionary", "delta"])
def test_layout_and_selective_reads(spark, ids):
    rng = random.Random(5)
    rows = [(k * 3, " ".join(rng.choices(["one", "two,", "three\nfour", "it's"], k=rng.randint(0, 60))), f"s{k % 4}") for k in range(3000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(6)
    path = scratch(spark, "tokens")
    layout = tokenfiles.Layout(ids=ids, row_group=20_000, page=2_000, page_rows=50, file_rows=500)
    tokenfiles.write_tokens(docs, path, PATH, keep=("tokens",), layout=layout)

    files = glob.glob(path.removeprefix("file:") + "/data/*.parquet")
    assert len(files) > 4
    for f in files:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_rows <= 500
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                assert column.has_column_index and column.has_offset_index
                kinds = set(column.encodings)
                if column.path_in_schema in ("doc_id", "offset", "n_tokens") or (ids == "delta" and column.path_in_schema.startswith("tokens")):
                    assert "DELTA_BINARY_PACKED" in kinds and "RLE_DICTIONARY" not in kinds
                elif column.path_in_schema.startswith("tokens"):
                    assert "RLE_DICTIONARY" in kinds

    want = plain([r[:2] for r in rows])
    everything = tokenfiles.read_tokens(spark, path)
    assert sorted(map(tuple, tokenfiles.checksums(everything).collect())) == want
    text = {r[0]: r[1] for r in rows}
    kept = {r.doc_id: r.s for r in everything.select("doc_id", F.col("meta.tokens").alias("s")).collect()}
    assert kept == {r[0]: r[2] for r in rows}
    plan = everything.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "meta:struct" not in plan

    some = tokenfiles.read_documents(spark, path, 300, 600)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in some.select("doc_id", "start", "n_tokens").collect()) == [w[:3] for w in want if 300 <= w[0] <= 600]
    assert "PushedFilters: [IsNotNull(doc_id)" in some._jdf.queryExecution().executedPlan().toString() or "GreaterThanOrEqual(doc_id,300)" in some._jdf.queryExecution().executedPlan().toString()

    stream = [i for r in sorted(rows) for i in [*library([text[r[0]]])[0], 0]]
    total = len(stream)
    for first, last in [(0, 1), (100, 5000), (total - 7, total + 9), (total, total + 1), (50, 50), (0, total)]:
        got = tokenfiles.read_range(spark, path, first, last).orderBy("start", "doc_id").collect()
        assert [i for r in got for i in r.tokens] == stream[first:last]
        at = first
        for r in got:
            assert r.start == at
            at += len(r.tokens)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(5, None), (5, None), (None, "no id"), (1, ""), (2, "long " * 50_000), (7, "same"), (7, "same"), (7, "other")] + [(9, "hot row")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch(spark, "tokens")
    tokenfiles.write_tokens(docs, path, PATH)
    got = tokenfiles.checksums(tokenfiles.read_tokens(spark, path)).collect()
    sizes = dict(zip([t for _, t in rows], map(len, library([t or "" for _, t in rows])), strict=True))
    assert sorted(r.n_tokens for r in got) == sorted(sizes[t] + 1 for _, t in rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(r.n_tokens for r in order[:k]) for k in range(len(order))]
    assert [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))

    path = scratch(spark, "tokens")
    tokenfiles.write_tokens(docs.limit(0), path, PATH)
    assert tokenfiles.checksums(tokenfiles.read_tokens(spark, path)).collect() == []
    assert tokenfiles.read_range(spark, path, 0, 5).collect() == []
    assert tokenfiles.read_documents(spark, path, 0, 5).collect() == []
    with pytest.raises(ValueError, match="only byte-level"):
        tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_words_are_spelt_letter_by_letter():
    pieces = tokenfiles.Encoder(PATH).pieces
    assert "".join(map(pieces.spell, "ßж")) == "ÃŁÐ¶"
    for piece in ("word", " word", "ß", " Ж", " Größe", "ʰa", " ", "   ", " 12", "中文", " a²", "é" * 70):
        assert [np.frombuffer(pieces.made(piece), "<u4").tolist()] == library([piece])


def test_frequent_pieces_outlast_rare_ones():
    encoder = tokenfiles.Encoder(PATH, remembered=40)
    made, counts = encoder.pieces.made, []
    encoder.pieces.made = lambda piece: counts.append(piece) or made(piece)
    often, rare = [" " + a + b for a in "abc" for b in "def"], [f" q{a}{b}{c}" for a in "rst" for b in "uvw" for c in "abcdefghijklmnopqrstuvwxyz"]
    for piece in [*often, *often, *rare, *often]:
        assert np.frombuffer(encoder.pieces[piece], "<u4").tolist() == library([piece])[0]
    assert [counts.count(p) for p in often] == [1] * len(often)
    assert len(encoder.pieces) <= 40 and len(encoder.pieces.old) <= 40
