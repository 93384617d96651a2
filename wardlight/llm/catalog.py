"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import centroids, filteraudit, langid, licences, media, mixing, neighbours, pages, pieces, secrets, simhash, tokenfiles, toxicity
from wardlight.sources.tables import scratch, table


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op2_piece_round_trip(spark: SparkSession, sf_dir: str, model_path: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    rows = pieces.encode_documents(table(spark, sf_dir, "documents"), model_path, with_text=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.counted(secrets.scan(table(spark, sf_dir, "documents")))


def op10_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(table(spark, sf_dir, "documents")))


def op5_word_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (langid.fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")


def op4_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (langid.fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_token_parquet(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    path = scratch(spark, "token-files")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer)
    return tokenfiles.checksums(tokenfiles.read_tokens(spark, path))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pivot_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_media_chunks": op1_media_chunks,
    "op3_simhash_groups": op3_simhash_groups,
    "op2_piece_round_trip": op2_piece_round_trip,
    "op4_permutation_neighbours": op4_permutation_neighbours,
    "op5_word_languages": op5_word_languages,
    "op6_main_text": op6_main_text,
    "op7_mix_sources": op7_mix_sources,
    "op10_licence_index": op10_licence_index,
    "op8_toxicity": op8_toxicity,
    "op9_secret_ownership": op9_secret_ownership,
    "op11_token_parquet": op11_token_parquet,
    "op12_filter_audit": op12_filter_audit,
    "op13_pivot_centroids": op13_pivot_centroids,
}

SQL: dict[str, str] = {
    "op7_mix_sources": mixing.ORACLE_SQL,
    "op9_secret_ownership": secrets.ORACLE_SQL,
    "op12_filter_audit": filteraudit.ORACLE_SQL,
    "op13_pivot_centroids": centroids.ORACLE_SQL,
}
