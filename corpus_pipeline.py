"""A training corpus in five stages, each over all that its predecessor kept.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of documents. ``run`` applies them to the table,
each written to the shared folder and read again.

The rows can't be given in SQL: the first stage trains a model. Tests compare the stages with
plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import langid, mixing, nearcopies, pieces, secrets
from wardlight.sources.tables import table, written

ORACLE_SQL = None
#: A document with this part of its words or more in none of the languages is rejected.
MOST_OTHER = 0.9


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, so that no further column of theirs clashes with one of a stage."""
    return docs.select(F.struct("*").alias("_row"))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or with ``MOST_OTHER`` of their words in no learned language, go.

    ``lang`` becomes the predicted one where it is null. Null and empty texts go; repeated rows stay as they are;
    without any labelled row all texts are without language and go; an empty table gives no rows.
    """
    found = langid.identify(_packed(docs), langid.train(docs), "_row", "_row.text")
    kept = found.where((F.col("lang_pred") != "und") & (F.col("other") < MOST_OTHER))
    return kept.select(*[F.coalesce("_row.lang", "lang_pred").alias(c) if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row of the smallest id (null ids last), then of the smallest text hash.

    Found by SimHash (960 bits over five-word shingles, matched by blocks), each pair then checked; pairs that the blocks
    miss are found by the shingles that they must share. Near copies have a five-word similarity of 0.8 or more; chains of them are one group. Texts without words (null and
    empty too) are one group; of rows with one id and one text one stays; an empty table gives no rows.
    """
    number, text = F.col("_row.doc_id"), F.col("_row.text")
    parts = {"_lost": number.isNull(), "_id": F.coalesce(number, F.lit(-1)), "_key": F.xxhash64(F.coalesce(text, F.lit("")))}
    rows = _packed(docs).withColumns(parts)
    groups = nearcopies.near_copy_groups(rows.select(F.struct(*parts).alias("row"), text.alias("text")), "row")
    first = groups.where("row = component_id").select("row.*").distinct()
    return rows.join(first, list(parts), "left_semi").dropDuplicates(list(parts)).select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials that look live masked; ``n_chars`` follows.

    Null and empty texts stay; repeated rows each stay and count as one repository; an empty table gives no rows.
    """
    masked = secrets.mask_live(docs)
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.withColumn("n_chars", changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are never taken; each of repeated rows is taken or not for itself; an empty
    table gives no rows.
    """
    taken = mixing.mix(_packed(docs), "_row.doc_id", "_row.text", "_row.source").where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    """``doc_id`` and the ``ids`` of every document's whole text, with ``n_tokens``.

    Null and empty texts have the end id alone; repeated rows each get a row; an empty table gives no rows.
    """
    return pieces.encode_documents(docs, model_path).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
