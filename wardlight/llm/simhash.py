"""SimHash fingerprints and near-duplicate groups by pigeonhole blocks.

The 64 bits are split into blocks. Fingerprints that differ in at most ``distance`` bits agree in
at least ``blocks - distance`` blocks, so each fingerprint is posted once for every choice of so
many blocks, and a pair meets on the first choice in which it agrees; its distance is then
verified exactly. Equal fingerprints are one node from the start, with the smallest id among them,
so a third of all rows with one text costs one posting.

A posting bucket with more than ``crowd`` fingerprints isn't paired whole. Its members are posted
again under more and smaller blocks (with the same guarantee, so no link is lost), each level leaving
fewer free bits, until the last, whose buckets are bounded by the number of free patterns.

Cases: texts of one or two words hash as one shingle; a text without words (null and empty too) has
fingerprint zero and links like any other; repeated rows each get a row; rows with a null id are
grouped, but never name a group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardlight.llm.components import components
from wardlight.sources.tables import written

SEED = 42
#: Blocks of each level of postings; the first handles nearly all buckets.
LEVELS = (6, 10, 16)
#: Buckets beyond this size go to the next level instead of being paired.
CROWD = 512


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``words``-word shingles of a text, repeats included."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxh64_intdigest(b" ".join(tokens), SEED)  # the majority of one hash is that hash
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False))
    n = len(tokens) - words + 1
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 16384):
        part = hashes[k : k + 16384].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's bits as a long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str | None, int] = {}
            found = np.empty(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column("text").to_pylist()):
                if text not in known:
                    known[text] = fingerprint(text, words)
                found[k] = known[text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def block_masks(blocks: int) -> list[int]:
    """Masks that split 64 bits into ``blocks`` runs of nearly equal length."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """``fp`` under each choice of ``blocks - distance`` blocks: ``choice`` and ``bits`` (those blocks' bits)."""
    masks = [reduce(int.__or__, c) for c in combinations(block_masks(blocks), blocks - distance)]
    bits = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    return nodes.select("fp", F.posexplode(bits).alias("choice", "bits"))


def first_choice(differ: Column, choice: Column, blocks: int, distance: int) -> Column:
    """Whether ``choice`` is the first choice of blocks in which two fingerprints with differing bits ``differ`` agree.

    That holds if they differ in each block that the choice leaves out before its last one.
    """
    masks, skipped = block_masks(blocks), []
    for chosen in combinations(range(blocks), blocks - distance):
        out = [masks[k] for k in range(chosen[-1]) if k not in chosen]
        skipped.append([_signed(m) for m in out] + [0] * (distance - len(out)))
    holds = F.lit(True)
    for column in zip(*skipped, strict=True):
        mask = F.lit(list(column))[choice]
        holds = holds & ((mask == 0) | (differ.bitwiseAND(mask) != 0))
    return holds


def links(nodes: DataFrame, distance: int = 3, levels: tuple[int, ...] = LEVELS, crowd: int = CROWD) -> DataFrame:
    """All pairs ``a`` < ``b`` of the distinct fingerprints ``fp`` at ``distance`` differing bits or fewer."""
    found = []
    for blocks in levels:
        posts = postings(nodes, blocks, distance)
        sizes = posts.groupBy("choice", "bits").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        sizes = written(sizes.where("n > 1"), f"simhash-{blocks}")
        final = blocks == levels[-1]
        many = posts.join(sizes.where(F.col("n").between(3, 2**62 if final else crowd)).select("choice", "bits"), ["choice", "bits"])
        pairs = many.withColumnRenamed("fp", "a").join(many.withColumnRenamed("fp", "b"), ["choice", "bits"]).where("a < b")
        pairs = sizes.where("n = 2").select("choice", "a", "b").unionByName(pairs.select("choice", "a", "b"))
        differ = F.col("a").bitwiseXOR(F.col("b"))
        agree = (F.bit_count(differ) <= distance) & first_choice(differ, F.col("choice"), blocks, distance)
        found.append(pairs.where(agree).select("a", "b"))
        crowded = sizes.where(F.col("n") > crowd).select("choice", "bits")
        if final or crowded.isEmpty():
            break
        nodes = written(posts.join(crowded, ["choice", "bits"]).select("fp").distinct(), "simhash-crowded")
    return found[0] if len(found) == 1 else reduce(DataFrame.union, found).distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, levels: tuple[int, ...] = LEVELS, crowd: int = CROWD) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``, the smallest id that links reach, for every row."""
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes")
    tied = components(links(nodes, distance, levels, crowd))
    members = tied.union(tied.select("root", "root").distinct())
    named = members.join(nodes, members.node == nodes.fp).select("node", "root", "least")
    groups = named.join(named.groupBy("root").agg(F.min("least").alias("group_least")), "root").select(F.col("node").alias("fp"), "group_least")
    # written, so that both sides of the last join are plain exchanges, which adaptive execution splits for hot texts
    of_node = written(nodes.join(groups, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id")), "simhash-groups")
    return rows.join(of_node, "fp").select(id_col, "fp", "component_id")
