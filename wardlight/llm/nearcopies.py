"""Near copies by five-word similarity: SimHash with more bits and blocks than op3's, each pair that meets then checked exactly.

The fingerprint of a text is a SimHash of 960 bits: a bit is 1 if it is set in over half the hashes of the text's distinct ``words``-word
shingles. Two texts with Jaccard similarity J differ in a part of at most acos(2J / (1 + J)) / pi of the bits, 15 % at 0.8: 10 bits of
64, so fingerprints of 64 bits and 3 differing ones can't find them. The bits are cut into ``BLOCKS`` blocks, of which the first
``width`` bits are used (by the number of rows, as a block must tell chance meetings apart). The bits that differ are mostly those whose
vote was close, so a text is posted in each block under all values of its ``WEAK`` closest votes: two texts meet if they agree in the
bits that are close in neither. At 0.8 they do so in a block of 20 bits with chance 0.38, of 24 bits with 0.24, of 30 bits with 0.11 (simulated
with normal votes); a pair at 0.8 is thus lost once in 88,000, once in 750 and once in 18 (tables of 16 thousand, 200 thousand, 14 million
rows), with 30 bits one at 0.85 once in 250 and one at 0.9 once in 46,000. Texts of less than some ten shingles have many tied votes and lose more (not measured).

Of the pairs that meet, those whose shingle counts differ too much, or whose fingerprints differ in more bits than a pair at ``least``
does, are dropped inside the JVM (one word of the fingerprint first, then all of it); only the rest move texts, and are compared once by
their whole shingle sets (as 64-bit hashes). Texts of equal words are one node from the start.

A bucket with more than ``crowd`` nodes isn't paired, as a crowd of near copies would cost all its pairs. Each of its members
is compared with a hub. Most members of a crowd are told before anything is posted under 192 keys: nodes that share a block's own
bits (24 keys a node) with at least ``crowd`` / 2 others take the hub of these, of all of them the one in most such buckets, hence close to the
middle of its crowd. A bucket whose members all have one hub needs no more, whatever its size; of another crowded bucket only the members that lack its
largest hub are looked up, and become members of that hub too. So any two nodes of a crowded bucket have a hub in common.

Of a member its *delta* is kept: the shingles that only one of it and its hub has. Members similar to their hub are linked to it; pairs
that these links join already are dropped before any text moves. The others are searched for in the deltas: as
|A ^ B| = |delta A ^ delta B|, a member that isn't similar to its hub shares a part of its delta with every text that it is similar
to, so an index over the deltas of the hub's members finds them all, and overlaps of deltas give exact similarities without
texts. A delta of d shingles, of which a similar text must share d - t, is looked up by its t + 1 rarest. Deltas of a hub are dealt in parts of about
``budget`` shingles, every part of the far members meets every part of all members, and a meeting gives a link for each two
groups that it joins, not for each pair. So a crowd loses no link between texts that meet in a block.

What SimHash loses is found afterwards (``lost_links``), so the groups are those of comparing all texts. With the shingles of every text
in one order, a text of n shingles and one similar to it have one of the n - ceil(``least`` n) + 1 first of each in common (its
*lead*). Leads are posted, and buckets in which all nodes are in one group already are left out; in the rest, pairs whose leads have too
few in common for the bound are dropped, the others compared. A bucket of many nodes is a crowd, taken by deltas from a hub as above.
The order puts shingles last that many texts have; these are counted in a part of the texts, which bears on the work and not on what is found.

Cases: texts of fewer words than a shingle are one shingle; texts without words (null and empty too) are one
node; rows with a null id are told by the caller's key; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh64_intdigest

from wardlight.llm.components import components
from wardlight.sources.tables import discard, mark, written

SEED = 42
#: Words of a fingerprint, blocks that it is cut into and bits of each, close votes of a block that are posted either way.
LONGS, BLOCKS, SPAN, WEAK = 15, 24, 40, 3
#: Most nodes of a bucket whose pairs are compared one by one, and shingles of deltas in a part of a crowd.
CROWD, BUDGET = 8, 1 << 18
#: Shingles are counted in one of so many texts; cells of the table of common ones, and most of these.
PART, CELLS, COMMON = 16, 1 << 22, 1 << 19
#: A hash of a shingle times each of these, stirred, gives its 960 bits.
TIMES = np.random.default_rng(5).integers(0, 2**63, size=LONGS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STIR = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a text."""
    tokens = tokens_of(text)
    if not tokens:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, max(1, len(tokens) - words + 1)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two results of ``shingles``; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def block_width(rows: int) -> int:
    """Bits of a block for a table of ``rows`` texts: a posting meets another by chance once in 8 to 16 times."""
    return min(SPAN, max(20, (max(rows, 1) - 1).bit_length() + 6))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, how many of the ``hashes`` set it more than don't."""
    total = np.zeros(64 * LONGS, np.int64)
    for k in range(0, len(hashes), 255):  # a byte holds the count of 255
        x = hashes[k : k + 255, None] * TIMES
        x ^= x >> np.uint64(32)
        x *= STIR
        x ^= x >> np.uint64(29)
        total += np.add.reduce(np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * total - len(hashes)


def fingerprint(text: str | None, words: int = 5, width: int = 20) -> tuple[int, list[int], list[int]]:
    """Shingle count, SimHash (in signed 64-bit words) and for each block its first ``width`` bits and, six bits each from bit 40 on, the places of its closest votes."""
    return fingerprint_of(shingles(text, words), width)


def fingerprint_of(hashes: np.ndarray, width: int) -> tuple[int, list[int], list[int]]:
    """``fingerprint`` of a text with the shingles ``hashes``."""
    lead = votes(hashes)
    bits = lead > 0
    sketch = np.packbits(bits, bitorder="little").view("<i8")
    close = np.argpartition(np.abs(lead).reshape(BLOCKS, SPAN)[:, :width], WEAK, axis=1)[:, :WEAK]
    blocks = bits.reshape(BLOCKS, SPAN)[:, :width] @ (1 << np.arange(width)) + (close << (SPAN + 6 * np.arange(WEAK))).sum(axis=1)
    return len(hashes), sketch.tolist(), blocks.tolist()


def common_shingles(docs: DataFrame, text_col: str = "text", words: int = 5) -> np.ndarray:
    """For each of ``CELLS`` values of a shingle's last bits a level that rises with the number of texts, 0 for rare ones; counted in one of ``PART`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            found = [shingles(text, words) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).distinct()
    often = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    cells = often.select(F.col("shingle").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("cell"), F.floor(F.log2("n")).cast("int").alias("level"))
    cells = written(cells.groupBy("cell").agg(F.max("level").alias("level")), "near-common")
    total, lowest = 0, 99
    for level, n in sorted(cells.groupBy("level").count().collect(), reverse=True):
        if (total := total + n) > COMMON:
            break
        lowest = level
    kept = cells.where(F.col("level") >= lowest).toArrow()
    levels = np.zeros(CELLS, np.uint8)
    levels[kept.column("cell").to_numpy()] = kept.column("level").to_numpy()
    return levels


def most_apart(size: int, least: float) -> int:
    """How many of its ``size`` shingles a text may lack in one that is similar to it."""
    return size - math.ceil(least * size - 1e-9)


def lead_of(hashes: np.ndarray, least: float, levels: np.ndarray) -> np.ndarray:
    """The first of the sorted ``hashes`` in the order of level and value, one more than ``most_apart``."""
    count, level = most_apart(len(hashes), least) + 1, levels[hashes & np.uint64(CELLS - 1)]
    return hashes[np.argsort(level, kind="stable")[:count]]


def fingerprints(docs: DataFrame, id_col: str, text_col: str = "text", words: int = 5, width: int = 20, least: float = 0.8) -> DataFrame:
    """``id_col``, ``key`` (hash of the text), ``node`` (hash of its words), ``size``, ``sketch``, ``blocks`` and ``lead`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    levels = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            known: dict[int, tuple] = {}
            nodes, found = np.empty(batch.num_rows, np.uint64), []
            for k, text in enumerate(batch.column("text").to_pylist()):
                nodes[k] = node = xxh64_intdigest(b" ".join(tokens_of(text)), SEED + 1)
                if node not in known:
                    hashes = shingles(text, words)
                    known[node] = *fingerprint_of(hashes, width), lead_of(hashes, least, levels.value).view(np.int64)
                found.append(known[node])
            sizes, sketches, blocks, leads = zip(*found, strict=True) if found else ((), (), (), ())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sketches, blocks, leads)]
            columns = [batch.column("id"), batch.column("key"), pa.array(nodes.view(np.int64)), pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "key", "node", "size", "sketch", "blocks", "lead"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, key long, node long, size long, sketch array<long>, blocks array<long>, lead array<long>")


def own_bits(nodes: DataFrame) -> DataFrame:
    """``node`` under each ``key``: a block's number and its bits as they are, one of its ``postings``."""
    return nodes.select("node", F.posexplode("blocks").alias("block", "v")).select("node", F.expr(f"v & {(1 << SPAN) - 1}L | shiftleft(cast(block AS bigint), {SPAN})").alias("key"))


def postings(nodes: DataFrame, *more: str) -> DataFrame:
    """``node`` (and the columns ``more``) under each ``key``: a block's number and its bits, with all values of its closest votes."""
    near = [f"shiftleft(1L, cast(shiftright(v, {SPAN + 6 * k}) & 63 AS int))" for k in range(WEAK)]
    flips = [" | ".join(["0L", *(near[k] for k in range(WEAK) if pattern >> k & 1)]) for pattern in range(1 << WEAK)]
    base = f"(v & {(1 << SPAN) - 1}L & ~({' | '.join(near)}) | shiftleft(cast(block AS bigint), {SPAN}))"
    valued = nodes.select("node", *more, F.posexplode("blocks").alias("block", "v"))
    return valued.select("node", *more, F.explode(F.array(*[F.expr(f"{base} | {x}") for x in flips])).alias("key"))


def differing(a: Column, b: Column, unit: int = 8) -> Column:
    """Number of units of ``unit`` bits (bytes, or 1: bits) in which two sketches differ."""
    shifts = [unit >> k for k in range(1, unit.bit_length())]
    last = int.from_bytes(bytes([sum(1 << k for k in range(0, 8, unit))] * 8))
    total = F.lit(0)
    for k in range(LONGS):
        bits = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in shifts:  # the last bit of each unit gathers the whole unit; the mask keeps bytes apart
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(int.from_bytes(bytes([0xFF >> shift] * 8)))))
        total = total + F.bit_count(bits if unit == 1 else bits.bitwiseAND(F.lit(last)))
    return total


def most_differing(bits: int, least: float, deviations: float) -> float:
    """Of ``bits`` of a fingerprint, as many as two texts with similarity ``least`` differ in, and so many standard deviations more."""
    part = math.acos(2 * least / (1 + least)) / math.pi
    return bits * part + deviations * (bits * part * (1 - part)) ** 0.5


def plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose shingle counts and fingerprints allow a similarity of ``least``."""
    last = F.get("sketch", F.lit(LONGS - 1))
    x, y = (nodes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), last.alias(f"{s}_word")) for s in "ab")
    close = F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size")
    alike = F.bit_count(F.col("a_word").bitwiseXOR(F.col("b_word"))) <= most_differing(64, least, 5)
    some = pairs.join(x, "a").join(y, "b").where(close & alike).select("a", "b")
    x, y = (nodes.select(F.col("node").alias(s), F.col("sketch").alias(f"{s}_sketch")) for s in "ab")
    # few hashes give more differing bits than many (18 % of 4 and 5), hence the wide margin; texts without anything common differ in half the bits
    return some.join(x, "a").join(y, "b").where(differing(F.col("a_sketch"), F.col("b_sketch"), 1) <= most_differing(64 * LONGS, least, 8)).select("a", "b")


def checked(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts are similar by ``least`` or more; ``texts`` has ``node`` and ``text``."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # the last few texts, as a crowd's hub comes often

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) >= 16:
                    del known[next(iter(known))]
                known[node] = shingles(text.as_py(), words)
            return known[node]

        for batch in batches:
            a, b, x, y = (batch.column(c) for c in "abxy")
            near = [similarity(of(p, x[k]), of(q, y[k])) >= least for k, (p, q) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return sides.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def deltas(members: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """``hub``, ``node``, ``size``, ``near`` (whether they are similar) and ``delta`` of ``members`` (``node``, ``hub``): shingles that only the node has, and, inverted, those that only the hub has."""
    sides = members.join(texts.select("node", "text"), "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("middle")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            sizes, near, found = [], [], []
            for hub, text, middle in zip(batch.column("hub").to_pylist(), batch.column("text").to_pylist(), batch.column("middle"), strict=True):
                if hub not in known:
                    if len(known) >= 8:
                        del known[next(iter(known))]
                    known[hub] = shingles(middle.as_py(), words)
                own, of_hub = shingles(text, words), known[hub]
                sizes.append(len(own))
                near.append(similarity(own, of_hub) >= least)
                found.append(np.concatenate([np.setdiff1d(own, of_hub, True), ~np.setdiff1d(of_hub, own, True)]))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))
            columns = [batch.column("hub"), batch.column("node"), pa.array(sizes, pa.int64()), pa.array(near, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["hub", "node", "size", "near", "delta"])

    return sides.select("hub", "node", "text", "middle").mapInArrow(run, "hub long, node long, size long, near boolean, delta array<long>")


def joined(table: pa.Table, least: float) -> list[tuple[int, int]]:
    """Links between far members (``far``) and members of other labels that are similar by ``least`` or more, as many as join their groups."""
    far, size, node, label = (table.column(c).to_numpy(zero_copy_only=False) for c in ("far", "size", "node", "label"))
    lists = table.column("delta").combine_chunks()
    edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    every, looked = np.flatnonzero(~far), np.flatnonzero(far)
    d = np.diff(edges)
    owner = np.repeat(np.arange(len(d)), d)
    indexed = ~far[owner] if len(owner) else np.empty(0, bool)
    order = np.argsort(flat[edges[0] : edges[-1]][indexed], kind="stable")
    terms, holders = flat[edges[0] : edges[-1]][indexed][order], owner[indexed][order]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    found = []
    slack = (1 - least) / (1 + least)
    for r in looked:
        mine = flat[edges[r] : edges[r + 1]]
        low, high = np.searchsorted(terms, mine, "left"), np.searchsorted(terms, mine, "right")
        counts = high - low
        most = slack * (size[r] + size[r] / least) + 1e-6  # differing shingles of a similar pair, at most
        rare = np.argsort(counts, kind="stable")[: int(most) + 1]
        rare = rare[counts[rare] > 0]
        if not len(rare):
            continue
        met = np.unique(np.concatenate([holders[low[k] : high[k]] for k in rare]))
        met = met[(np.abs(d[met] - len(mine)) <= slack * (size[r] + size[met]) + 1e-6)]
        root = find(int(label[r]))
        met = met[[find(int(x)) != root for x in label[met]]]
        if not len(met):
            continue
        if counts.sum() <= 64 * len(met):
            some = [holders[a:b] for a, b in zip(low, high, strict=True) if b > a]
            both = np.bincount(np.concatenate(some), minlength=len(d))[met]
        else:
            both = np.array([len(np.intersect1d(mine, flat[edges[m] : edges[m + 1]], assume_unique=True)) for m in met])
        common = (size[r] + size[met] - (len(mine) + d[met] - 2 * both)) // 2
        for m in met[common / (size[r] + size[met] - common) >= least]:
            a, b = find(int(label[r])), find(int(label[m]))
            if a != b:
                top[a] = b
                found.append((int(node[r]), int(node[m])))
    return found


def across(known: DataFrame, least: float, budget: int) -> DataFrame:
    """Links of members that aren't similar to their hub with all other members of it; ``known`` holds ``deltas`` and each node's ``label``."""
    weight = F.size("delta") + 8
    sums = known.groupBy("hub").agg(F.sum(weight).alias("all"), F.sum(F.when(~F.col("near"), weight).otherwise(0)).alias("some")).where(F.col("some") > 0)
    parts = sums.select("hub", F.ceil(F.col("all") / budget).cast("int").alias("p"), F.ceil(F.col("some") / budget).cast("int").alias("q"))
    rows = known.join(parts, "hub")

    def dealt(rows: DataFrame, far: bool) -> DataFrame:
        mine, others = ("q", "p") if far else ("p", "q")
        own = F.pmod(F.xxhash64("node", F.lit(far)), F.col(mine)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        sides = {"x": met, "y": own} if far else {"x": own, "y": met}
        return rows.select("hub", *[v.alias(k) for k, v in sides.items()], F.lit(far).alias("far"), "node", "size", "label", "delta")

    both = dealt(rows, False).union(dealt(rows.where(~F.col("near")), True))

    def run(table: pa.Table) -> pa.Table:
        found = joined(table, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    # dealt by meeting: rows dealt by hub before would do for the grouping, and a crowd's meetings would all be in one task
    return both.repartition("hub", "x", "y").groupBy("hub", "x", "y").applyInArrow(run, "a long, b long")


def gathered(met: DataFrame, steps: int = 2) -> DataFrame:
    """``node`` and ``hub`` of ``met`` (``hub`` a struct that ends in a ``node``), each hub replaced ``steps`` times by the largest that it has met itself.

    Nodes that had one hub have one afterwards, so none of their links is lost; a node that met many hubs of one crowd keeps few.
    """
    largest = met.groupBy("node").agg(F.max("hub").alias("top"))
    tops = met.select("hub", F.col("hub").alias("top")).distinct()
    for _ in range(steps):
        tops = tops.join(largest.select(F.col("node").alias("of"), F.col("top").alias("next")), F.col("top.node") == F.col("of")).select("hub", F.col("next").alias("top"))
    # a hub has no more rows in tops than one
    return met.join(tops, "hub").select("node", F.col("top.node").alias("hub")).distinct()


def hubs_of(nodes: DataFrame, crowd: int) -> DataFrame:
    """``node``, ``hub`` and ``code`` of the nodes that share their own bits of a block with at least half of ``crowd`` others; codes rise with the buckets of a hub and tell hubs apart."""
    own = own_bits(nodes)
    full = own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd // 2).select("key")
    met = written(own.join(full, "key"), "near-own")
    middle = met.groupBy("node").agg(F.count("*").alias("m"))
    hubs = met.join(middle, "node").groupBy("key").agg(F.max(F.struct("m", F.xxhash64("node").alias("h"), "node")).alias("hub"))
    largest = written(met.join(hubs, "key").groupBy("node").agg(F.max("hub").alias("hub")), "near-largest")
    code = F.shiftleft("m", 58).bitwiseOR(F.shiftrightunsigned("hub", 6))  # m is 24 at most
    coded = gathered(largest).join(middle.withColumnRenamed("node", "hub"), "hub").select("node", "hub", code.alias("code"))
    one = coded.groupBy("code").agg(F.min("hub").alias("hub"))  # so a code means one hub, should two have it
    return coded.drop("hub").join(one, "code").select("node", "hub", "code")


def links(nodes: DataFrame, texts_of, least: float = 0.8, words: int = 5, crowd: int = CROWD, budget: int = BUDGET) -> DataFrame:
    """Pairs ``a``, ``b`` of ``nodes`` (``node``, ``size``, ``sketch``, ``blocks``) that are similar by ``least`` or more, as many as join them.

    ``texts_of`` gives ``node`` and ``text`` of a table of nodes.
    """
    known_hubs = written(hubs_of(nodes, crowd), "near-hubs")
    posts = postings(nodes.join(known_hubs.select("node", "code"), "node", "left"), "code")
    # dealt before it is counted, as nearly all keys are rare; two or three nodes of a bucket are told from its least, its largest and all of them xored
    counts = [F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor("node").alias("c")]
    sizes = posts.repartition("key").groupBy("key").agg(*counts, F.count("code").alias("known"), F.min("code").alias("low"), F.max("code").alias("top"))
    sizes = sizes.where("n > 1 AND NOT (known = n AND low = top)").drop("known", "low")  # nodes of one hub meet there
    sizes = written(sizes.withColumn("c", F.when(F.col("n") == 3, F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("c")))), "near-sizes")
    more = sizes.where("n > 3").select("key", "n", "top", F.col("b").alias("any"))
    met = written(posts.join(more, "key").where((F.col("n") <= crowd) | F.col("code").isNull() | (F.col("code") != F.col("top"))), "near-met")
    few = met.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list(F.struct("node", "code")).alias("all"))  # no more than a crowd
    couples = "flatten(transform(all, x -> transform(filter(all, y -> x.node < y.node AND NOT coalesce(x.code = y.code, false)), y -> struct(x.node AS a, y.node AS b))))"
    paired = few.select(F.explode(F.expr(couples)).alias("p")).select("p.a", "p.b")
    three = sizes.where("n = 3")
    for side in (sizes.where("n < 4").select("a", "b"), three.select("a", F.col("c").alias("b")), three.select(F.col("c").alias("a"), "b")):
        paired = paired.union(side)
    pairs = paired.distinct()

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = written(plausible(pairs, nodes, least), "near-pairs")
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return written(checked(pairs, written(texts_of(needed), "near-texts"), least, words), "near-links")

    named = known_hubs.select(F.col("code").alias("top"), "hub").distinct()
    others = met.where(F.col("n") > crowd).select("node", "top", "any").distinct().join(named, "top", "left")
    found = known_hubs.select("node", "code", "hub").union(others.select("node", F.coalesce("top", F.lit(-1)), F.coalesce("hub", "any")))
    found = found.select("node", F.struct("code", F.col("hub").alias("node")).alias("hub"))
    met_hubs = written(found.union(found.select("hub.node", "hub")).distinct(), "near-met-hubs")
    if met_hubs.isEmpty():
        return tested(pairs)
    members = written(gathered(met_hubs), "near-members")
    known = written(deltas(members, written(texts_of(members.select("node").distinct()), "near-crowd-texts"), least, words), "near-deltas")
    close = known.where("near AND node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    tied = written(components(close), "near-tied")
    label = lambda side: tied.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    labelled = known.join(tied, "node", "left").withColumn("label", F.coalesce("root", "node"))
    return close.union(tested(apart)).union(across(labelled, least, budget))


def lost_links(leads: DataFrame, sizes: DataFrame, tied: DataFrame, texts_of, least: float, words: int, crowd: int, budget: int) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes that are similar by ``least`` or more and not in one group of ``tied`` (``node``, ``root``), as many as join them.

    ``leads`` holds ``node`` and ``lead`` (repeats too), ``sizes`` a row a node with its ``size``.
    """
    posts = leads.select("node", F.explode("lead").alias("shingle")).repartition("shingle").distinct()
    bucket = W.partitionBy("shingle")
    ends = posts.withColumns({"low": F.min("node").over(bucket), "top": F.max("node").over(bucket)})
    shared = written(ends.where("low < top").select("shingle", "node"), "near-shared")
    known = sizes.join(tied, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"))
    named = shared.join(known, "node").withColumn("n", F.count("*").over(bucket)).withColumn("like", F.count("*").over(W.partitionBy("shingle", "root")))
    mixed = written(named.withColumn("like", F.sum("like").over(bucket)).where("like < n * n"), "near-mixed")
    # of a bucket's pairs only those of two groups count, so one large group and few others are no crowd
    paired = (F.col("n") <= crowd) | (F.col("n") <= 8 * crowd) & (F.col("n") * F.col("n") - F.col("like") <= crowd * F.col("n"))
    few = mixed.where(paired).groupBy("shingle").agg(F.collect_list(F.struct("node", "size", "root")).alias("all"))  # 8 crowds at most
    couples = "flatten(transform(all, x -> transform(filter(all, y -> x.node < y.node AND x.root <> y.root), y -> struct(x.node AS a, y.node AS b, x.size AS x, y.size AS y))))"
    both = few.select(F.explode(F.expr(couples)).alias("p")).select("p.*").where(F.least("x", "y") >= least * F.greatest("x", "y") - 1e-6)
    both = both.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    full = mixed.where(~paired)
    more = written(full.groupBy("node").agg(F.count("*").alias("m")), "near-crowded")  # a pair may have these in common too
    for side in "ab":
        both = both.join(more.select(F.col("node").alias(side), F.col("m").alias(f"{side}_m")), side, "left")
    # beyond the lead that ends first, no more than the rest of that text can be in common
    needed = F.ceil(least / (1 + least) * (F.col("x") + F.col("y")) - 1e-6) - F.ceil(least * F.greatest("x", "y") - 1e-6) + 1
    pairs = written(both.where(F.col("n") + F.least(F.coalesce("a_m", F.lit(0)), F.coalesce("b_m", F.lit(0))) >= needed).select("a", "b"), "near-left")
    ends = written(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "near-left-texts")
    found = checked(pairs, ends, least, words)
    if more.isEmpty():
        return found
    hubs = full.groupBy("shingle").agg(F.max(F.struct(F.xxhash64("node").alias("h"), "node")).alias("hub"))
    members = written(gathered(written(full.select("shingle", "node").join(hubs, "shingle").select("node", "hub").distinct(), "near-left-hubs")), "near-left-members")
    apart = written(deltas(members, written(texts_of(members.select("node").distinct()), "near-left-crowds"), least, words), "near-left-deltas")
    close = apart.where("near AND node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    labelled = apart.join(known.select("node", F.col("root").alias("label")), "node")
    return found.union(close).union(across(labelled, least, budget))


def near_copy_groups(docs: DataFrame, id_col: str, text_col: str = "text", words: int = 5, least: float = 0.8, crowd: int = CROWD, budget: int = BUDGET) -> DataFrame:
    """``id_col`` and ``component_id``, the smallest id that links reach, for every row."""
    rows = written(fingerprints(docs, id_col, text_col, words, block_width(docs.count()), least), "near-rows")
    one = rows.groupBy("node").agg(F.min(F.struct(F.col(id_col).alias("first"), "key", "size", "sketch", "blocks")).alias("m"))
    nodes = written(one.select("node", "m.*"), "near-nodes")
    plain = docs.select(F.col(id_col).alias("first"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))

    def texts_of(needed: DataFrame) -> DataFrame:
        return plain.join(nodes.join(needed, "node", "left_semi").select("node", "first", "key"), ["first", "key"]).select("node", "text").dropDuplicates(["node"])

    spark, since = docs.sparkSession, mark(docs.sparkSession)
    tied = components(links(nodes.drop("first", "key"), texts_of, least, words, crowd, budget))
    discard(spark, since, ("edges", "near-own", "near-met", "near-members", "near-tied"))  # texts and deltas go
    lost = written(lost_links(rows.select("node", "lead"), nodes.select("node", "size"), tied, texts_of, least, words, 16 * crowd, budget), "near-lost")
    if not lost.isEmpty():
        tied = components(tied.select(F.col("node").alias("a"), F.col("root").alias("b")).union(lost))
    members = tied.union(tied.select("root", "root").distinct())
    named = members.join(nodes.select("node", "first"), "node")
    groups = named.join(named.groupBy("root").agg(F.min("first").alias("group_first")), "root").select("node", "group_first")
    of_node = written(nodes.join(groups, "node", "left").select("node", F.coalesce("group_first", "first").alias("component_id")), "near-groups")
    return rows.join(of_node, "node").select(id_col, "component_id")
