"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over a text's words and word beginnings (present or not) learns the labels. For each
identity term in a labelled text, copies are made in which that term alone is swapped for each of its
alternatives; besides the likelihood and a ridge, the loss has ``parity`` times the mean squared difference
between the scores (as logits) of a text and its copies. Weight on the mention itself is thereby driven out,
and neutral mentions aren't scored up.

Identity terms are the seeds (``GROUPS``: a line's words stand for each other) and terms learned from the labelled
texts: words that toxic texts and others both have (less than ``mild`` of them toxic) and whose features the model
would nevertheless use. A learned term's alternatives are the ``near`` terms that stand in the most similar contexts (left
and right neighbours among the ``frequent`` most common words), which keeps them within a language; seeds that occur
get such alternatives too. Words that mostly toxic texts have are evidence and are never swapped.

Features are all with a z-score of their log odds of ``z`` or more over the sample. Training takes at most ``rows``
labelled ids, those of least hash, of these the texts that fit into ``characters``, and of an id that repeats the text of least hash, so neither the model nor what
the driver holds grows with the table; every word of every text is scored.

Cases: null and empty texts get the score of no features; rows of a table without labels, or with one
label only, get that share (0 without any); a row with several labels counts once by its largest; repeated
rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.langid import WORD, fold
from wardlight.sources.tables import written

# Seeds, terms that name groups of people; within a line they may stand for each other.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "american", "european", "mexican", "chinese", "indian"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("blind", "deaf", "disabled", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "türken", "deutsche"),
    ("schwule", "lesben", "bisexuelle"),
    ("flüchtlinge", "einwanderer", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "français", "africains"),
    ("gays", "lesbiennes", "bisexuels"),
    ("réfugiés", "immigrés", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "españoles", "africanos"),
    ("homosexuales", "lesbianas", "bisexuales"),
    ("refugiados", "inmigrantes", "extranjeros"),
)


def tokens_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def words_of(text: str | None) -> set[str]:
    return set(tokens_of(text))


def features_of(word: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters."""
    return ["=" + word, *["<" + word[:k] for k in range(4, min(8, len(word)) + 1)]]


def seeds(groups: tuple[tuple[str, ...], ...] = GROUPS) -> dict[str, set[str]]:
    """Alternatives of each seed term."""
    found: dict[str, set[str]] = {}
    for g in groups:
        for w in g:
            found.setdefault(w, set()).update(x for x in g if x != w)
    return found


@dataclass
class Classifier:
    index: dict[str, int]
    weights: np.ndarray
    bias: float
    mentions: int = 0  # training rows with copies
    swaps: int = 0  # their copies
    terms: tuple[str, ...] = ()  # identity terms in them
    remembered: int = 200_000
    known: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def of_word(self, word: str) -> tuple[int, ...]:
        """Feature numbers of a word."""
        ids = self.known.get(word)
        if ids is None:
            ids = tuple(i for i in map(self.index.get, features_of(word)) if i is not None)
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[word] = ids
        return ids

    def ids(self, words: set[str]) -> set[int]:
        """Feature numbers of a text's words."""
        return set().union(*map(self.of_word, words)) if words else set()

    def swapped(self, words: set[str], alternatives: dict[str, set[str]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """What each copy of a text, with one term swapped for one alternative, loses and gains."""
        terms = [w for w in words if w in alternatives]
        if not terms:
            return []
        counts = Counter(i for w in words for i in self.of_word(w))
        found = []
        for w in terms:
            own = self.of_word(w)
            for other in alternatives[w]:
                theirs = self.of_word(other)
                found.append((tuple(sorted(i for i in own if counts[i] == 1 and i not in theirs)), tuple(sorted(i for i in theirs if not counts[i]))))
        return found

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:
            return 0.0
        ids = self.ids(words_of(text))
        logit = self.bias + (float(self.weights[sorted(ids)].sum()) if ids else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))))


def fit(rows: list[tuple[list[int], int]], swaps: list[tuple[tuple[int, ...], tuple[int, ...], int]], features: int, parity: float = 5.0, ridge: float = 1e-3, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias from (feature numbers, label) and from swaps (numbers lost, numbers gained, how often) by full-batch Adam."""
    if not rows:
        return np.zeros(features), -np.inf
    y = np.array([r[1] for r in rows], np.float64)
    flat = np.array([i for r in rows for i in r[0]], np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    pair_flat = np.array([i for p, q, _ in swaps for i in (*p, *q)], np.int64)
    pair_sign = np.array([s for p, q, _ in swaps for s in (*[1.0] * len(p), *[-1.0] * len(q))])
    pair_of = np.repeat(np.arange(len(swaps)), [len(p) + len(q) for p, q, _ in swaps]).astype(np.int64)
    often = np.array([n for *_, n in swaps], np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    value = np.append(np.zeros(features), np.log(share / (1 - share)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        logit = value[-1] + np.bincount(of, value[flat], len(rows))
        error = (1 / (1 + np.exp(-logit)) - y) / len(y)
        slope = np.append(np.bincount(flat, error[of], features), error.sum())
        if len(swaps):
            gap = np.bincount(pair_of, pair_sign * value[pair_flat], len(swaps)) * often
            slope[:-1] += 2 * parity / often.sum() * np.bincount(pair_flat, pair_sign * gap[pair_of], features)
        slope[:-1] += ridge / 10 * value[:-1]
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return value[:-1], float(value[-1])


def alike(profiles: dict[str, dict[str, int]], near: int, least: float = 0.2) -> dict[str, set[str]]:
    """For each term the ``near`` others of most similar contexts, by the cosine of the roots of their counts, ``least`` at least."""
    terms = sorted(t for t, p in profiles.items() if p)
    if len(terms) < 2:
        return {}
    number = {n: k for k, n in enumerate(sorted({n for p in profiles.values() for n in p}))}
    x = np.zeros((len(terms), len(number)), np.float32)
    for k, t in enumerate(terms):
        for n, c in profiles[t].items():
            x[k, number[n]] = c**0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for k in range(0, len(terms), 512):
        close = x[k : k + 512] @ x.T
        close[np.arange(len(close)), np.arange(k, k + len(close))] = -1
        for j, row in enumerate(close):
            best = np.argsort(-row, kind="stable")[:near]
            found[terms[k + j]] = {terms[b] for b in best if row[b] >= least}
    return {t: others for t, others in found.items() if others}


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = 12_000,
    characters: int = 64 << 20,
    least: int = 4,
    z: float = 2.5,
    parity: float = 5.0,
    mild: float = 0.5,
    near: int = 3,
    frequent: int = 300,
    groups: tuple[tuple[str, ...], ...] = GROUPS,
) -> Classifier:
    """A classifier of labelled rows of folds 0, 1 and 3."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 2))
    marks = marks.groupBy(id_col).agg(F.max(label_col).alias("y"))
    sample = {r[0]: int(r[1] > 0) for r in marks.orderBy(F.xxhash64(F.lit("toxicity"), F.col(id_col)), id_col).limit(rows).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(sample)  # at most ``rows`` entries
    picked = docs.where(F.col(id_col).isin(list(sample))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = written(picked.groupBy("id").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text")), "toxicity-sample")
    sizes = {r.id: r.n for r in picked.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect()}  # at most ``rows``
    left, dropped = characters, []
    for key in sample:
        if sizes.get(key, 0) <= left:
            left -= sizes.get(key, 0)
        else:
            dropped.append(key)
    if dropped:
        sample = {k: y for k, y in sample.items() if k not in set(dropped)}
        shared = docs.sparkSession.sparkContext.broadcast(sample)
        picked = picked.where(~F.col("id").isin(dropped))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found[shared.value[key]].update({f for w in words_of(text) for f in features_of(w)})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "n0": pa.array([found[0][f] for f in names], pa.int64()), "n1": pa.array([found[1][f] for f in names], pa.int64())})

    ones = sum(sample.values())
    sums = picked.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = written(sums.where(F.col("n0") + F.col("n1") >= least), "toxicity-counts")
    inside, outside = F.col("n1") + 0.5, F.col("n0") + 0.5
    rest_in, rest_out = F.greatest(F.lit(ones + 1.0) - inside, F.lit(0.5)), F.greatest(F.lit(len(sample) - ones + 1.0) - outside, F.lit(0.5))
    odds = F.log(inside / rest_in) - F.log(outside / rest_out)
    weight = F.abs(odds) / F.sqrt(1 / inside + 1 / outside)
    good = sums.where(weight >= z).select("feature", "n0", "n1").collect()
    index = {r.feature: k for k, r in enumerate(sorted(good, key=lambda r: r.feature))}
    blank = Classifier(index, np.zeros(len(index)), 0.0)

    whole = sums.where(F.col("feature").startswith("=")).withColumn("word", F.substring("feature", 2, 2**30))
    common = {r.word for r in whole.orderBy(F.desc(F.col("n0") + F.col("n1")), "word").limit(frequent).collect()}
    learned = {r.feature[1:] for r in good if r.feature[0] == "=" and r.n0 and r.n1 and r.n1 < mild * (r.n0 + r.n1)} - common
    lines = seeds(groups)
    terms = learned | set(lines)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = ["", *tokens_of(text), ""]
                for left, w, right in zip(tokens, tokens[1:], tokens[2:], strict=False):
                    if w in terms:
                        found.update((w, side) for side in ([f"{left} "] if left in common else []) + ([f" {right}"] if right in common else []))
        yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in found], pa.string()), "context": pa.array([c for _, c in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    profiles: dict[str, dict[str, int]] = {}
    for r in picked.mapInArrow(contexts, "term string, context string, n long").groupBy("term", "context").agg(F.sum("n").alias("n")).collect():
        profiles.setdefault(r.term, {})[r.context] = r.n
    alternatives = {w: set(a) for w, a in lines.items()}
    for w, a in alike(profiles, near).items():
        alternatives.setdefault(w, set()).update(a)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sorted(blank.ids(words_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([shared.value[k] for k in batch.column("id").to_pylist()], pa.int32())], names=["ids", "y"])

    def swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, mentions = Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                copies = blank.swapped(words_of(text), alternatives)
                found.update(copies)
                mentions += bool(copies)
        lost, gained, n = [list(p) for p, _ in found], [list(q) for _, q in found], list(found.values())
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([*lost, []], kind), pa.array([*gained, []], kind), pa.array([*n, 0], pa.int64()), pa.array([*[0] * len(n), mentions], pa.int64())], names=["lost", "gained", "n", "mentions"])

    copies = picked.mapInArrow(swaps, "lost array<int>, gained array<int>, n long, mentions long").groupBy("lost", "gained").agg(F.sum("n").alias("n"), F.sum("mentions").alias("mentions")).collect()
    pairs = sorted((tuple(r.lost), tuple(r.gained), r.n) for r in copies if r.lost or r.gained)
    seen = sorted((r.ids, r.y) for r in picked.mapInArrow(numbered, "ids array<int>, y int").collect())
    weights, bias = fit(seen, pairs if parity else [], len(index), parity)
    return Classifier(index, weights, bias, sum(r.mentions for r in copies), sum(r.n for r in copies), tuple(sorted(set(profiles) & set(alternatives))))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
