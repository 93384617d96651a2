"""Language identification by a linear-chain conditional random field over words.

A word (a letter of any script with the letters and marks behind it) has as features itself (where training knows it), its affixes of up to
four letters, all its letter pairs and triples, and the languages in whose lexicon it stands: those in which at
least two training windows have it, and four fifths of all that have it. Each feature has a weight for each
language, and each pair of languages a learned transition. Forward-backward gives each word's probabilities, so
that passages of a second language are told apart word by word. A text's score for a language is the mean over
its words.

Besides the languages there is the label ``OTHER``, learned from training windows with the letters of their words
shuffled: text in none of the languages, or in no language. It is never a prediction; its part of the words is given.

Training takes at most ``per_language`` labelled rows and ``windows`` windows of each language, those
of least hash, and ``rows`` rows in all, evenly by language (a bounded sample, so the model's size doesn't grow with
the table), and splices some windows of different languages so that switches occur. Scoring takes every word of
every text, in windows of 64 words.

Cases: null texts and texts without a letter (numbers such as one half, emoji and marks alone are none) are ``und`` with score 0, and so is
everything if no row is labelled; the empty text is no label (it names ``OTHER``); repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import random
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # a mark alone (of an emoji, a keycap) is no word
SPAN = 64
#: Label of what is in none of the languages.
OTHER = ""


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    """Feature names of a lower-cased word."""
    n, edged = len(word), f"^{word}$"
    found = ["=" + word]
    found += ["<" + word[:k] for k in range(1, min(4, n) + 1)]
    found += [">" + word[-k:] for k in range(1, min(4, n) + 1)]
    found += [edged[k : k + 2] for k in range(n + 1)]
    found += [edged[k : k + 3] for k in range(n)]
    return found


def forward_backward(emission: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Word probabilities of padded chains (chain, word, language), log partition of each chain and, if asked, summed pair probabilities."""
    n, span, k = emission.shape
    top = emission.max(axis=2, keepdims=True)
    local = np.exp(emission - top)
    inside = np.arange(span)[None, :] < lengths[:, None]
    local[~inside] = 1.0
    a, b0 = np.exp(move), np.exp(begin)
    ahead = np.empty_like(local)
    scale = np.ones((n, span), local.dtype)
    ahead[:, 0] = local[:, 0] * b0
    for t in range(span):
        if t:
            step = (ahead[:, t - 1] @ a) * local[:, t]
            ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
        total = ahead[:, t].sum(axis=1)
        scale[:, t] = np.where(inside[:, t], total, 1.0)
        ahead[:, t] /= scale[:, t, None]
    back = np.ones_like(local)
    for t in range(span - 2, -1, -1):
        step = (back[:, t + 1] * local[:, t + 1]) @ a.T / scale[:, t + 1, None]
        back[:, t] = np.where(inside[:, t + 1, None], step, 1.0)
    posterior = ahead * back
    posterior /= posterior.sum(axis=2, keepdims=True)
    log_z = np.log(scale).sum(axis=1) + np.where(inside, top[:, :, 0], 0).sum(axis=1)
    if not pairs:
        return posterior, log_z, None
    nxt = back[:, 1:] * local[:, 1:] / scale[:, 1:, None] * inside[:, 1:, None]
    return posterior, log_z, a * np.einsum("nti,ntj->ij", ahead[:, :-1], nxt)


@dataclass
class Crf:
    languages: list[str]
    index: dict[str, int]
    lexicon: dict[str, list[str]]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    remembered: int = 250_000
    rows: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Summed feature weights of distinct words."""
        get, flat, ends = self.index.get, [], []
        for w in words:
            flat += [i for i in map(get, features_of(w) + self.lexicon.get(w, [])) if i is not None]
            flat.append(0)  # the bias, so that no word is without features
            ends.append(len(flat))
        starts = np.array([0, *ends[:-1]])
        return np.add.reduceat(self.weights[np.array(flat)], starts, axis=0)

    def numbered(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` for each word; unseen words are added."""
        rows = list(map(self.rows.get, words))
        if None in rows:
            new = list({w for w, r in zip(words, rows, strict=True) if r is None})
            if self.table is None:
                self.table, self.used = np.zeros((1024, len(self.languages)), np.float32), 0
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(new)] = self.emissions(new)
            self.rows.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            rows = list(map(self.rows.get, words))
        return np.array(rows, np.int64)

    def forget(self) -> None:
        if len(self.rows) > self.remembered:
            self.rows, self.table = {}, None

    def label(self, word_lists: list[list[str]]) -> list[np.ndarray]:
        """Each word's language probabilities, for each text."""
        sizes = np.array([len(w) for w in word_lists])
        if not sizes.sum():
            return [np.zeros((0, len(self.languages)), np.float32) for _ in word_lists]
        self.forget()
        rows = self.numbered([w for ws in word_lists for w in ws])
        counts = -(-sizes // SPAN)
        lengths = np.full(counts.sum(), SPAN)
        ends = np.cumsum(counts)
        some = sizes > 0
        lengths[ends[some] - 1] = sizes[some] - (counts[some] - 1) * SPAN
        place = np.arange(SPAN)[None, :] < lengths[:, None]
        out = np.empty((len(rows), len(self.languages)), np.float32)
        at = 0
        for k in range(0, len(lengths), 2048):  # chains at a time
            use, size = place[k : k + 2048], lengths[k : k + 2048]
            padded = np.zeros((*use.shape, len(self.languages)), np.float32)
            padded[use] = self.table[rows[at : at + size.sum()]]
            out[at : at + size.sum()] = forward_backward(padded, size, self.move, self.begin)[0][use]
            at += size.sum()
        return np.split(out, np.cumsum(sizes)[:-1])


def lexicons(samples: list[tuple[list[str], str]]) -> dict[str, list[str]]:
    """Lexicon features of the words of windows: the languages in which two have it, and four fifths of all that have it."""
    held: dict[str, Counter] = {}
    for words, language in samples:
        for w in set(words):
            held.setdefault(w, Counter())[language] += 1
    found = {w: [f"@{s}" for s, n in c.items() if n >= 2 and 5 * n >= 4 * c.total()] for w, c in held.items()}
    return {w: names for w, names in found.items() if names}


def fit(samples: list[tuple[list[str], str]], steps: int = 60, rate: float = 0.25, decay: float = 1e-6, splice: float = 0.3, shuffle: float = 0.25, seed: int = 11) -> Crf | None:
    """A chain fitted to windows of words of one language each, by full-batch Adam on the penalised likelihood."""
    samples = [(w[:SPAN], s) for w, s in samples if w and s != OTHER]
    languages = sorted({s for _, s in samples})
    if not languages:
        return None
    lexicon, mixer = lexicons(samples), random.Random(seed)
    for words, _ in mixer.sample(samples, int(shuffle * len(samples))):
        samples.append((["".join(mixer.sample(w, len(w))) for w in words], OTHER))
    languages.append(OTHER)
    rng, k = np.random.default_rng(seed), len(languages)
    chains, truth = [w for w, _ in samples], [[languages.index(s)] * len(w) for w, s in samples]
    for _ in range(int(splice * len(samples)) if k > 1 else 0):
        i, j = rng.integers(len(samples), size=2)
        p, q = rng.integers(1, SPAN // 2 + 1, size=2)
        chains.append(samples[i][0][:p] + samples[j][0][:q])
        truth.append(truth[i][:p] + truth[j][:q])
    types = sorted({w for c in chains for w in c})

    def named(w: str) -> list[str]:  # made anew each time: all of them at once are large
        return features_of(w) + lexicon.get(w, [])

    seen = Counter(f for w in types for f in set(named(w)))
    index = {f: n for n, f in enumerate(sorted(f for f, c in seen.items() if c > 1 or f[0] == "="), 1)}
    del seen
    number = {w: n for n, w in enumerate(types)}
    numbers, starts = array("i"), array("q")
    for w in types:
        starts.append(len(numbers))
        numbers.extend(index[f] for f in named(w) if f in index)
        numbers.append(0)
    flat, starts = np.frombuffer(numbers, np.int32), np.frombuffer(starts, np.int64)
    owner = np.repeat(np.arange(len(types), dtype=np.int32), np.diff([*starts, len(flat)]))
    lengths = np.array([len(c) for c in chains])
    place = np.arange(SPAN)[None, :] < lengths[:, None]
    ids = np.zeros(place.shape, np.int64)
    ids[place] = [number[w] for c in chains for w in c]
    gold = np.zeros(place.shape, np.int64)
    gold[place] = [y for c in truth for y in c]
    moved = place[:, 1:]
    gold_move = np.bincount((gold[:, :-1] * k + gold[:, 1:])[moved], minlength=k * k).reshape(k, k)
    total = lengths.sum()
    values = [np.zeros((len(index) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        of_type = np.stack([np.add.reduceat(values[0][flat, y], starts) for y in range(k)], axis=1)
        post, _, pairs = forward_backward(of_type[ids], lengths, values[1], values[2], pairs=True)
        diff = post
        np.put_along_axis(diff, gold[:, :, None], np.take_along_axis(diff, gold[:, :, None], 2) - 1, 2)
        of_word = np.stack([np.bincount(ids[place], diff[:, :, y][place], len(types)) for y in range(k)], axis=1)
        of_feature = np.empty_like(values[0])
        for y in range(k):
            of_feature[:, y] = np.bincount(flat, of_word[owner, y], len(index) + 1)
        slopes = [of_feature, pairs - gold_move, diff[:, 0].sum(axis=0)]
        for v, g, m, s in zip(values, slopes, first, second, strict=True):
            g = g / total + decay * v
            m += 0.1 * (g - m)
            g *= g
            s += 0.01 * (g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return Crf(languages, index, lexicon, values[0].astype(np.float32), values[1].astype(np.float32), values[2].astype(np.float32))


def fold(id_col: str) -> Column:
    """CRC-32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, windows: int = 600, rows: int = 20_000, steps: int = 40) -> Crf | None:
    """A model of the rows of folds 0, 1 and 3 with a label; at most ``per_language`` rows and ``windows`` windows a language, and ``rows`` rows in all (so as many languages, the most frequent)."""
    learn = docs.where((fold(id_col) != 2) & F.coalesce(F.col(lang_col) != OTHER, F.lit(False)))
    drawn = learn.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit("langid"), F.col(id_col)).alias("h"))
    # by hash about twice as many rows of a language as are needed, then the least of these
    counts = drawn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows)
    wide = drawn.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(2**40)) < 2.0 * (per_language + 50) / F.col("n") * 2**40)
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(2**40)), "id"))
    taken = wide.withColumn("nth", nth).where(F.col("nth") <= per_language).orderBy("nth", "h", "id", "lang").limit(rows)
    ids = [r.id for r in taken.select("id").collect()]
    chosen = learn.where(F.col(id_col).isin(ids)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, langs = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words = words_of(text)
                found = [" ".join(words[k : k + SPAN]) for k in range(0, len(words), SPAN)]
                out += found
                langs += [lang] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(langs, pa.string())], names=["words", "lang"])

    parts = chosen.mapInArrow(cut, "words string, lang string").distinct()
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("words"), "words"))
    kept = parts.withColumn("n", nth).where(F.col("n") <= windows).collect()
    return fit([(r.words.split(" "), r.lang) for r in sorted(kept, key=lambda r: (r.lang, r.n))], steps)


def identify(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``id_col``, ``keep`` columns, ``lang_pred``, ``score``, ``other`` (part of the words in no language) and ``shares``, each language's part of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    inside = text_col.startswith(f"{id_col}.")  # a field of the id: it is moved to Python once, not twice
    text = [] if inside else [F.col(text_col).alias("_text")]
    plain = docs.select(F.col(id_col).alias("_0"), *text, *[F.col(c).alias(f"_{k}") for k, c in enumerate(keep, 1)])
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                names, scores, others, shares = [], [], [], []
                texts = pc.struct_field(batch.column("_0"), text_col[len(id_col) + 1 :].split(".")) if inside else batch.column("_text")
                lists = [words_of(t) for t in texts.to_pylist()]
                for post in crf.label(lists) if crf else [()] * len(lists):
                    if not len(post):
                        names.append("und")
                        scores.append(0.0)
                        others.append(0.0)
                        shares.append([])
                        continue
                    mean = post.astype(np.float64).mean(axis=0)
                    best = int(mean[:-1].argmax())
                    names.append(crf.languages[best])
                    scores.append(min(1.0, float(mean[best])))
                    others.append(min(1.0, float(mean[-1])))
                    shares.append(list(zip(crf.languages, mean.tolist(), strict=True)))
                columns = [batch.column(f"_{n}") for n in range(len(keep) + 1)]
                columns += [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(others, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *keep, "lang_pred", "score", "other", "shares"])

    shape = ", ".join(f"`{c}` {t}" for c, t in zip((id_col, *keep), kinds, strict=True))
    return plain.mapInArrow(run, f"{shape}, lang_pred string, score double, other double, shares map<string,double>")
