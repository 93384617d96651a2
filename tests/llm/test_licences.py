import random
import re
import time

from wardlight.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return w, sorted(places)


TEXTS = [
    None,
    "",
    " ... ",
    "CC-BY cc by cc BY by",
    "cc by cc by cc by",
    "Général General Public\nLicense; all rights (reserved) all rights reserved É",
    "`General_Public License` 4.0 ÀB",
    "Text. Licensed under the Apache License, Version 2.0. More.",
    "Licensed under the Apache Lizenz, Version 1.1.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "Released under the MIT License.",
    "the mit and the license under that version",
    "x " * 100_000 + "all rights reserved",
]


def test_rows(spark):
    rng = random.Random(2)
    bits = ["cc", "by", "nc", "4", "0", "general", "public", "license", "all", "rights", "reserved", "é", "x", "mit", "released"]
    texts = TEXTS + [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "cc by", "x"), (3, TEXTS[3], "x")], "doc_id long, text string, places string").repartition(3)
    rows = licences.summary(licences.scan(docs)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2
    for i, t in enumerate(texts):
        w, places = brute(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None)), t
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    labels = [got[i].labels for i in range(len(TEXTS))]
    assert labels[7:12] == ["apache-2.0", "", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0", "mit"] and labels[12] == ""
    assert got[7].score > 0.99 and got[0].score == 0
    assert licences.scan(docs.limit(0)).count() == 0


def test_every_template_is_found_in_place_and_with_words_changed():
    rng = random.Random(4)
    index = licences.RareIndex(1000, dict.fromkeys([b"the", b"of", b"to", b"a", b"and", b"or", b"in", b"this"], 900))
    for t in index.templates:
        words = [b"start", b"here", *t.words, b"end"]
        assert index.found(words)[t.label] > 0.99
        if len(t.words) > 12:
            keyed = {w for key in t.keys for w in key}
            free = [k for k, w in enumerate(t.words) if w not in keyed]
            words[2 + free[0]] = b"other"
            assert 0.5 < index.found(words)[t.label] < 1
            inserted = list(t.words)
            inserted.insert(free[len(free) // 2], b"inserted")
            assert index.found(inserted)[t.label] > 0.99
            lost = [w for k, w in enumerate(t.words) if k != free[-1]]
            assert 0.5 < index.found(lost)[t.label] < 1 + 1e-9  # sums of floats; scan cuts at 1
        shuffled = list(t.words)
        rng.shuffle(shuffled)
        assert len(t.words) < 12 or t.label not in index.found(shuffled)


def plain_found(index, words):
    """By the definition: every pair of votes as bounds, keys and the heaviest common subsequence by a full table."""
    best = {}
    for k, t in enumerate(index.templates):
        posted = sorted(set(t.words), key=index.rank)[: 2 * index.rare]
        voters = [w for w in posted if w in words][: index.rare]
        votes = [(at - place, w) for w in voters for at, x in enumerate(words) if x == w for place, y in enumerate(t.words) if y == w]
        starts = sorted({s for s, _ in votes})
        for low in starts:
            for high in (h for h in starts if low <= h <= low + index.slack[k]):
                if len({w for s, w in votes if low <= s <= high}) < index.needed[k]:
                    continue
                area = words[max(0, low - index.slack[k]) : high + len(t.words) + index.slack[k]]
                if all(any(tuple(area[j : j + len(key)]) == key for j in range(len(area))) for key in t.keys):
                    table = [[0.0] * (len(area) + 1) for _ in range(len(t.words) + 1)]
                    for i, w in enumerate(t.words):
                        for j, x in enumerate(area):
                            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + index.idf[w] if w == x else 0.0)
                    best[t.label] = max(best.get(t.label, 0.0), table[-1][-1] / index.weight[k])
    return best


def test_labels_and_scores_equal_a_plain_version():
    rng, index = random.Random(5), licences.RareIndex(500, dict.fromkeys([b"the", b"of", b"under", b"license"], 300))
    short = [t for t in index.templates if len(t.words) < 30]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            t = list(rng.choice(short).words)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = [rng.choice([b"x", b"the", b"license", b"4", b"under"])][: rng.randint(0, 1)]
                t = t or [b"x"]
            words += t + [b"y"] * rng.randint(0, 3)
        got, want = index.found(words), plain_found(index, words)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want), words


def test_many_licence_words_in_a_long_text_end_soon():
    index = licences.RareIndex(10, {})
    words = [w for t in index.templates for w in t.words] * 200
    began = time.time()
    assert set(index.found(words)) >= {"mit", "isc", "zlib", "bsd-3-clause", "apache-2.0", "cc0-1.0"}
    assert time.time() - began < 60


def test_frequencies_count_every_row(spark):
    docs = spark.createDataFrame([(i, "the mit the") for i in range(30)] + [(99, None)], "doc_id long, text string").repartition(7)
    rows, seen = licences.word_frequencies(docs)
    assert rows == 31 and seen[b"mit"] == seen[b"the"] == 30 and seen[b"apache"] == 0
