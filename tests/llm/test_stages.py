"""Stages of the pipeline against brute force."""

import random

import numpy as np
from gridfuse.llm import importance, simhash, stages, suffix
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)


def test_near_duplicates(spark):
    """Pairs of texts with similarities from 0.6 to 0.95: those of 0.8 and over link, no others."""
    rng = random.Random(9)
    texts = []
    for _ in range(250):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([9, 60, 200, 300]))]
        copy = list(words)
        for _ in range(max(1, int(len(words) * rng.uniform(0.005, 0.05)))):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            copy = words[: int(len(words) * rng.uniform(0.7, 0.95))]
        texts += [" ".join(words), " ".join(copy)]
    texts += [None, "", texts[0]]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    label = np.arange(len(texts))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    simhash.unite(label, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    expected = {i for i in range(len(texts)) if label[i] == i}
    kept = {r.doc_id for r in stages.near_duplicates(spark, frame(spark, texts), "").collect()}
    assert not expected - kept, "a text without a copy went"
    assert len(kept - expected) <= 1, "copies stayed"
    assert 60 < len(expected) - 250 < 240


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """Where a bucket's sets exceed a unit, its pairs meet block by block, and the classes stay the same."""
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(300)] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(300)) for _ in range(5)]
    whole = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts), 5, 4, 76, 24, 6).collect()}
    monkeypatch.setattr(simhash, "UNIT", 1200)
    cut = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts), 5, 4, 76, 24, 6).collect()}
    assert cut == whole and len(set(whole.values())) == 6


def test_repeated_passages(spark):
    """Runs of over 50 equal words go however short they are in bytes, runs of 50 words stay."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    short, fifty = [word(2) for _ in range(51)], [word(9) for _ in range(50)]
    lines = [[word(6) for _ in range(40)] + passage + [word(6) for _ in range(i)] for i, passage in enumerate([short, short, fifty, fifty, [], short[:30], short[20:]])]
    lines += [lines[0][5:91], [word(1) for _ in range(3)] * 40, []]
    texts = [" ".join(w) for w in lines]
    texts[1] = texts[1].replace(" ", " \n")
    seen = {}
    for i, w in enumerate(lines):
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), []).append((i, k))
    gone = {(i, k + j) for places in seen.values() if len(places) > 1 for i, k in places for j in range(51)}
    rows = {r.doc_id: r for r in stages.repeated_passages(spark, frame(spark, texts), "").collect()}
    assert len(rows) == len(texts) and any(i == 0 for i, _ in gone)
    for i, w in enumerate(lines):
        assert rows[i].text.split() == [x for k, x in enumerate(w) if (i, k) not in gone]
        assert rows[i].n_chars == len(rows[i].text)
    assert rows[2].text == texts[2]


def test_rare_toxic_words_are_evidence(spark):
    """A word of 30 labelled toxic texts counts in a small table."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(1000)]) for _ in range(100)) + " vile" * (i < 30) for i in range(330)]
    labels = spark.createDataFrame([(i, int(i >= 30), int(i < 30)) for i in range(330)], "doc_id long, quality int, toxic int")
    c = importance.Classifier(frame(spark, texts), labels)
    assert c.scored.filter("doc_id < 30 AND sum_toxic < 0").count() >= 25
    kept = {r.doc_id for r in c.result().filter("kept").collect()}
    assert len([i for i in kept if i < 30]) <= 5 and len([i for i in kept if i >= 30]) >= 285


def test_suffix_order_decides_repeats(spark, monkeypatch):
    """Phrases that stand once take part in the suffix sort, and are told from repeats by it."""
    rng = random.Random(6)
    words = [f"v{rng.randrange(10**5)}" for _ in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join(words[:40] + ["x"] + words[40:])]
    held = {}

    def ranks(strings, depth=None):
        held["names"] = [r.x for r in strings.collect()]
        return whole(strings, depth)

    whole = suffix.suffix_ranks
    monkeypatch.setattr(suffix, "suffix_ranks", ranks)
    suffix.repeated_windows(suffix.keyed(frame(spark, texts)), 60, 40)
    assert min(held["names"].count(x) for x in held["names"]) == 1 < max(held["names"].count(x) for x in held["names"])


def test_suffix_order_is_needed(spark, monkeypatch):
    """Texts that go on in different ways after the same words, each twice: in the order of first names alone their copies are not beside each other."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(10**5)}"
    head = [word() for _ in range(60)]
    texts = [" ".join(head + [word() for _ in range(40)]) for _ in range(12)] * 2
    docs = suffix.keyed(frame(spark, texts))
    runs = lambda: sorted(tuple(r) for r in suffix.repeated_windows(docs, 60, 40).collect())

    def windows(rows):
        return {(key, i) for key, first, stop in rows for i in range(first, stop)}

    real = runs()
    assert len(windows(real)) == sum(len(t.encode()) - 59 for t in texts)
    whole = suffix.suffix_ranks
    monkeypatch.setattr(suffix, "suffix_ranks", lambda strings, depth=None: whole(strings, depth).withColumn("rank", F.col("x0")))
    assert runs() != real and windows(runs()) == windows(real)


def test_suffix_order_is_needed_for_passages(spark, monkeypatch):
    """As above, by words, as the pipeline's stage asks."""
    rng = random.Random(10)
    word = lambda: f"v{rng.randrange(10**5)}"
    head = [word() for _ in range(90)]
    docs = suffix.keyed(frame(spark, [" ".join(head + [word() for _ in range(90)]) for _ in range(12)] * 2))
    runs = lambda: sorted(tuple(r) for r in suffix.repeated_windows(docs, stages.PASSAGE, stages.PASSAGE_GRAM, words=True).collect())
    real, whole = runs(), suffix.suffix_ranks
    monkeypatch.setattr(suffix, "suffix_ranks", lambda strings, depth=None: whole(strings, depth).withColumn("rank", F.col("x0")))
    assert runs() != real
