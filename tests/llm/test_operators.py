"""Corpus operators against brute force, on nulls, empty and repeated rows, ties, odd texts and empty tables."""

import io
import random
import re
from collections import Counter

import numpy as np
import pytest
from gridfuse.llm import importance, language, language_model, packed_ids, packing, quality_rules, simhash, suffix, warc, winnowing

WORDS = [f"w{i}" for i in range(200)] + ["the", "of", "Été", "naïve"]


def some_texts(n=60, seed=3):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(WORDS) for _ in range(150))
    out[3] = out[4] = out[5]
    out[6], out[7] = out[6] + " " + passage, passage + " " + out[7]
    out[8] = "ab c\n" * 300
    out[9], out[10] = None, ""
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "x") for i, t in enumerate(some_texts())] + [(None, "no id at all", None, "s", 0, "x"), (20, "again", "en", "s", 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype(np.uint32)
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits, 1001) == ids).all()


def test_shard_random_access():
    class Kept(io.BytesIO):
        def close(self):
            pass

    rng, out = np.random.default_rng(1), Kept()
    docs = [rng.integers(0, 1000, n).astype(np.uint32) for n in (0, 5, 300, 1, 77)]
    writer = packed_ids.ShardWriter(out, 10, block_ids=64)
    for i, d in enumerate(docs):
        writer.add(None if i == 0 else i, d)
    writer.close()
    reader = packed_ids.ShardReader(out, len(out.getvalue()))
    assert all((reader.document(i) == d).all() for i, d in enumerate(docs))
    assert (reader.ids(3, 200) == np.concatenate(docs)[3:200]).all()


def test_word_encoder_equals_library():
    import public_tokenizers

    e = packed_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), cache_words=50)
    values = ["", "Hello, World!!", "a<|endoftext|>b  x\x1cy z", "ÉTÉ naïve's don't 12.5", "İ ſ ǅ ́a"] + [t for t in some_texts() if t]
    for text, ids in zip(values, e.many([v.encode() for v in values]), strict=True):
        assert e.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_simhash_components(spark, docs, empty):
    found = simhash.classes(simhash.fingerprints(docs), 3, shard_nodes=5).toPandas()
    prints = found.f0.to_numpy().view(np.uint64)
    label = np.arange(len(prints))
    for i in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)
        simhash.unite(label, np.full(len(near), i), near)
    for k in np.unique(label):
        assert set(found.component_id[label == k]) == {found.doc_id[label == k].min()} or found.doc_id[label == k].isna().all()
    assert simhash.classes(simhash.fingerprints(empty), 3).count() == 0


def test_simhash_null_ids_link_and_repeated_ids_tie_nothing(spark):
    """Fingerprints 0, 7 and 63: the middle one, under a null id, links the others; the id 4 has two far ones."""
    rows = [(5, 0), (None, 7), (9, 63), (4, 255 << 40), (4, -1), (3, (255 << 40) + 1), (20, -4), (None, 0x5555)]
    found = simhash.classes(spark.createDataFrame(rows, "doc_id long, f0 long"), 3).collect()
    assert {(r.doc_id, r.f0): r.component_id for r in found} == {(5, 0): 5, (None, 7): 5, (9, 63): 5, (4, 255 << 40): 3, (4, -1): 4, (3, (255 << 40) + 1): 3, (20, -4): 4, (None, 0x5555): None}


def test_simhash_tables_keep_every_link():
    rng = np.random.default_rng(4)
    for n, count, width in ((1000, 4, 16), (1 << 30, 10, 24), (1 << 40, 20, 30), (1 << 60, 35, 36)):
        bands = simhash.tables(1, 3, n)
        assert len(bands) == count and all(len(b) >= width for b in bands)
        for _ in range(200):
            flipped = rng.choice(64, 3, replace=False)
            assert any(not np.isin(flipped, b).any() for b in bands)


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    f = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(k)) for k in range(8)]))[:, None]
    found = {(int(a), int(b)) for q, t in simhash.Forest(f, np.zeros(len(f), np.int64), np.ones(len(f), bool)).search(np.arange(len(f)), np.zeros(len(f), np.int64), 3) for a, b in zip(q, t)}
    assert found == {(i, j) for i in range(len(f)) for j in range(len(f)) if i != j and simhash.distance(f[[i]], f[[j]])[0] <= 3}


def test_suffix_ranks(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", k, rng.choice([4, 7])) for i in range(6) for k in range(rng.randint(1, 8)) if rng.random() < 0.9]
    names = {(a, b): c for a, b, c in rows}

    def tail(a, b):
        out = []
        while (a, b) in names:
            out.append(names[a, b])
            b += 1
        return out

    all_tails = [tail(*p) for p in names]
    for r in suffix.suffix_ranks(spark.createDataFrame(rows, "s string, k long, x long")).collect():
        assert r["rank"] == sum(t < tail(r.s, r.k) for t in all_tails)


def test_suffix_dedup(docs, empty):
    length = 60
    rows = suffix.remove_repeats(docs, length, 40).collect()
    texts = [(r.text or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        assert bytes(r.kept) == np.frombuffer(t, np.uint8)[~gone].tobytes()
    assert suffix.remove_repeats(empty).count() == 0
    assert suffix.cut_from(docs, length, 40).columns == docs.columns


def test_winnowing(spark, docs, empty):
    texts = [t for t in some_texts() if t]
    items = [(1, " ".join(texts[12].split()[5:30])), (2, "w1 w2"), (3, None), (4, ""), (None, " ".join(texts[13].split()[:12])), (5, " ".join(texts[12].split()[5:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(i)
    expected = Counter()
    for r in docs.collect():
        w, hit, ids = word.findall(low(r.text)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        expected[r.doc_id, len(w), len(hit), tuple(sorted(str(i) for i in ids if i is not None))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in winnowing.contamination(docs, bench).collect()) == expected
    assert winnowing.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert winnowing.contamination(empty, bench).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "v\n", None), (4, "w", ""), (5, "x", "é" * 50), (None, "y", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = {r.page_id: r for r in warc.read_archives(warc.write_archives(warc.resolve_revisits(pages), f"file://{tmp_path}")).collect()}
    assert (back[1].record_type, back[1].refers_to, back[2].record_type, back[None].refers_to, back[3].refers_to) == ("revisit", 2, "response", 2, 4)
    assert back[5].payload == "é" * 50 and back[5].payload_bytes == 100 and back[1].payload_bytes == 4
    assert back[2].payload_digest == warc.base32_sha1(b"same") == back[1].payload_digest
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(warc.gzip_member(b"x" * 99)[:-9])))


def test_quality_rules(docs):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    texts = some_texts()
    assert rows[9, 0].base_failed and not rows[9, 0].kept
    assert rows[8, 600].n_repeat_words == 600 and rows[8, 600].n_dup_lines == 299
    assert rows[11, len(texts[11].split())].word_chars == sum(map(len, texts[11].split()))
    table = {r["rule"]: r for r in quality_rules.ablations(quality_rules.ledger(docs)).collect()}
    assert table["few_words"].n_failed == sum(r.n_words < 50 for r in rows.values())


def test_best_boundaries_and_batches(spark):
    from itertools import combinations

    lengths, counts = np.array([1, 3, 4, 9, 10]), np.array([5, 1, 7, 2, 2])
    cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts))
    for k in (1, 2, 3, 5, 9):
        best = min(cost((*c, 10)) for m in range(min(k, 5)) for c in combinations([1, 3, 4, 9], m))
        assert cost(packing.best_boundaries(lengths, counts, k)) == best
    rows = packing.pack(spark.createDataFrame([(i, i % 70) for i in range(500)] + [(None, None)], "doc_id long, n long"), max_len=32, buckets=4, budget=128, group_rows=40).toPandas()
    assert rows.length.sum() == sum(i % 70 for i in range(500)) and (rows.length <= rows.bound).all()
    assert not rows.duplicated(["bucket", "batch", "slot"]).any()
    assert (rows.groupby(["bucket", "batch"]).bound.sum() <= 128).all()


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 18])
def test_language_model_counts(docs, empty, max_bits):
    """Every contract column against exact counts; the score does not depend on how much of the filter is broadcast."""
    import zlib

    rows = language_model.score(docs, heavy=20, max_bits=max_bits, entry_bits=2000, shard_pairs=500).collect()
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    tokens = [word.findall((r.text or "").encode().lower()) + [b"\0"] for r in docs.collect()]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs.collect()]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    counts, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:]))
    total, kinds = sum(counts.values()), len(counts)
    q = lambda c: 0 if c == 0 else 1 if c == 1 else 1.5 * 2 ** (c.bit_length() - 1)

    def score(t):
        p = [0.7 * (q(counts[w]) + 1) / (total + kinds + 1) + (0.3 * min(1, q(pairs[v, w]) / max(1, q(counts[v]))) if v else 0.3 * (q(counts[w]) + 1) / (total + kinds + 1)) for v, w in zip([None, *t], t)]
        return float(np.log10(p).sum())

    base = lambda t: float(sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in t))
    expected = sorted((h, len(t), sum(counts[w] > 0 for w in t), round(base(t), 6), score(t)) for t, h in zip(tokens, held, strict=True))
    found = sorted((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in rows)
    assert [r[:4] for r in found] == [r[:4] for r in expected] and all(r.train_tokens == total for r in rows)
    assert np.allclose([r[4] for r in found], [r[4] for r in expected], rtol=1e-9)
    assert language_model.score(empty).count() == 0


def test_language_and_importance(spark, docs, empty):
    net = language.fit(docs)
    rows = {r.doc_id: r for r in language.predict(docs, net).collect()}
    assert rows[9].lang_pred == "und" and rows[9].score == 0 and rows[11].lang_pred == "en" and 0 <= rows[11].score <= 1
    assert language.predict(empty, language.fit(empty)).count() == 0
    labels = spark.createDataFrame([(i, 1, 0) for i in range(11, 40)] + [(8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    c = importance.Classifier(docs, labels)
    assert c.result().count() == docs.count() and c.keep(docs).columns == docs.columns
    assert c.keep(docs).count() == c.result().filter("kept").count()
    values = [float(x) for x in np.random.default_rng(2).normal(size=300)] + [0.5] * 20
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 100, 319):
        assert importance.kth_largest(frame, "v", k, bins=4, few=10) == sorted(values, reverse=True)[k - 1]
