"""Nulls, repeats, ties, long and empty texts, clashing columns and colliding words, for every operator, stage and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from gridfuse.llm import bytes_np, importance, language, language_model, packed_ids, packing, quality_rules, stages, suffix, warc, winnowing

WORDS = [f"w{i}" for i in range(300)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key long, first long, stop long, row string, home long, n long"


def thue_morse(n=10):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def odd_rows():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [(i, text(rng.randint(60, 120))) for i in range(12)]
    texts += [(None, text(70)), (None, None), (20, None), (21, ""), (22, " \n\t "), (3, text(80)), (5, texts[5][1]), (5, texts[5][1]), (30, text(20_000)), (31, texts[2][1] + " w1")]
    return [(i, t, "en", "s", len(t or ""), 7, 8, 9, "x", 10, 11) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(20, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(odd_rows()[1][1].split()[10:30])), (2, None)], "item_id long, text string")


def test_colliding_words_are_told_apart(spark):
    """Words that one hash modulo 2**64 cannot tell apart, whatever the values of its bytes."""
    for n in (10, 12):
        a, b = thue_morse(n)
        assert len(set(language_model.Tokens([f"{a} {b}".encode()]).words.tolist())) == 3
        data = np.frombuffer((a + b).encode(), np.uint8)
        at = np.array([0, len(a)])
        assert len(set(bytes_np.Spans(bytes_np.BYTE_VALUE[data]).hash(at, at + len(a)).tolist())) == 2
    a, b = thue_morse()
    docs = spark.createDataFrame([(0, f"{a} x y z p q r s t u"), (1, f"{b} x y z p q r s t u"), (2, a), (3, b)], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{a} x y z p q r s t u")], "item_id long, text string")
    assert {r.doc_id for r in winnowing.contamination(docs, items).filter("n_hit > 0").collect()} == {0}
    assert {bytes(r.kept) for r in suffix.remove_repeats(docs.filter("doc_id > 1"), 1000, 64).collect()} == {a.encode(), b.encode()}


def test_token_ids_of_odd_rows(spark, odd, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    a, b = thue_morse()
    table = odd.select("doc_id", "text").union(spark.createDataFrame([(40, f"{a} {b} {a}")], "doc_id long, text string"))
    found = packed_ids.read_shards(packed_ids.write_shards(table, path, f"file://{tmp_path}/ids", shard_ids=500)).collect()
    library = packed_ids.WordEncoder(path).tokenizer
    expected = [(r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")) for r in table.collect()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in expected)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert packed_ids.read_shards(packed_ids.write_shards(table.limit(0), path, f"file://{tmp_path}/none")).count() == 0


def test_importance_keeps_the_top_keys(odd, labels):
    c = importance.Classifier(odd, labels)
    rows = c.result().collect()
    k = sum(r.log_weight >= 0 for r in rows)
    least = sorted((r.key for r in rows), reverse=True)[k - 1]
    assert len(rows) == 22 and all(r.kept == (r.key >= least) for r in rows)
    target, toxic = importance.labelled(labels)
    raw = importance.count(odd, target, toxic)
    words = [(r.doc_id, (r.text or "").split()) for r in odd.collect()]
    assert raw[0].sum() == sum(2 * len(w) - (len(w) > 0) for _, w in words)
    assert raw[1].sum() == sum(2 * len(w) - (len(w) > 0) for i, w in words if i is not None and i < 12)


def test_language_look_ups_equal_the_convolution_and_held_out_rows_teach_nothing(spark):
    net = language.Network(["a", "b"]).compile()
    x = np.random.default_rng(1).integers(0, 256, (20, language.WINDOW)).astype(np.uint8)
    np.testing.assert_allclose(net.features(x), net.maxima(x)[0], atol=1e-4)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "zz xx" if i in held else "the cat", "hidden" if i in held else "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs).classes == ["en"]


def test_warc_ties_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(4, "u", "same"), (4, "v", "same"), (2, "w", "same"), (None, None, None)], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(warc.resolve_revisits(pages), f"file://{tmp_path}/a")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows) == [(0, "response", None), (2, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert warc.read_archives(warc.write_archives(warc.resolve_revisits(pages.limit(0)), f"file://{tmp_path}/b")).count() == 0


def test_rules_and_packing_of_nothing(odd):
    assert quality_rules.apply_policy(quality_rules.ledger(odd.limit(0))).count() == 0
    assert packing.pack(packing.word_lengths(odd.limit(0))).count() == 0
    packed = packing.pack(packing.word_lengths(odd))
    assert packed.agg({"length": "sum"}).first()[0] == sum(len((r.text or "").split()) for r in odd.collect())


STAGES = [stages.quality, stages.near_duplicates, stages.repeated_passages, stages.decontamination]


@pytest.mark.parametrize("stage", STAGES, ids=[f.__name__ for f in STAGES])
def test_stages_keep_columns_and_take_odd_rows(spark, odd, labels, bench, tmp_path, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = stage(spark, odd, str(tmp_path))
    rows = found.collect()
    assert found.columns == odd.columns and all((r.key, r.first, r.stop, r.row, r.home, r.n) == (7, 8, 9, "x", 10, 11) for r in rows)
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    ids = Counter(r.doc_id for r in rows)
    if stage is stages.near_duplicates:
        # Of each class one row; the texts without a word are one class, the two texts of id 3 are two documents.
        assert ids == Counter({**{i: 1 for i in range(12)}, 3: 2, None: 1, 20: 1, 30: 1})
    if stage is stages.decontamination:
        assert ids == Counter(r[0] for r in odd_rows()) - Counter({1: 1})
    if stage is stages.repeated_passages:
        assert len(rows) == 22 and not any(r.text for r in rows if r.doc_id == 5)


def test_rows_without_or_with_one_id_are_judged_one_by_one(spark, tmp_path):
    """A clean row stays though another row of its id, or of none, holds a benchmark item; that one goes."""
    item = " ".join(WORDS[:20])
    texts = [(1, " ".join(WORDS[40:99])), (1, f"a {item}"), (None, f"b {item}"), (None, " ".join(WORDS[99:160])), (None, " ".join(WORDS[99:160])), (7, " ".join([*WORDS[99:159], "x"])), (None, item), (None, None)]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "hit") for i, t in texts], "doc_id long, text string, hit string")
    found = stages.decontamination(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(t for t in texts if item not in (t[1] or ""))
    found = stages.near_duplicates(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    # Copies without an id yield to those with one.
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(texts[i] for i in (0, 1, 5, 7))


def test_pipeline_from_end_to_end(spark, tmp_path):
    """A copy, a near copy, a benchmark passage and a repeated passage each go as they must; all words that are left are packed."""
    import corpus_pipeline

    rng = random.Random(3)
    text = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    texts = [text(300) for _ in range(30)]
    passage, item = text(60), text(20)
    texts[1] = texts[0]
    texts[3] = " ".join(["new", *texts[2].split()[1:]])
    texts[4], texts[5] = texts[4] + " " + passage, passage + " " + texts[5]
    texts[6] += " " + item
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    expected = {i: 300 for i in range(30) if i not in (1, 3, 6)}
    assert {r[0]: r[1] for r in found} == expected
