"""The lexicon's automaton, merges, ids and texts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from gridfuse.llm import bpe_lexicon
from pyspark.sql import functions as F

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "'", "''", "'S", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "᠎", "​", " ", "　", "\x1c", "\x1f", "a", "É", "ß", "ll", "re", "1", "٣", "²", "ⅷ", "!", "?-", "<|endoftext|>", "<|endof", "😀", "é", "中文", "\U000e0041", "\U0010ffff", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def written(tmp_path, words):
    vocabulary = bpe_lexicon.vocabulary(PATH)
    file = tmp_path / "lexicon.bin"
    file.write_bytes(bpe_lexicon.compiled(words, [vocabulary.merged(w) for w in words], bpe_lexicon.character_classes(PATH)))
    return bpe_lexicon.Lexicon(str(file))


def test_automaton_is_minimal_and_exact(tmp_path):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(900)})
    arcs, final = bpe_lexicon.automaton(words)
    used, stack = {0}, [0]
    while stack:
        for t in arcs[stack.pop()].values():
            if t not in used:
                used.add(t)
                stack.append(t)
    # States of the minimal automaton are the distinct sets of endings.
    endings = {frozenset(w[i:] for w in words if w[:i] == p) for w in words for i in range(len(w) + 1) for p in [w[:i]]}
    assert len(used) == len(endings)
    lexicon = written(tmp_path, words)
    other = [b"abcabcabc", b"d", b"a" * 40, *(bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 8))) for _ in range(500))]
    asked = words + other
    text = np.frombuffer(b"".join(asked), np.uint8)
    end = np.cumsum([len(w) for w in asked])
    place = lexicon.places(text, end - [len(w) for w in asked], end)
    known = {w: i for i, w in enumerate(words)}
    assert place.tolist() == [known.get(w, -1) for w in asked]


@pytest.mark.parametrize("lexicon_words", [0, 50, 5000])
def test_ids_and_texts_equal_library(tmp_path, library, lexicon_words):
    rng = random.Random(9)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 15))) for _ in range(3000)] + ["x" * 3000, " " * 500, "the cat's hat; they'll've\n\n  go " * 40]
    values = [t.encode() for t in texts]
    counted = bpe_lexicon.Words(values, bpe_lexicon.character_classes(PATH), bpe_lexicon.vocabulary(PATH).special).counts()
    lexicon = written(tmp_path, sorted(counted, key=lambda w: (-counted[w], w))[:lexicon_words])
    ids = bpe_lexicon.Encoder(PATH, lexicon).many(values)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in ids] == want
    decoded = [t.decode("utf-8", "replace") for t in bpe_lexicon.Decoder(PATH).many(ids)]
    assert decoded == library.decode_batch(want, skip_special_tokens=False) == texts


def test_long_words_and_broken_bytes(library):
    rng, vocabulary = random.Random(5), bpe_lexicon.vocabulary(PATH)
    for n in (bpe_lexicon.LONG, bpe_lexicon.LONG + 1, 4000):
        word = "".join(rng.choice("abcdehinorstu") for _ in range(n))
        assert vocabulary.merged(word.encode()) == library.encode(word, add_special_tokens=False).ids
    ids = [rng.randrange(50257) for _ in range(300)]
    assert bpe_lexicon.Decoder(PATH).many([np.array(ids, np.uint32)])[0].decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_query(spark, library, tmp_path):
    texts = [None, "", " ", "a cat's <|endoftext|> mat", "a cat's <|endoftext|> mat", "naïve 12 3½ 日本語", "word " * 20_000]
    rows = [(i if i != 3 else None, t, "h", 1) for i, t in enumerate(texts)] + [(2, "again", "h", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, bpe_lexicon.op11_bpe(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe_lexicon.encode(docs, PATH, bpe_lexicon.compile_lexicon(docs, PATH, size=3))  # most words are merged
    again = bpe_lexicon.decode(encoded, PATH).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256))
    assert sorted(map(tuple, again.collect()), key=str) == got


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    encoded = bpe_lexicon.encode(docs, PATH, bpe_lexicon.compile_lexicon(docs, PATH))
    assert bpe_lexicon.decode(encoded, PATH).count() == 0
