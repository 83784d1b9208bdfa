"""Operator 11: byte-level BPE through a minimal acyclic transducer of frequent words.

Spark counts the words of all texts (pieces of the vocabulary's pre-tokenizer) and the most frequent ones, with their ids, are
compiled into a minimal acyclic automaton: equal suffixes share states, and each arc carries a number so that the sum along a word is its
place in the list of id outputs. The file is sent to every executor once and mapped into memory there, so the workers of one machine share its pages.
A task cuts whole texts into words with numpy, walks all words of a chunk through the automaton together, a byte at a time,
and merges the words that the automaton lacks by the vocabulary's ranks, exactly. The size of the lexicon decides how fast this is, never an id.

Defined results: null text counts as empty; an empty text has no ids; rows with a null or repeated doc_id stay rows of their own; strings of the
vocabulary's special tokens become their ids, as the library does by default; ids that are no whole UTF-8 decode with U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm import bytes_np, common

#: Words of the lexicon, and bytes of its longest word; other words are merged.
LEXICON_WORDS, WORD_BYTES = 200_000, 32
#: Distinct words that a task holds before it hands its counts on, and merged words that a worker keeps.
HELD_WORDS, CACHE_WORDS = 100_000, 50_000
#: Bytes of text that a task works on at a time.
AT_ONCE = 1_000_000
#: Words of more bytes are merged with a heap.
LONG = 200
MAGIC = b"GFLEX001"

#: Classes of characters for the pre-tokenizer.
OTHER, LETTER, NUMBER, SPACE = range(4)
APOSTROPHE = ord("'")
#: Planes without letters, numbers and white space: unassigned or private.
BARE = range(0x40000, 0x110000)
#: Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


_classes: dict[str, np.ndarray] = {}


def character_classes(path: str) -> np.ndarray:
    """The class of each code point, asked of the vocabulary's own pre-tokenizer.

    It cuts the sequence of all code points into runs of one class; whether it joins the first of a run to a letter, a number or a mark tells which.
    """
    from tokenizers import Tokenizer

    if path not in _classes:
        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        out = np.full(0x110000, OTHER, np.uint8)
        points = [c for c in range(BARE.start) if not 0xD800 <= c < 0xE000]
        for _, (s, e) in split("".join(map(chr, points))):
            kind = SPACE
            for before, of in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                if len(split(before + chr(points[e - 1]))) == 1:
                    kind = of
            out[points[s:e]] = kind
        out[32] = SPACE  # a blank joins the mark after it
        _classes[path] = out
    return _classes[path]


class Vocabulary:
    """Bytes of each id, ranks of merges, and special strings, from a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        model, letters = read["model"], byte_letters()
        if read.get("normalizer") or (read["pre_tokenizer"] or {}).get("type") != "ByteLevel" or read["pre_tokenizer"].get("add_prefix_space") or not read["pre_tokenizer"].get("use_regex", True):
            raise ValueError("not a plain byte-level vocabulary")
        if model.get("ignore_merges") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in read["added_tokens"]):
            raise ValueError("merges that are ignored and special tokens that take white space are not supported")
        ids = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in read["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(map(letters.__getitem__, token))
        for content, i in self.special.items():
            self.bytes[i] = content
        self.of_byte = [ids[c] for c in sorted(letters, key=letters.__getitem__)]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self._long: dict[tuple[int, int], tuple[int, int]] = {}
        self.made = [ids[a + b] for a, b in pairs]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of least rank, the leftmost of these, is merged until none is left."""
        of_byte, ranks, made, none = self.of_byte, self.ranks, self.made, len(self.made)
        ids = [of_byte[b] for b in word]
        if len(ids) > LONG:
            return self._merged_long(ids)
        held = [ranks.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while held and (rank := min(held)) < none:
            i = held.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], held[i]
            if i < len(held):
                held[i] = ranks.get((ids[i], ids[i + 1]), none)
            if i:
                held[i - 1] = ranks.get((ids[i - 1], ids[i]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, in n log n steps."""
        self._long = known = self._long or {p: (rank, self.made[rank]) for p, rank in self.ranks.items()}
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*known[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in known]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or known.get((ids[i], ids[j])) != (rank, new):  # one of the two has been merged since
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := known.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := known.get((ids[h], new))) is not None:
                heapq.heappush(heap, (found[0], h, found[1]))
        return [i for i in ids if i >= 0]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Words:
    """Where the words of many texts stand, as byte spans of the joined texts; special strings are spans of their own."""

    def __init__(self, values: list[bytes], classes: np.ndarray, special: Iterable[bytes] = ()):
        self.text = text = b"".join(values)
        self.data = np.frombuffer(text, np.uint8)
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        spans = self._special(special) if any(s in text for s in special) else []
        if text.isascii():
            points, at = self.data, None
        else:
            points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        n = len(points)
        edges = np.concatenate((self.bounds, np.array([e for s in spans for e in s[:2]], np.int64)))
        first = np.zeros(n + 1, bool)  # where a text, a special string or what follows one begins
        first[edges if at is None else np.searchsorted(at, edges)] = True
        start = self._starts(points, classes[points], first)
        for s, e, _ in spans:
            s, e = (s, e) if at is None else np.searchsorted(at, (s, e))
            start[s + 1 : e] = False
        begin = np.flatnonzero(start)
        self.start = begin if at is None else at[begin]
        self.end = np.append(self.start[1:], len(text)) if len(begin) else self.start
        self.special_at = [(int(np.searchsorted(self.start, s)), i) for s, _, i in spans]

    def _special(self, special: Iterable[bytes]) -> list[tuple[int, int, bytes]]:
        found = []
        for s, e in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            at = s
            while True:
                # The leftmost, and of those at one place the longest.
                near = [(i, -len(x), x) for x in special if (i := self.text.find(x, at, e)) >= 0]
                if not near:
                    break
                i, size, x = min(near)
                found.append((i, i - size, x))
                at = i - size
        return found

    @staticmethod
    def _starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where words begin: at a change of class, but the last of several white spaces stands apart and a blank joins what follows it;
        an apostrophe that no blank joins takes s, t, m, d, re, ve or ll with it."""
        n = len(points)
        start = first[:n].copy()
        if n == 0:
            return start
        start[1:] |= kind[1:] != kind[:-1]
        # After white space that is followed by something else in the same text.
        b = 1 + np.flatnonzero(start[1:] & ~first[1:n] & (kind[:-1] == SPACE))
        start[b - 1] = True
        start[b[points[b - 1] == 32]] = False
        a = np.flatnonzero(start[: n - 1] & (points[: n - 1] == APOSTROPHE))
        a = a[(kind[a + 1] == LETTER) & ~first[a + 1]]
        if len(a):
            x = points[a + 1]
            y = np.where(a + 2 < n, points[np.minimum(a + 2, n - 1)], 0)
            y = np.where(first[np.minimum(a + 2, n)], 0, y)
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
            a, size = a[one | two], np.where(one, 2, 3)[one | two]
            start[a + 1] = False
            ends = a + size
            start[ends[ends < n]] = True
        return start

    def texts(self, which: np.ndarray) -> list[bytes]:
        text = self.text
        return [text[s:e] for s, e in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]

    def counts(self, most: int = WORD_BYTES) -> dict[bytes, int]:
        """How often each word of at most `most` bytes stands there."""
        short = np.flatnonzero(self.end - self.start <= most)
        keys = bytes_np.span_hash(bytes_np.prefix_hash(bytes_np.BYTE_VALUE[self.data]), self.start[short], self.end[short])
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        return dict(zip(self.texts(short[first]), n.tolist(), strict=True))


def automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs and final marks of the minimal acyclic automaton of sorted distinct words, state 0 first.

    Words are added in order; what follows the prefix shared with the next word can't change any more, so its states are
    looked up by (final, arcs) from the end on and replaced by equal ones.
    """
    arcs: list[dict[int, int]] = [{}]
    final, free = [False], []
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) that are not settled
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (final[child], *arcs[child].items())
            same = known.setdefault(key, child)
            if same != child:
                arcs[parent][byte] = same
                free.append(child)

    for word in words:
        common_length = 0
        for x, y in zip(word, last, strict=False):
            if x != y:
                break
            common_length += 1
        settle(common_length)
        state = path[-1][2] if path else 0
        for byte in word[common_length:]:
            if free:
                child = free.pop()
                arcs[child], final[child] = {}, False
            else:
                child = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][byte] = child
            path.append((state, byte, child))
            state = child
        final[state] = True
        last = word
    settle(0)
    return arcs, final


def slots(keys: np.ndarray, mask: int) -> np.ndarray:
    return ((keys * np.int64(0x9E3779B1)) >> np.int64(15)) & np.int64(mask)


def compiled(words: list[bytes], ids: list[list[int]], classes: np.ndarray) -> bytes:
    """The file of a lexicon: arcs in an open table by (state, byte) with target and output, final marks, id outputs and the classes of characters."""
    order = sorted(range(len(words)), key=words.__getitem__)
    arcs, final = automaton([words[i] for i in order])
    below = [-1] * len(arcs)
    stack = [0]
    while stack:  # words that can be ended from each state
        s = stack[-1]
        waiting = [t for t in arcs[s].values() if below[t] < 0]
        if waiting:
            stack.extend(waiting)
        else:
            below[s] = final[s] + sum(below[t] for t in arcs[s].values())
            stack.pop()
    rows = []
    for s, out in enumerate(arcs):
        if below[s] >= 0:
            passed = int(final[s])
            for byte, t in sorted(out.items()):
                rows.append((s * 256 + byte, t, passed))
                passed += below[t]
    table = np.array(rows, np.int64).reshape(-1, 3)
    size = 1 << max(4, int(4 * len(table)).bit_length())
    keys, values = np.full(size, -1, np.int64), np.zeros((size, 2), np.int32)
    left, slot, probes = table, slots(table[:, 0], size - 1), 0
    while len(left):
        probes += 1
        open_at = np.flatnonzero(keys[slot] < 0)
        _, one = np.unique(slot[open_at], return_index=True)
        put = open_at[one]
        keys[slot[put]], values[slot[put]] = left[put, 0], left[put, 1:]
        rest = np.ones(len(left), bool)
        rest[put] = False
        left, slot = left[rest], (slot[rest] + 1) & (size - 1)
    lengths = np.array([len(ids[i]) for i in order], np.int64)
    flat = np.array([x for i in order for x in ids[i]], np.uint32)
    parts = [keys, values.reshape(-1), np.array(final, np.uint8), np.concatenate(([0], np.cumsum(lengths))), flat, classes]
    blobs = [p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts]
    return MAGIC + struct.pack("<7q", probes, *[len(p) for p in parts]) + b"".join(blobs)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    KINDS = (np.int64, np.int32, np.uint8, np.int64, np.uint32, np.uint8)

    def __init__(self, file: str):
        whole = np.memmap(file, np.uint8, "r")
        if bytes(whole[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        self.probes, *sizes = struct.unpack("<7q", bytes(whole[8:64]))
        at, parts = 64, []
        for kind, n in zip(self.KINDS, sizes, strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(whole[at : at + size].view(kind))
            at += size + -size % 8
        self.keys, values, self.final, self.begin, self.ids, self.classes = (np.asarray(p) for p in parts)
        self.values, self.mask = values.reshape(-1, 2), len(self.keys) - 1

    def _arcs(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each (state, byte), -1 where there is no such arc."""
        slot = slots(keys, self.mask)
        found = self.keys[slot]
        slot = np.where(found == keys, slot, np.where(found < 0, -1, -2 - slot))
        left = np.flatnonzero(slot < -1)
        at = -2 - slot[left]
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit, miss = found == keys[left], found < 0
            slot[left[hit]], slot[left[miss]] = at[hit], -1
            on = ~(hit | miss)
            left, at = left[on], at[on]
        slot[left] = -1
        return slot

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word in the list of outputs, -1 for words that the lexicon lacks; all words go a byte further in each step."""
        length = end - start
        out = np.full(len(start), -1, np.int64)
        which = np.flatnonzero(length <= WORD_BYTES)
        at, left = start[which], length[which]
        state, total = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        while len(which):
            slot = self._arcs(state * 256 + data[at])
            if (slot < 0).any():
                on = slot >= 0
                which, at, left, total, slot = which[on], at[on], left[on], total[on], slot[on]
            step = self.values[slot]
            state, left = step[:, 0].astype(np.int64), left - 1
            total = total + step[:, 1]
            done = left == 0
            if done.any():
                ended = np.flatnonzero(done)
                ended = ended[self.final[state[ended]] > 0]
                out[which[ended]] = total[ended]
                on = ~done
                which, at, left, total, state = which[on], at[on], left[on], total[on], state[on]
            at = at + 1
        return out


class Encoder:
    """Ids of whole texts from a lexicon and, for words that it lacks, from merges."""

    def __init__(self, path: str, lexicon: Lexicon, cache_words: int = CACHE_WORDS):
        self.vocabulary, self.lexicon, self.cache_words = vocabulary(path), lexicon, cache_words
        self.cache: dict[bytes, list[int]] = {}

    def many(self, values: list[bytes]) -> list[np.ndarray]:
        words = Words(values, self.lexicon.classes, self.vocabulary.special)
        place = self.lexicon.places(words.data, words.start, words.end)
        begin, ids = self.lexicon.begin, self.lexicon.ids
        special = {w: self.vocabulary.special[x] for w, x in words.special_at}
        place[list(special)] = -1
        known = place >= 0
        n = np.zeros(len(place), np.int64)
        n[known] = begin[place[known] + 1] - begin[place[known]]
        lacked = np.flatnonzero(~known)
        merged = [[special[w]] if w in special else self._word(t) for w, t in zip(lacked.tolist(), words.texts(lacked), strict=True)]
        n[lacked] = np.fromiter(map(len, merged), np.int64, len(merged))
        ends = np.concatenate(([0], np.cumsum(n)))
        out = np.empty(ends[-1], np.uint32)
        from_list, inside = n[known], np.zeros(len(out), bool)
        at = np.arange(from_list.sum()) + np.repeat(begin[place[known]] - (np.cumsum(from_list) - from_list), from_list)
        if len(lacked):
            inside[np.repeat(ends[lacked], n[lacked]) + np.arange(n[lacked].sum()) - np.repeat(np.cumsum(n[lacked]) - n[lacked], n[lacked])] = True
            out[inside] = np.fromiter((i for x in merged for i in x), np.uint32, int(n[lacked].sum()))
        out[~inside] = ids[at]
        return np.split(out, ends[np.searchsorted(words.start, words.bounds[1:-1])])

    def _word(self, word: bytes) -> list[int]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= self.cache_words:
                self.cache = {}
            found = self.cache[word] = self.vocabulary.merged(word)
        return found


class Decoder:
    """Texts of ids: the bytes of all ids of a chunk are gathered at once."""

    def __init__(self, path: str):
        tokens = vocabulary(path).bytes
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def many(self, values: list[np.ndarray]) -> list[bytes]:
        flat = np.concatenate([np.zeros(0, np.uint32), *values]).astype(np.int64)
        n = self.size[flat]
        ends = np.concatenate(([0], np.cumsum(n)))
        data = self.blob[np.arange(ends[-1]) + np.repeat(self.begin[flat] - ends[:-1], n)].tobytes()
        bounds = ends[np.concatenate(([0], np.cumsum([len(v) for v in values]).astype(np.int64)))].tolist()
        return [data[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def count_words(documents: DataFrame, path: str, most_bytes: int = WORD_BYTES) -> DataFrame:
    """(word, n) over all whole texts. A task adds up its own counts before they are shuffled and hands them on whenever it holds HELD_WORDS words."""
    special = list(vocabulary(path).special)
    classes = documents.sparkSession.sparkContext.broadcast(character_classes(path))  # a byte for each code point: 1.1 MB, whatever the input

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for (values,) in common.chunks(batches, "text", size=AT_ONCE):
            held.update(Words(values, classes.value, special).counts(most_bytes))
            if len(held) >= HELD_WORDS:
                yield rows()
                held = Counter()
        yield rows()

    return common.as_table(documents, "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counted: DataFrame, size: int) -> int:
    """The least count so that at most `size` words have it or more; counts of over three digits go by their first three, so there are some thousands of them."""
    digits = F.greatest(F.floor(F.log10("n")) - 2, F.lit(0))
    step = F.pow(F.lit(10.0), digits).cast("long")
    room, least = size, 1 << 62
    for row in counted.groupBy((F.expr("n") - F.expr("n") % step).alias("c")).agg(F.count("*").alias("words")).orderBy(F.col("c").desc()).collect():
        if row.words > room:
            break
        room, least = room - row.words, row.c
    return least


def compile_lexicon(documents: DataFrame, path: str, size: int = LEXICON_WORDS) -> str:
    """Compiles the `size` most frequent words that stand twice or more and sends the file to the executors; returns its name there.

    Ids of the words are merged in tasks; only the lexicon, bounded by `size`, comes to the driver. Words that stand as often as the first one that has no
    room stay out, so a count decides and no task sorts the words.
    """

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = vocabulary(path).merged
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array([merged(w) for w in words.to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    counted, all_counted = common.cut(count_words(documents, path).filter("n > 1"), "counts")
    found, folder = common.cut(counted.filter(F.col("n") >= least_count(counted, size)).select("word"), "words")
    common.drop(documents.sparkSession, all_counted)
    rows = found.repartition(max(1, min(64, found.count() // 4096)), "word").mapInArrow(outputs, "word binary, ids array<int>").toArrow()
    common.drop(documents.sparkSession, folder)
    file = compiled(rows["word"].to_pylist(), rows["ids"].to_pylist(), character_classes(path))
    return shipped(documents.sparkSession, file)


def shipped(spark: SparkSession, file: bytes) -> str:
    """Spark hands the file to executors, those that start later too; the copy that it serves stays with the driver as long as the application runs."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="gridfuse-lexicon-"), name)
    with open(path, "wb") as out:
        out.write(file)
    spark.sparkContext.addFile(path)
    return name


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, name: str) -> Encoder:
    """One for each Python worker and lexicon; the last one is kept."""
    if (path, name) not in _encoders:
        _encoders.clear()
        _encoders[path, name] = Encoder(path, Lexicon(SparkFiles.get(name)))
    return _encoders[path, name]


def encode(documents: DataFrame, path: str, lexicon: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers; with `decoded` also the text that `decode` makes of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, back = encoder(path, lexicon).many, Decoder(path).many if decoded else None
        for doc_ids, values in common.chunks(batches, "text", "doc_id", size=AT_ONCE):
            ids = [x.astype("<u4").tobytes() for x in many(values)]
            arrays = [pa.array(doc_ids, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                arrays.append(pa.array([t.decode("utf-8", "replace") for t in back([np.frombuffer(x, "<u4") for x in ids])], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "text"][: len(arrays)])

    return common.as_table(documents, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encode` with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = Decoder(path).many
        for batch in batches:
            values = batch.column("ids").to_pylist()
            at = 0
            while at < len(values):
                end, held = at, 0
                while end < len(values) and (end == at or held + len(values[end]) <= 4_000_000):
                    held += len(values[end])
                    end += 1
                texts = many([np.frombuffer(v, "<u4") for v in values[at:end]])
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [*batch.schema.names, "text"])
                at = end

    return encoded.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in encoded.dtypes)}, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    documents = common.read(spark, sf_dir, "documents")
    encoded = encode(documents, path, compile_lexicon(documents, path), decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
