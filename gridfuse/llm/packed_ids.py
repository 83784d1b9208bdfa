"""Operator 1: token ids in a binary file format of fixed-width bit packing.

A shard is: the 8 magic bytes, blocks of `block_ids` ids each packed in
`bits` bits (least significant bit first) and padded to whole bytes, then a footer of little-endian
64-bit integers - document ids, ids before each document, byte offset of each
block - then seven 64-bit fields (bits, block_ids, documents, ids, blocks, null
document ids as a flag, version) and the magic again. A reader needs the tail and the blocks that
hold the wanted ids, nothing else, and unpacks a block with numpy at once.

Defined results: null text counts as empty; an empty document is its end id
alone; repeated document ids stay separate documents, next to each other; a
null document id sorts first and comes back as null; an empty table gives no
shard and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.llm import bytes_np, common

MAGIC = b"GFBITS01"
NO_ID = np.iinfo(np.int64).min
#: Ids in a block, and ids in a shard before the writer begins another.
BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 26
CACHE_WORDS = 250_000

#: Latin letters that are composed already and whose lower case is one letter: nothing of the normalizer but the lower case touches them.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Byte-level vocabularies write each byte as a letter: printable ones as themselves, the rest from U+0100 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b if b in _printable else 256 + sum(x not in _printable for x in range(b))) for b in range(256)}

MANIFEST = "path string, first_id long, n_docs long, n_ids long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The inverse of `pack`, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    """Writes documents one after another; holds one block and the index of the documents in memory."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.out.write(MAGIC)
        self.at, self.n, self.held, self.n_held = len(MAGIC), 0, [], 0
        self.docs: list[int] = []
        self.starts, self.blocks = [0], [self.at]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.n += len(ids)
        self.starts.append(self.n)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) // self.block_ids * self.block_ids if whole else len(ids)
        for i in range(0, end, self.block_ids):
            data = pack(ids[i : i + self.block_ids], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole=False)
        tail = np.array([self.bits, self.block_ids, len(self.docs), self.n, len(self.blocks) - 1, NO_ID in self.docs, 1], "<i8")
        for part in (self.docs, self.starts, self.blocks, tail):
            self.out.write(np.asarray(part, "<i8").tobytes())
        self.out.write(MAGIC)
        self.out.close()


class ShardReader:
    """Random access to the ids of a shard by position or by document."""

    def __init__(self, file, size: int):
        self.file = file
        tail_bytes = 7 * 8 + len(MAGIC)
        file.seek(size - tail_bytes)
        tail = file.read(tail_bytes)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.bits, self.block_ids, docs, self.n, blocks, *_ = np.frombuffer(tail, "<i8", 7).tolist()
        index_bytes = 8 * (docs + docs + 1 + blocks + 1)
        file.seek(size - tail_bytes - index_bytes)
        index = np.frombuffer(file.read(index_bytes), "<i8")
        self.docs, self.starts, self.blocks = index[:docs], index[docs : 2 * docs + 1], index[2 * docs + 1 :]
        self._first, self._ids = -1, np.zeros(0, np.uint32)

    def _block(self, k: int) -> np.ndarray:
        if self._first != k:
            self.file.seek(int(self.blocks[k]))
            data = self.file.read(int(self.blocks[k + 1] - self.blocks[k]))
            self._first, self._ids = k, unpack(data, self.bits, min(self.block_ids, self.n - k * self.block_ids))
        return self._ids

    def ids(self, start: int, end: int) -> np.ndarray:
        parts = []
        for k in range(start // self.block_ids, (max(end, start + 1) - 1) // self.block_ids + 1):
            if start < end:
                parts.append(self._block(k)[max(0, start - k * self.block_ids) : end - k * self.block_ids])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class WordEncoder:
    """Encodes with the tokenizers library a white-space separated word at a time and keeps the ids of words seen.

    The vocabulary's pre-tokenizer drops white space and never joins pieces over
    it, so the ids of a text are those of its words in order.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_words = cache_words
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _pieces(self, word: str) -> bytes:
        if LETTERS.fullmatch(word):
            word = word.lower()
            tokens = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS))
        else:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))
            tokens = [t for piece, _ in pieces for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _kept(self, word: str) -> bytes | None:
        found = self.new.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.new[word] = found
        return found

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.new) >= self.cache_words:  # words that were not seen lately go
            self.old, self.new = self.new, {}
        self.new[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """A letter run and the marks after it are separate pieces, so the run's ids are shared by all its forms."""
        if (found := self._kept(word)) is not None:
            return found
        if any(s in word for s in self.special):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        stem = word.rstrip(".,;:!?")
        if not LETTERS.fullmatch(stem):
            return self._keep(word, self._pieces(word))
        key, marks = stem.lower(), word[len(stem) :]
        known = self._kept(key)
        ids = self._keep(key, self._pieces(key)) if known is None else known
        if marks:
            found = self._kept(marks)
            ids += self._keep(marks, self._pieces(marks)) if found is None else found
        return ids if known is None else self._keep(word, ids)

    def many(self, values: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8). Numpy finds the distinct words of all of them; Python sees each of those once."""
        if not values:
            return []
        text = b" ".join(values) + b" "
        data = np.frombuffer(text, np.uint8)
        start, end = bytes_np.word_spans(data)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) + 1
        words_before = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
        keys = bytes_np.span_hash(bytes_np.prefix_hash(bytes_np.BYTE_VALUE[data]), start, end)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        # Words that share a hash are compared; one that differs from the first of its hash is a word of its own.
        other = np.flatnonzero((end - start != (end - start)[first][which]) | ~bytes_np.same_spans(text, start, end, start[first][which]))
        which[other] = len(first) + np.arange(len(other))
        first = np.concatenate((first, other))
        word = self._word
        found = [word(text[s:e].decode()) for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        flat = np.frombuffer(b"".join(found), np.uint32)
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = (np.cumsum(n) - n)[which]
        n = n[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.arange(ends[-1]) + np.repeat(at - ends[:-1], n)]
        return np.split(ids, ends[words_before[1:-1]])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that its words serve later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(documents: DataFrame, tokenizer: str, folder: str, *, end_id: int = 1, block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes whole texts and writes shards in ascending doc_id order; returns the manifest, one row for each shard.

    The rows are dealt out by ranges of doc_id; a task writes its range as one
    or more shards under names no other attempt uses, and the manifest names
    those of the attempts that succeeded, so a lost executor costs its tasks only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bits = max(1, int(encode.vocabulary() - 1).bit_length())
        fs, top = common.filesystem(folder)
        writer, path, first, rows = None, "", None, []

        def finish():
            writer.close()
            rows.append((path, None if writer.docs[0] == NO_ID else writer.docs[0], len(writer.docs), writer.n))

        for doc_ids, values in common.chunks(batches, "text", "doc_id", size=4_000_000):
            for doc_id, ids in zip(doc_ids, encode.many(values), strict=True):
                if writer is None:
                    name = f"shard-{common.task_number()}.bits"
                    fs.create_dir(top, recursive=True)
                    path = f"{folder}/{name}"
                    writer = ShardWriter(fs.open_output_stream(f"{top}/{name}"), bits, block_ids)
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                if writer.n >= shard_ids:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "first_id", "n_docs", "n_ids"])

    ordered = common.as_table(documents, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest, _ = common.cut(ordered.mapInArrow(write, MANIFEST), "manifest")
    return manifest


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards that a manifest names, from their bytes."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = common.filesystem(row["path"])
                with fs.open_input_file(path) as file:
                    shard = ShardReader(file, file.size())
                    crcs = np.fromiter((zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(len(shard.docs))), np.int64, len(shard.docs))
                docs = pa.array(shard.docs, pa.int64(), mask=shard.docs == NO_ID)
                yield pa.RecordBatch.from_arrays([docs, pa.array(shard.starts[:-1] + row["before"]), pa.array(np.diff(shard.starts)), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One small row for each shard: the running sum needs them in one place, and shards are 2**26 ids each.
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    return placed.repartition(common.tasks(manifest), "path").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_shards(common.read(spark, sf_dir, "documents"), path, common.new_path(spark, "ids"))
    return read_shards(manifest)
