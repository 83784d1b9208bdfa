"""Operator 5: language identification by a byte convolutional network.

A text is cut into windows of `WINDOW` bytes, the last padded. Bytes are embedded; filters
of several widths slide over a window, their maxima go through ReLU and a softmax layer. A
document's probabilities are the mean of its windows', weighted by their bytes. The
network is trained here with numpy, on at most PER_LANG windows a language (those of
least hash) of texts that are not held out; predictions read whole texts.

Defined results: null text or text without a letter is `und` with score 0; documents with
null lang are not learned from; with nothing to learn from every document is `und`; a null doc_id is never held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.llm import common

WINDOW, PER_LANG = 256, 500
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def windows(text: bytes) -> np.ndarray:
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    """Embedding, filters of each width, and a linear layer."""

    def __init__(self, classes: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.4, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)
        self.pairs: list[list[np.ndarray]] = []

    def compile(self) -> Network:
        """Tables of what two adjacent bytes, and a last odd one, add to each filter: a convolution is then a sum of look-ups."""
        self.pairs = []
        for f in self.filters:
            taps = [self.embed @ f[i] for i in range(len(f))]
            two = [(taps[i][:, None, :] + taps[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, len(f) - 1, 2)]
            self.pairs.append(two + ([taps[-1]] if len(f) % 2 else []))
        return self

    def features(self, x: np.ndarray) -> np.ndarray:
        """Maxima over each window, (windows, widths * filters)."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best = []
        for tables, w in zip(self.pairs, WIDTHS, strict=True):
            n = x.shape[1] - w + 1
            z = tables[0][pair[:, :n]]
            if w > 2:
                z += tables[1][(pair if w % 2 == 0 else x)[:, 2 : 2 + n]]
            best.append(z.max(1))
        return np.concatenate(best, 1)

    def maxima(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same from the weights themselves, with the places of the maxima; for training."""
        e = np.ascontiguousarray(self.embed[x].reshape(len(x), -1))
        best, at = [], []
        for f, w in zip(self.filters, WIDTHS, strict=True):
            spans = np.lib.stride_tricks.sliding_window_view(e, w * EMBED, axis=1)[:, ::EMBED]
            z = spans @ f.reshape(-1, FILTERS)
            best.append(z.max(1))
            at.append(z.argmax(1))
        return np.concatenate(best, 1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.features(x), 0) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
        """Adam on the cross entropy; a maximum passes its gradient to the bytes under it only."""
        rng = np.random.default_rng(seed)
        weights = [self.embed, *self.filters, self.out, self.bias]
        m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                a, at = self.maxima(x[rows])
                h = np.maximum(a, 0)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                da = (p @ self.out.T) * (a > 0)
                grads = [np.zeros_like(self.embed)]
                for j, (f, w) in enumerate(zip(self.filters, WIDTHS, strict=True)):
                    d = da[:, j * FILTERS : (j + 1) * FILTERS]
                    g = np.zeros_like(f)
                    for t in range(w):
                        under = x[rows][np.arange(len(rows))[:, None], at[j] + t]
                        g[t] = np.einsum("bke,bk->ek", self.embed[under], d)
                        np.add.at(grads[0], under, d[:, :, None] * f[t].T[None])
                    grads.append(g)
                grads[0][0] = 0
                grads += [h.T @ p, p.sum(0)]
                step += 1
                for w, g, mm, vv in zip(weights, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        return self.compile()


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, per_lang: int = PER_LANG) -> Network | None:
    """A network trained on at most `per_lang` windows, from as many texts, of each language."""
    rows = documents.filter(~held_out()).filter("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    order = F.xxhash64("doc_id", "text")
    some = rows.select("lang", F.expr(f"substring(text, 1 + cast(pmod(xxhash64(text), greatest(1, length(text) - {WINDOW})) as int), {WINDOW})").alias("piece"), order.alias("o"))
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).filter(F.col("n") <= per_lang)
    found = some.select("lang", "piece", "o").toPandas().sort_values(["lang", "o"])
    if found.empty:
        return None
    classes = sorted(found.lang.unique())
    x = np.stack([np.frombuffer(p.encode()[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for p in found.piece])
    return Network(classes).train(x, np.searchsorted(classes, found.lang.to_numpy().astype(str)))


def predict(documents: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for ids, held, values in common.chunks(batches, "text", "doc_id", "held_out", size=1 << 20):
            langs, scores = ["und"] * len(values), np.zeros(len(values))
            known = [i for i, v in enumerate(values) if net is not None and has_letter(v)]
            if known:
                cut = [windows(values[i]) for i in known]
                x = np.concatenate(cut)
                n = np.array([len(c) for c in cut])
                starts = np.cumsum(n) - n
                p = np.concatenate([net.probabilities(x[i : i + 2048]) for i in range(0, len(x), 2048)])
                share = np.full(len(x), WINDOW, np.float64)
                share[starts + n - 1] = [len(values[i]) - (k - 1) * WINDOW for i, k in zip(known, n.tolist(), strict=True)]
                mean = np.add.reduceat(p * share[:, None], starts) / np.add.reduceat(share, starts)[:, None]
                for i, k, s in zip(known, mean.argmax(1), mean.max(1), strict=True):
                    langs[i], scores[i] = net.classes[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(langs), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.as_table(common.read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return predict(documents, fit(documents))
