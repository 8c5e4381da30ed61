"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter's maximum over the
window is pooled, and a softmax layer gives the languages' probabilities. The network is trained here, in numpy, on
windows of a bounded sample of labelled rows, in equal parts for each language. A text of any length is cut, whole, into windows that overlap by the widest filter less one
byte, so that every byte sequence a filter could see lies whole in one of them; the text's probabilities are the
windows' means, weighted by how full they are.

For prediction, embedding and filters are multiplied out into tables over pairs of bytes: a filter of width 4 is
then the sum of two rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import record_batch, slices, view

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
STRIDE = LENGTH - max(WIDTHS) + 1
#: The sample that the network learns from: at most so many rows and bytes, in equal shares for each of at most LANGUAGES
#: languages (those of the most rows), of texts of at most ROW_BYTES, whole.
TRAIN_ROWS, TRAIN_BYTES, ROW_BYTES = 4000, 16 << 20, 1 << 20
LANGUAGES = 1024
SEEN = 60_000
UNKNOWN = "und"


def to_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, padded with zeros, and how many of its bytes each begins with."""
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + LENGTH, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    windows = np.lib.stride_tricks.as_strided(padded, (n, LENGTH), (STRIDE, 1))
    return windows, np.minimum(len(data) - STRIDE * np.arange(n), STRIDE).clip(1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Network:
    """The weights: embedding (256, E), per width a filter bank (width, E, F) and bias (F), and the last layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    last: np.ndarray
    last_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 0) -> Network:
        g = np.random.default_rng(seed)
        f = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            languages, f(256, EMBEDDING, scale=0.5), [f(w, EMBEDDING, FILTERS, scale=(2 / (w * EMBEDDING)) ** 0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            f(len(WIDTHS) * FILTERS, len(languages), scale=0.2), np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.last, self.last_bias]

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss of a batch, and its gradients in the order of weights(). Through a maximum only one place is reached."""
        n = len(windows)
        embedded = self.embedding[windows]
        pooled, where = [], []
        for w, k, b in zip(WIDTHS, self.filters, self.biases):
            out = sum(embedded[:, j : LENGTH - w + 1 + j] @ k[j] for j in range(w))
            at = out.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(out, at[:, None], axis=1)[:, 0] + b)
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        p = softmax(hidden @ self.last + self.last_bias)
        loss = float(-np.log(p[np.arange(n), labels] + 1e-9).mean())
        d = p
        d[np.arange(n), labels] -= 1
        d /= n
        d_last, d_last_bias = hidden.T @ d, d.sum(axis=0)
        d_hidden = (d @ self.last.T) * (hidden > 0)
        d_embedding, d_filters, d_biases = np.zeros_like(self.embedding), [], []
        rows = np.arange(n)[:, None]
        for i, (w, k) in enumerate(zip(WIDTHS, self.filters)):
            g = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
            d_biases.append(g.sum(axis=0))
            d_k = np.zeros_like(k)
            for j in range(w):
                seen = windows[rows, where[i] + j]  # (n, F)
                d_k[j] = np.einsum("nfe,nf->ef", self.embedding[seen], g, optimize=True)
                np.add.at(d_embedding, seen.ravel(), (g[:, :, None] * k[j].T[None]).reshape(-1, EMBEDDING))
            d_filters.append(d_k)
        return loss, [d_embedding, *d_filters, *d_biases, d_last, d_last_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seen: int = SEEN, seed: int = 0) -> Network:
    """Adam over shuffled batches until so many windows were seen."""
    net, g, batch = Network.new(languages, seed), np.random.default_rng(seed), 64
    m = [np.zeros_like(x) for x in net.weights()]
    v = [np.zeros_like(x) for x in net.weights()]
    step, steps = 0, max(1, seen // batch)
    while step < steps:
        order = g.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            _, grads = net.gradients(windows[part], labels[part])
            step += 1
            rate = 4e-3 * min(1.0, 2 * (1 - step / (steps + 1)))
            for x, d, a, b in zip(net.weights(), grads, m, v):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            if step >= steps:
                break
    return net


class Predictor:
    """The network with its tables multiplied out."""

    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, []
        for w, k, b in zip(WIDTHS, net.filters, net.biases):
            single = [net.embedding @ k[j] for j in range(w)]
            single[0] = single[0] + b
            pairs = [(single[j][:, None, :] + single[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            self.tables.append((w, pairs, single[-1] if w % 2 else None))

    def windows(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        """The languages' probabilities of each window."""
        out = np.empty((len(windows), len(self.net.languages)), np.float32)
        for at in range(0, len(windows), batch):
            x = windows[at : at + batch]
            pair = (x[:, :-1].astype(np.intp) << 8) | x[:, 1:]
            pooled = []
            for w, pairs, odd in self.tables:
                m = LENGTH - w + 1
                y = np.take(pairs[0], pair[:, :m], axis=0)
                for j, t in enumerate(pairs[1:], 1):
                    y += np.take(t, pair[:, 2 * j : 2 * j + m], axis=0)
                if odd is not None:
                    y += np.take(odd, x[:, w - 1 : w - 1 + m], axis=0)
                pooled.append(y.max(axis=1))
            out[at : at + batch] = softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.last + self.net.last_bias)
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and probability of each text; UNKNOWN and 0 where there is no letter."""
        parts, fill, of = [], [], []
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                w, f = cut(to_bytes(t))
                parts.append(w)
                fill.append(f)
                of.append(np.full(len(w), i))
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not parts or not self.net.languages:
            return out
        p, weight, of = self.windows(np.concatenate(parts)), np.concatenate(fill).astype(np.float64), np.concatenate(of)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        for i, row in zip(of[starts], mean):
            best = int(row.argmax())
            out[i] = self.net.languages[best], min(1.0, float(row[best]))
        return out


def training_rows(labelled: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """lang and text of a sample of labelled (id, text, lang): for each language an equal share of the rows and of the bytes,
    the rows whose ids' hashes are the least. Texts are taken whole; those beyond row_bytes aren't in the sample."""
    able = labelled.filter(F.octet_length("text") <= row_bytes)
    counts = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    share = max(1, rows // max(1, len(counts)))
    part = (F.xxhash64("id").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    known = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (1.3 * share + 40) / r["n"])) for r in counts], "lang string, part double")
    # a little more than a language's share, of which the rest goes; LANGUAGES rows are sent
    near = able.withColumn("h", part).join(F.broadcast(known), "lang").filter(F.col("h") < F.col("part"))
    order = Window.partitionBy("lang").orderBy("h", "id", "text")
    placed = near.withColumn("k", F.row_number().over(order)).withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter((F.col("k") <= share) & ((F.col("upto") <= size // max(1, len(counts))) | (F.col("k") == 1))).select("lang", "text")


def training_windows(labelled: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, bytes]]:
    """All windows of training_rows that have a letter in their text, with their language."""
    schema = pa.schema([("lang", pa.string()), ("window", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if any(map(str.isalpha, text)):
                    out += [(lang, w.tobytes()) for w in cut(to_bytes(text))[0]]
            yield record_batch(schema, {"lang": [x for x, _ in out], "window": [x for _, x in out]})

    return sorted((r["lang"], bytes(r["window"])) for r in training_rows(labelled, rows).mapInArrow(run, "lang string, window binary").collect())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Network:
    """A network for the languages of at most rows rows with a label; without any, one that knows no language."""
    found = training_windows(view(labelled, id=id_col, text=text_col, lang=lang_col).filter("lang IS NOT NULL AND text IS NOT NULL"), rows)
    languages = sorted({x for x, _ in found})
    if not found:
        return Network.new([])
    windows = np.stack([np.frombuffer(b, np.uint8) for _, b in found])
    return train(windows, np.array([languages.index(x) for x, _ in found]), languages)


def held_out(doc_id: Column) -> Column:
    """Of a third of the ids, from which nothing is learned. A null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score. Texts that are null or have no letter are 'und' with score 0,
    as are all where the network knows no language. Ids may be null or repeated. An empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(sent.value)
        for batch in slices(batches, 256):
            found = predictor.texts(batch["text"].to_pylist())
            yield record_batch(schema, {"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return view(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return predict(docs, fit(docs.filter(learn))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
