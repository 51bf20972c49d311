"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; the
largest response of each filter goes to a softmax over the languages. A text is read
whole, in windows that overlap by the widest filter less one byte, and the windows'
probabilities are averaged by their bytes. For use, the filters fold into tables of
responses to a byte and to a pair of bytes, so that a window is a few lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, remainder
from .sampling import labelled_sample

UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; numbers such as ½ or ① are not."""
    return any(map(str.isalpha, text))


@dataclass
class ByteNetwork:
    """Embedding (256 x d), for each width k filters (k * d x f) and their biases, and the softmax (all filters x languages)."""

    languages: list[str]
    window: int
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def draw(cls, languages: list[str], window: int, widths: tuple[int, ...], dim: int, each: int, seed: int) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, by: (rng.normal(0, 1, shape) * by).astype(np.float32)
        filters = {k: f32(k * dim, each, by=(2 / (k * dim)) ** 0.5) for k in widths}
        return cls(languages, window, f32(256, dim, by=1.0), filters, {k: np.zeros(each, np.float32) for k in widths}, f32(each * len(widths), len(languages), by=0.1), np.zeros(len(languages), np.float32))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest responses, and where they are, of rows of bytes."""
        e, outs, where = self.embedding[x], [], {}
        for k, f in self.filters.items():
            n = x.shape[1] - k + 1
            patches = np.concatenate([e[:, j : j + n] for j in range(k)], axis=2)
            y = patches.reshape(-1, patches.shape[2]) @ f
            y = y.reshape(len(x), n, -1)
            where[k] = y.argmax(axis=1)
            outs.append(np.take_along_axis(y, where[k][:, None], axis=1)[:, 0] + self.biases[k])
        return np.maximum(np.concatenate(outs, axis=1), 0), where

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _windows(text: bytes, window: int, overlap: int) -> list[bytes]:
    """Windows that cover a text; the last is filled up with blanks."""
    step = window - overlap
    return [text[at : at + window].ljust(window) for at in range(0, max(1, len(text) - overlap), step)]


def fit(sample: list[tuple[str, str]], window: int = 256, widths: tuple[int, ...] = (2, 3, 4), dim: int = 8, filters: int = 16, epochs: int = 8, per_text: int = 3, rate: float = 0.01, seed: int = 5) -> ByteNetwork | None:
    """From whole texts and their languages, windows at random places and of random lengths in each round, by Adam; None without texts."""
    texts = [(t.encode("utf-8", "replace"), y) for t, y in sample if has_letter(t)]
    languages = sorted({y for _, y in texts})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net = ByteNetwork.draw(languages, window, widths, dim, filters, seed)
    params = [net.embedding, net.out, net.out_bias, *net.filters.values(), *net.biases.values()]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    number, step = {c: i for i, c in enumerate(languages)}, 0
    weight = np.array([1 / sum(y == c for _, y in texts) for c in languages]) * len(texts) / len(languages)
    rounds = max(epochs, -(-1500 * epochs // (len(texts) * per_text)))
    for r in range(rounds):
        cut, ys = [], []
        for t, y in texts:
            for _ in range(per_text):
                n = window if rng.random() < 0.6 else int(rng.integers(16, window))
                at = int(rng.integers(0, max(1, len(t) - n + 1)))
                cut.append(t[at : at + n].ljust(window))
                ys.append(number[y])
        x, ys = np.frombuffer(b"".join(cut), np.uint8).reshape(-1, window), np.array(ys)
        for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // 64)):
            step += 1
            xb, yb = x[rows], ys[rows]
            h, where = net.pooled(xb)
            g = net.probabilities(h)
            g[np.arange(len(yb)), yb] -= 1
            g *= (weight[yb] / len(yb))[:, None]
            dh = (g @ net.out.T) * (h > 0)
            grads = [np.zeros_like(net.embedding), h.T @ g, g.sum(axis=0)]
            df, db = [], []
            for i, (k, f) in enumerate(net.filters.items()):
                d = dh[:, i * f.shape[1] : (i + 1) * f.shape[1]]
                at = where[k][:, :, None] + np.arange(k)
                taken = xb[np.arange(len(xb))[:, None, None], at]
                patch = net.embedding[taken].reshape(len(xb), f.shape[1], -1)
                df.append(np.einsum("bf,bfp->pf", d, patch))
                db.append(d.sum(axis=0))
                back = (d[:, :, None] * f.T[None]).reshape(-1, dim)
                grads[0] += np.stack([np.bincount(taken.ravel(), back[:, c], 256) for c in range(dim)], axis=1)
            lr = rate * (1 - r / rounds) + 1e-4
            for p, gr, (m, v) in zip(params, [*grads, *df, *db], moments, strict=True):
                m += 0.1 * (gr - m)
                v += 0.01 * (gr * gr - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """A network folded into tables: responses to pairs of bytes, and to single ones for odd widths."""

    def __init__(self, net: ByteNetwork) -> None:
        self.net, self.tables, d = net, {}, net.embedding.shape[1]
        for k, f in net.filters.items():
            single = [net.embedding @ f[j * d : (j + 1) * d] for j in range(k)]
            pairs = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)) for j in range(0, k - 1, 2)]
            self.tables[k] = pairs + ([(k - 1, single[k - 1])] if k % 2 else [])
        self.widest = max(net.filters)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        outs = []
        for k, tables in self.tables.items():
            n, y = x.shape[1] - k + 1, None
            for j, t in tables:
                part = t.take((pair if len(t) > 256 else x)[:, j : j + n], axis=0)
                y = part if y is None else np.add(y, part, out=y)
            outs.append(y.max(axis=1) + self.net.biases[k])
        return np.maximum(np.concatenate(outs, axis=1), 0)

    def read(self, texts: list[str | None], block: int = 256) -> list[tuple[str, float]]:
        """(language, probability) of each whole text."""
        cut, own, size = [], [], []
        for i, text in enumerate(texts):
            if text and has_letter(text):
                data = text.encode("utf-8", "replace")
                parts = _windows(data, self.net.window, self.widest - 1)
                cut += parts
                own += [i] * len(parts)
                size += [self.net.window] * (len(parts) - 1) + [max(1, len(data) - (len(parts) - 1) * (self.net.window - self.widest + 1))]
        total = np.zeros((len(texts), len(self.net.languages)))
        for at in range(0, len(cut), block):
            x = np.frombuffer(b"".join(cut[at : at + block]), np.uint8).reshape(-1, self.net.window)
            np.add.at(total, own[at : at + block], self.net.probabilities(self.pooled(x)) * np.array(size[at : at + block])[:, None])
        best = total.argmax(axis=1)
        return [(self.net.languages[b], float(t[b] / s)) if (s := t.sum()) > 0 else (UNDETERMINED, 0.0) for b, t in zip(best.tolist(), total, strict=True)]


def _languages(net: ByteNetwork | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                found = reader.read(texts) if reader else [(UNDETERMINED, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    A text that is null or has no letter is `und` with score 0; so is every one where
    there was nothing to learn from. Repeated rows stay; no other column is read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_languages(net), "doc_id long, lang_pred string, score double")


def train(docs: DataFrame, per_class: int = 500, max_chars: int = 50_000) -> ByteNetwork | None:
    """Fit on at most `per_class` documents of each language whose crc32 of the id mod 3 is not 1."""
    ours = docs.where((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
    return fit(labelled_sample(ours, ours.select("doc_id", F.col("lang").alias("label")), per_class, max_chars))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
