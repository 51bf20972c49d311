"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and of its character n-grams, hashed into
buckets; a window of words is the mean of its words, repeats within a window's reach
counting as nothing; a softmax over two classes reads it. The score of a text is that of its most toxic window, so a few words count alike in
short and in very long texts. Misspelt words share most n-grams with the words they
come from. Once trained, embeddings and softmax fold into one number for each bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, remainder
from .sampling import labelled_sample

MARKS = bytes.maketrans(b'.,;:!?"()[]{}<>', b" " * 15)


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8, cut at blanks and at sentence marks."""
    return text.lower().encode("utf-8", "replace").translate(MARKS).split()


def subwords(words: list[bytes], buckets: int, lengths: tuple[int, ...] = (3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of each word itself and of each of its n-grams, ends marked."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), sizes)
    at, out = [np.arange(len(words))], [np.fromiter(map(zlib.crc32, words), np.uint64, len(words))]
    for n in lengths:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
        whole = own[: len(h)] == own[n - 1 :]
        at.append(own[: len(h)][whole])
        out.append(h[whole])
    mixed = np.concatenate(out) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return np.concatenate(at), (mixed % np.uint64(buckets)).astype(np.int64)


@dataclass
class ToxicityModel:
    """One number for each bucket (its vector times the difference of the two softmax rows), and the words of a window.

    ``slope`` and ``bias`` calibrate the mean of the best window to a log odds.
    """

    weights: np.ndarray
    slope: float
    bias: float
    window: int

    def word_values(self, words: list[bytes]) -> np.ndarray:
        at, bucket = subwords(words, len(self.weights))
        return np.bincount(at, self.weights[bucket], len(words)) / np.bincount(at, minlength=len(words))

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        """Of a text of words given by number, with the values of the numbers; windows at every word, missing words count as zero."""
        if not len(ids):
            return 0.0
        best = best_window(np.where(fresh(ids, self.window), values[ids], 0.0), self.window)[1]
        return float(1 / (1 + np.exp(-np.clip(self.slope * best + self.bias, -60, 60))))


def fresh(ids: np.ndarray, window: int) -> np.ndarray:
    """Whether a word differs from the `window` - 1 before it."""
    order = np.argsort(ids, kind="stable")
    out = np.ones(len(ids), bool)
    out[order[1:]] = (ids[order[1:]] != ids[order[:-1]]) | (np.diff(order) >= window)
    return out


def best_window(values: np.ndarray, window: int) -> tuple[int, float]:
    """Start and mean of the window with the largest mean."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    means = (total[window:] - total[:-window]) / window if len(values) > window else total[-1:] / window
    k = int(means.argmax())
    return k, float(means[k])


def _grouped(words: list[bytes], buckets: int, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word, word after word, and how many each has; made in blocks, to hold little at a time."""
    out, sizes = [], []
    for k in range(0, len(words), block):
        at, bucket = subwords(words[k : k + block], buckets)
        out.append(bucket[np.argsort(at, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(at, minlength=len(words[k : k + block])))
    return np.concatenate(out), np.concatenate(sizes)


def fit(sample: list[tuple[str, int]], buckets: int = 1 << 17, dim: int = 8, window: int = 24, epochs: int = 24, rate: float = 0.5, seed: int = 11) -> ToxicityModel | None:
    """From whole texts and labels 0 or 1; None unless both labels are there.

    The first rounds read random windows of a text; later ones the window that scores
    highest so far, with another at random from the texts labelled 0. Each fifth text is
    kept from training and calibrates the scores.
    """
    rng = np.random.default_rng(seed)
    names: dict[bytes, int] = {}
    coded = []
    for text, y in sample:
        if words := words_of(text):
            ids = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int32, len(words))
            coded.append((ids, fresh(ids, window), int(y)))
    if len({y for *_, y in coded}) < 2:
        return None
    kept = [x for k, x in enumerate(coded) if k % 5 == 4]
    coded = [x for k, x in enumerate(coded) if k % 5 != 4]
    bucket, sizes = _grouped(list(names), buckets)
    first = np.cumsum(sizes) - sizes
    e, w, b = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), rng.normal(0, 0.5, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    ge, gw = np.full(buckets, 1e-6, np.float32), np.full((2, dim), 1e-6, np.float32)
    decay = 2 / len(coded)
    share = np.array([0.5 / max(1, sum(y == c for *_, y in coded)) for c in (0, 1)])

    for epoch in range(epochs):
        values = _centred(e @ (w[1] - w[0]), bucket, first, sizes, coded)[1]
        picked: list[tuple[np.ndarray, int, float]] = []
        for ids, new, y in coded:
            starts = {int(rng.integers(0, max(1, len(ids) - window + 1)))} if epoch < 2 and y == 0 else set()
            if epoch < 2 and y == 1:
                starts = set(range(0, max(1, len(ids) - window // 2), window)) if len(ids) <= 40 * window else set(rng.integers(0, len(ids) - window, 40).tolist())
            elif epoch >= 2:
                starts = {best_window(np.where(new, values[ids], 0.0), window)[0]} | ({int(rng.integers(0, max(1, len(ids) - window + 1)))} if y == 0 else set())
            picked += [(ids[s : s + window][new[s : s + window]], y, share[y] / len(starts)) for s in starts]
        for k in np.array_split(rng.permutation(len(picked)), -(-len(picked) // max(16, min(256, len(picked) // 24)))):
            part = [picked[i] for i in k]
            ids = np.concatenate([p[0] for p in part])
            seg = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            n = sizes[ids]
            subs = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            subs, each, of = bucket[subs], np.repeat(1 / (n * window), n).astype(np.float32), np.repeat(seg, n)
            x = np.stack([np.bincount(of, e[subs, d] * each, len(part)) for d in range(dim)], axis=1)
            z = x @ w.T + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [q[1] for q in part]] -= 1
            p *= (np.array([q[2] for q in part]) * len(coded))[:, None]
            dw, dx = p.T @ x, (p @ w).astype(np.float32)
            touched, back = np.unique(subs, return_inverse=True)
            g = np.stack([np.bincount(back, dx[of, d] * each, len(touched)) for d in range(dim)], axis=1).astype(np.float32)
            g += decay * e[touched]
            dw += decay * w
            gw += dw**2
            ge[touched] += (g**2).mean(axis=1)
            w -= (rate * 0.2 * dw / np.sqrt(gw)).astype(np.float32)
            b -= (0.02 * p.mean(axis=0)).astype(np.float32)
            e[touched] -= rate * 0.2 * g / np.sqrt(ge[touched])[:, None]
    weights, values = _centred(e @ (w[1] - w[0]), bucket, first, sizes, coded)
    slope, bias = _calibrate(np.array([best_window(np.where(new, values[ids], 0.0), window)[1] for ids, new, _ in kept or coded]), np.array([y for *_, y in kept or coded]))
    return ToxicityModel(weights, slope, bias, window)


def _centred(weights: np.ndarray, bucket: np.ndarray, first: np.ndarray, sizes: np.ndarray, coded: list) -> tuple[np.ndarray, np.ndarray]:
    """Weights and values of words, moved so that the mean word of the texts labelled 0 counts as much as a missing one: nothing."""
    values = np.add.reduceat(weights[bucket], first) / sizes
    middle = np.concatenate([values[ids[new]] for ids, new, y in coded if y == 0] or [values]).mean()
    return weights - middle, values - middle


def _calibrate(x: np.ndarray, y: np.ndarray, clean: float = 5.0) -> tuple[float, float]:
    """Slope and bias of a logistic curve that crosses a half where least is lost, and is at 0.98 for the median text labelled 1.

    The share of texts labelled 0 above the crossing weighs `clean` times the share of
    those labelled 1 below it; of the best crossings it is the middle of the widest gap.
    """
    cuts = np.unique(x)
    mids = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1e-3]])
    gap = np.concatenate([np.diff(cuts), [0.0]])
    zero, one = np.sort(x[y == 0]), np.sort(x[y == 1])
    lost = clean * (1 - np.searchsorted(zero, mids) / max(1, len(zero))) + np.searchsorted(one, mids) / max(1, len(one))
    best = np.flatnonzero(lost <= lost.min() + 1e-9)
    cross = mids[best[gap[best].argmax()]]
    spread = float(np.median(one)) - cross if len(one) else 0.0
    slope = 4 / spread if spread > 1e-6 else 4 / max(1e-6, float(np.std(x)))
    return float(slope), float(-slope * cross)


class _Scorer:
    """Scores of texts; keeps the values of up to `cached` words."""

    def __init__(self, model: ToxicityModel | None, cached: int = 300_000) -> None:
        self.model, self.known, self.values = model, {}, np.empty(cached)

    def __call__(self, text: str | None) -> float:
        words = words_of(text or "") if self.model else []
        if not words:
            return 0.0
        if new := list(set(words).difference(self.known)):
            if len(self.known) + len(new) > len(self.values):
                self.known.clear()
                new = list(set(words))
                self.values = np.empty(max(len(self.values), len(new)))
            self.values[len(self.known) : len(self.known) + len(new)] = self.model.word_values(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return self.model.score(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)), self.values)


def _scores(model: ToxicityModel | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(model)
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[*batch.schema.names[1:], "score"])

    return run


def _below(model: ToxicityModel | None, text_at: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < threshold for t in batch.column(text_at)], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score is below the threshold; null and empty texts stay."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_below(model, docs.columns.index(text_col), threshold), docs.schema)


def score_documents(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): a score in 0 to 1 of each row's whole text.

    Null, empty and wordless texts score 0, as does everything where there is no model.
    Repeated rows stay; no other column is read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.mapInArrow(_scores(model), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 100_000) -> ToxicityModel | None:
    """Fit on at most `per_class` documents of each label whose id falls in the training folds (crc32 of the id mod 5 is not 0)."""
    ours = labels.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return fit(labelled_sample(docs, ours, per_class, max_chars))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
