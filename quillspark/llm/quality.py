"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

The statistics of a text are standardised and mapped by cosines of random directions,
whose products approximate a Gaussian kernel. Each partition sums its part of the normal
equations; Spark adds the parts, and the driver solves a system of fixed size. Scores of
rows kept from the fit are counted in bins, and isotonic regression over the bins turns
a score into a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, remainder

UPPER, LOWER, DIGIT = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), range(97, 123), range(48, 58)))
SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[]^_`{|}~\\"))
MARK, STOP, BAR, LINE, WIDE = (np.isin(np.arange(256), list(x)) for x in (b"!?", b".,;:", b"|", b"\n", range(128, 256)))

NAMES = ("log_bytes", "log_words", "word_length", "different_words", "repeated_words", "commonest_word", "upper", "letters", "digits", "symbols", "marks", "stops", "bars", "wide", "line_length", "different_lines", "entropy")


def statistics(text: str | None) -> list[float]:
    """Of a whole text, in the order of NAMES; all 0 for a text that is null or has no word."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, m, lines = len(data), len(words), data.split(b"\n")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    share = hist[hist > 0] / n
    solid = n - int(hist[[9, 10, 11, 12, 13, 32]].sum())
    part = lambda mask: float(hist[mask].sum()) / solid
    again = sum(map(eq, words, words[1:]))
    return [float(np.log1p(n)), float(np.log1p(m)), min(20.0, solid / m), len(counts) / m, again / m, max(counts.values()) / m, part(UPPER), part(UPPER | LOWER | WIDE), part(DIGIT), part(SYMBOL), part(MARK), part(STOP), part(BAR), part(WIDE), float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum())]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(NAMES))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "x"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>): the statistics of each row."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics, "doc_id long, x array<double>")


@dataclass
class FourierMap:
    """Cosines of random directions of standardised statistics; the bandwidth is in standard deviations."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int, bandwidth: float, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(0, 1 / bandwidth, (len(mean), features)), rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """With a column of ones in front."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(of: FourierMap) -> Callable:
    """(k, v): the sums of products of a partition's features, and of features and labels, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                z = of(_matrix(batch.column(0)))
                total = total + z.T @ np.concatenate([z, batch.column(1).to_numpy(zero_copy_only=False)[:, None]], axis=1)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    return run


@dataclass
class QualityModel:
    """Ridge weights over Fourier features, and the knots of the calibration."""

    features: FourierMap
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest rising values in weighted squares, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else values


def _raw(model: QualityModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))) if batch.num_rows else pa.array([], pa.float64()), batch.column(1)], names=["raw", "y"])

    return run


def fit(rows: DataFrame, features: int = 256, bandwidth: float = 3.0, ridge: float = 1e-4, bins: int = 1024, seed: int = 3) -> QualityModel | None:
    """From rows (doc_id, x, y) with y 0 or 1, all of them, none collected; None unless both labels are there.

    A quarter, by a hash of the id, is kept for the calibration.
    """
    prepare(rows.sparkSession)
    rows = rows.where("y is not null and x is not null").select("doc_id", "x", F.col("y").cast("double").alias("y"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    stats = rows.agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"), *(f(F.get("x", F.lit(k))).alias(f"{name}{k}") for k in range(len(NAMES)) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not stats["n"] or stats["low"] == stats["high"]:
        return None
    mean, scale = (np.array([stats[f"{c}{k}"] for k in range(len(NAMES))]) for c in "ms")
    of = FourierMap.draw(mean, np.where(scale > 1e-9, scale, 1.0), features, bandwidth, seed)
    sums = rows.where(~aside).select("x", "y").mapInArrow(_normal_equations(of), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    width, solved = features + 1, np.zeros((features + 1) * (features + 2))
    solved[sums["k"].to_numpy()] = sums["v"].to_numpy()
    solved = solved.reshape(width, width + 1)
    count = max(1.0, solved[0, 0])
    weights = np.linalg.solve(solved[:, :-1] + ridge * count * np.eye(width), solved[:, -1])
    model = QualityModel(of, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    spot = F.floor(F.least(F.greatest((F.col("raw") + 0.5) / 2, F.lit(0.0)), F.lit(1.0)) * bins)
    held = rows.where(aside).select("x", "y").mapInArrow(_raw(model), "raw double, y double").groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.avg("raw").alias("at"), F.avg("y").alias("y")).orderBy("bin").toPandas()
    if len(held) > 1:
        value = isotonic((held["y"] * held["n"]).to_numpy() / held["n"].to_numpy(), held["n"].to_numpy().astype(float))
        model.knots, model.values = held["at"].to_numpy(), np.clip(value, 0, 1)
    return model


def _scored(model: QualityModel | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = np.full(n, 0.5) if model is None or not n else np.clip(model.score(_matrix(batch.column(1))), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(statistics: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, score) of rows (doc_id, x); 0.5 for all where there is no model."""
    prepare(statistics.sparkSession)
    return statistics.select("doc_id", "x").mapInArrow(_scored(model), "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every row of docs, learnt from (doc_id, quality) of the training folds.

    crc32 of the id mod 5 is 0 in the fold held out. Each text is read once: its statistics
    are written to the shared folder. Null, empty and wordless texts have statistics of 0 and
    are scored by them. Labels that are null are left out, of repeated ones the largest counts.
    """
    x = materialise(document_statistics(docs, id_col, text_col), "statistics")
    ours = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = materialise(x.join(ours, "doc_id"), "labelled")
    return score_quality(x, fit(rows)).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    out = quality_scores(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
