"""Ranked lexical search: a hierarchical max tree per term over ranges of documents, searched best first.

Each task reads its documents into shards: the postings of the terms that are searched
for, in order of term and document, with the lengths of all documents. From the counts of
all shards a posting gets its impact, a whole number, and each term a tree over ranges of
documents, `fan_out` ranges to one above, that holds the largest impact below. The bound
of a range for an item is the weighted sum of the maxima of its terms. The range of the
highest bound is opened first, and no more once `k` documents score above all bounds
left; ranges whose bound equals the lowest score kept are opened too, since a smaller id
in one may win the tie.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare
from .words import Words, mixed, parts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Vocabulary:
    """The terms of a block of items, numbered, and the items as numbers of terms, each once."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        held = [(i, sorted(set(TERM.findall((text or "").translate(TO_LOWER))))) for i, text in items]
        self.terms = sorted({t for _, terms in held for t in terms})
        number = {t: k for k, t in enumerate(self.terms)}
        self.items = [(i, np.array([number[t] for t in terms], np.int64)) for i, terms in held]
        keys = Words.of(pa.array(self.terms, pa.string())).keys()
        mix = mixed(keys)
        self.order = np.argsort(mix, kind="stable")
        self.mix, self.keys = mix[self.order], keys[:, self.order]

    def numbers(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(which words are terms, the number of the term of each); looked up by one number of 64 bits, and again by the whole key."""
        keys = words.keys()
        mix = mixed(keys)
        if not len(self.mix):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo, n = np.searchsorted(self.mix, mix), len(self.mix)
        which = np.flatnonzero(self.mix[np.minimum(lo, n - 1)] == mix)
        at = lo[which]
        same = (self.keys[:, at] == keys[:, which]).all(axis=0)
        while not same.all():  # terms that share a number of 64 bits stand side by side
            at = np.where(same, at, at + 1)
            on = (at < n) & (self.mix[np.minimum(at, n - 1)] == mix[which])
            which, at, same = which[on], at[on], same[on]
            same = (self.keys[:, at] == keys[:, which]).all(axis=0)
        return which, self.order[at]


SHARD = "ids array<long>, lengths array<long>, texts long, words long, terms array<int>, docs array<int>, tfs array<int>, held_terms array<int>, held_by array<int>"


def _shards(vocabulary, docs: int, postings: int) -> Callable:
    """Shards of at most `docs` documents, or of about `postings` occurrences of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = vocabulary.value
        ids, lengths, terms, texts, held = [], [], [], [], [0, 0]

        def out() -> pa.RecordBatch:
            n = held[0]
            keys, tfs = np.unique(np.concatenate(terms) * n + np.concatenate(texts), return_counts=True)
            own, by = np.unique(keys // n, return_counts=True)
            size = np.concatenate(lengths)
            cols = [pa.concat_arrays(ids), pa.array(size, pa.int64()), (size > 0).sum(), size.sum(), pa.array((keys // n).astype(np.int32)), pa.array((keys % n).astype(np.int32)), pa.array(tfs.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(by.astype(np.int32))]
            row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if isinstance(x, pa.Array) else pa.array([int(x)], pa.int64()) for x in cols]
            return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in SHARD.split(", ")])

        for batch in batches:
            for whole in parts(batch, 1):
                for at in range(0, whole.num_rows, docs):
                    part = whole.slice(at, docs)
                    if held[0] and held[0] + part.num_rows > docs:
                        yield out()
                        ids, lengths, terms, texts, held = [], [], [], [], [0, 0]
                    words = Words.of(part.column(1))
                    which, numbers = vocab.numbers(words)
                    ids.append(part.column(0))
                    lengths.append(words.per_text())
                    terms.append(numbers)
                    texts.append(words.text[which] + held[0])
                    held[0] += part.num_rows
                    held[1] += len(which)
                    if held[1] >= postings:
                        yield out()
                        ids, lengths, terms, texts, held = [], [], [], [], [0, 0]
        if held[0]:
            yield out()

    return run


@dataclass
class MaxTree:
    """The trees of all terms of a shard: at each level sorted keys `term * ranges + range` with the largest impact below; level 0 are documents."""

    docs: int
    terms: np.ndarray
    places: np.ndarray
    impacts: np.ndarray
    fan_out: int = 16
    opened: int = 0
    levels: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        ranges, term, place, top = max(1, self.docs), self.terms, self.places, self.impacts
        while True:
            keys = term * ranges + place
            self.levels.append((ranges, keys, top))
            if ranges == 1:
                break
            above = -(-ranges // self.fan_out)
            first = np.flatnonzero(np.concatenate(([True], np.diff(term * above + place // self.fan_out) != 0))) if len(keys) else np.empty(0, np.int64)
            top = np.maximum.reduceat(top, first) if len(first) else top
            ranges, term, place = above, term[first], place[first] // self.fan_out

    def bounds(self, level: int, first: int, n: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sums of the n ranges from `first` on; at level 0 these are scores."""
        ranges, keys, top = self.levels[level]
        n = min(n, ranges - first)
        base = terms * ranges + first
        lo = np.searchsorted(keys, base)
        size = np.searchsorted(keys, base + n) - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # sums of whole numbers below 2 ** 53 are exact in doubles
        return np.bincount(keys[at] - np.repeat(base, size), top[at] * np.repeat(weights, size), n).astype(np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, ids: list, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k highest scores above 0, equal ones by ascending id, ids that are null last."""
        top, order = len(self.levels) - 1, count()
        heap = [(-int(b), next(order), top, 0) for b in self.bounds(top, 0, 1, terms, weights) if b]
        found: list[tuple] = []  # sorted, k at most
        while heap and (len(found) < k or heap[0][0] <= found[-1][0]):
            bound, _, level, node = heapq.heappop(heap)
            self.opened += 1
            below = self.bounds(level - 1, node * self.fan_out, self.fan_out, terms, weights) if level else np.array([-bound])
            least = -found[-1][0] if len(found) == k else 1
            for i in np.flatnonzero(below >= least).tolist():
                at = (node * self.fan_out if level else node) + i
                if level > 1:
                    heapq.heappush(heap, (-int(below[i]), next(order), level - 1, at))
                else:
                    insort(found, (-int(below[i]), ids[at] is None, ids[at] or 0, at))
                    del found[k:]
        return [(-f[0], f[3]) for f in found]


def impacts(tfs: np.ndarray, lengths: np.ndarray, texts: int, words: int) -> np.ndarray:
    """How much a term counts that comes tf times in a text of so many words: whole numbers, rounded down."""
    m = 10 + 90 * lengths * texts // max(1, words)
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


def _searched(vocabulary, weights, texts: int, words: int, k: int, fan_out: int) -> Callable:
    """The k best documents of a shard for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weight = vocabulary.value, weights.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, docs, tfs = (batch.column(i)[row].values for i in range(5))
                terms, docs, tfs, lengths = (x.to_numpy().astype(np.int64) for x in (terms, docs, tfs, lengths))
                tree = MaxTree(len(lengths), terms, docs, impacts(tfs, lengths[docs], texts, words), fan_out)
                names, found = ids.to_pylist(), []
                for item, (_, own) in enumerate(vocab.items):
                    found += [(item, at, score) for score, at in tree.best(own, weight[own], names, k)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), ids.take(pa.array([f[1] for f in found], pa.int64())), pa.array([f[2] for f in found], pa.int64())], names=["item", "doc_id", "score"])

    return run


def index_shards(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 1 << 15, shard_postings: int = 4_000_000) -> DataFrame:
    """A written table of shards of all rows of docs: ids, lengths in words, and where each term of the vocabulary comes how often."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(_shards(spark.sparkContext.broadcast(vocabulary), shard_docs, shard_postings), SHARD), "shards")


def search_shards(shards: DataFrame, vocabulary: Vocabulary, k: int = 10, fan_out: int = 16) -> DataFrame:
    """(item, rank, doc_id, score) of the k best documents of all shards for each item of the vocabulary, by its number.

    Every shard gives its own k best, of which a window keeps the k best of all.
    """
    spark = shards.sparkSession
    whole = shards.agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    held = shards.select(F.explode(F.arrays_zip("held_terms", "held_by")).alias("t")).groupBy("t.held_terms").agg(F.sum("t.held_by").alias("df")).collect()
    weights = np.zeros(len(vocabulary.terms), np.int64)
    for term, df in held:
        weights[term] = math.floor(1000 * math.log((2 * whole["texts"] + 2) / (2 * df + 1)))
    share = spark.sparkContext.broadcast
    found = shards.select("ids", "lengths", "terms", "docs", "tfs").mapInArrow(_searched(share(vocabulary), share(weights), whole["texts"], whole["words"], k, fan_out), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000, **settings) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of items its k highest-scoring rows of docs with a score above 0.

    Equal scores stand by ascending id, a null id last. A null or empty text, on either
    side, has no term: such an item has no row and such a document is in none, nor in the
    counts. Rows that repeat stand each on their own; items that repeat an id have ranks
    each of their own. Empty tables give an empty result; other columns are not read. Items
    are held in blocks of about `block_chars` characters by driver and tasks; each block
    reads the documents once, and its result is written before the next.
    """
    spark, out = docs.sparkSession, None
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        vocabulary = Vocabulary([tuple(r) for r in own])
        found = search_shards(index_shards(docs, vocabulary, id_col, text_col), vocabulary, k, **settings)
        names = F.broadcast(spark.createDataFrame([(n, i) for n, (i, _) in enumerate(vocabulary.items)], "item long, item_id long"))
        found = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = materialise(found, "ranks") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each item of the benchmark."""
    return rank_documents(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), whole AS (
  SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS l FROM d
), q AS (
  SELECT DISTINCT item, item_id, unnest(words) AS term FROM (
    SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark)
), tf AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(size) AS size, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS size, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (
  SELECT item, item_id, r, any_value(doc_id) AS doc_id,
    sum(floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), whole GROUP BY item, item_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
