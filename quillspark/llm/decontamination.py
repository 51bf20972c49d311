"""Benchmark decontamination: edit distance through CGK walks, bit-sampling LSH and exact checks.

Texts and items are sequences of lower-case words. An item of n words is in a text if
some run of its words is within k = floor((1 - similarity) * n) insertions, deletions and
replacements of words of it. At each word of a text starts a window the size of the item.
A CGK random walk reads a window word by word and, by a random bit for the step and the
word, stays or moves on; the outputs of two windows differ in few places if few edits
part them. Half of the steps move on, so of the outputs only the first 1.5n, which lie
before the padding, are sampled, and padding never makes a key. Keys of a few sampled
outputs, repeated until simulated pairs at the limit meet with the target recall, pair
windows with items of their size, and the edit distance of each pair is then computed.
Windows that no item can be near to are left out first, which
loses nothing: k edits spoil at most 2k of the n - 1 neighbouring pairs of words, so the
n + k words from a start on must hold all but 2k of the different pairs of one item.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

UNKNOWN, PAD, BEYOND = -1, -2, -3
_MARKS = bytes(range(33)) + bytes(c for c in range(33, 128) if not chr(c).isalnum())
MARKS = bytes.maketrans(_MARKS, b" " * len(_MARKS))
#: Quotation marks, dashes and dots beyond ASCII, which part words too.
WIDE_MARKS = re.compile("[«»“”„‘’‚‹›–—―…·¡¿    　。、，！？；：（）「」]")


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8: what lies between blanks and punctuation."""
    text = text.lower()
    if not text.isascii():
        text = WIDE_MARKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(MARKS).split()


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def walk_bits(codes: int, steps: int, seed: int) -> np.ndarray:
    """Random bits for each code, the unknown word and the padding (the last rows, so that their negative codes find them): 64 steps in a word."""
    rows, cols = np.arange(codes + 2, dtype=np.uint64), np.arange(-(-steps // 64), dtype=np.uint64)
    return _mix((rows[:, None] << np.uint64(24)) + (cols << np.uint64(8)) + np.uint64(seed))


def steps_of(n: int) -> int:
    """Steps of a walk over n words that mostly end before the padding."""
    return max(1, 3 * n // 2)


def cgk(windows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Outputs of the walks over rows of word codes, a column for each window."""
    n, wide = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), PAD, windows.dtype)], axis=1).ravel()
    base = np.arange(n, dtype=np.int64) * (wide + 1)
    at, end = base.copy(), base + wide
    out = np.empty((steps_of(wide), n), np.int32)
    for t in range(len(out)):
        code = padded[np.minimum(at, end)]
        out[t] = code
        at += (bits[code, t >> 6] >> np.uint64(t & 63) & np.uint64(1)).astype(np.int64)
    return out


def edit_distances(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item (a row) to a start of the window beside it, and the shortest such start."""
    n, wide = windows.shape
    steps = np.arange(wide + 1)
    row = np.broadcast_to(steps, (n, wide + 1)).copy()
    for i in range(items.shape[1]):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != items[:, i : i + 1]))
        row = np.concatenate([row[:, :1] + 1, best], axis=1)
        row = np.minimum.accumulate(row - steps, axis=1) + steps
    row[:, 1:][windows == BEYOND] = np.iinfo(np.int32).max
    return row.min(axis=1), row.argmin(axis=1)


@lru_cache(maxsize=1024)
def repeats_of(n: int, edits: int, sampled: int, walks: int, recall: float, pairs: int = 1000, vocabulary: int = 3000) -> int:
    """Keys that make simulated pairs of n words, `edits` random edits apart, meet with the target recall.

    Repeats share walks, so they are not independent: the number is measured, not computed.
    """
    rng = np.random.default_rng(n)
    a = rng.integers(0, vocabulary, (pairs, n)).astype(np.int32)
    b = []
    for row in a.tolist():
        # at places apart, so that no edit undoes another
        for at, kind, new in zip(sorted(rng.choice(n, edits, replace=False).tolist(), reverse=True), rng.integers(0, 3, edits).tolist(), rng.integers(0, vocabulary, edits).tolist(), strict=True):
            row[at : at + (kind != 0)] = [new] * (kind != 1)
        b.append((row + rng.integers(0, vocabulary, n).tolist())[:n])
    agree = []
    for seed in range(walks):
        bits = walk_bits(vocabulary, steps_of(n), seed)
        x, y = cgk(a, bits), cgk(np.array(b, np.int32), bits)
        agree.append((x == y) & (x != PAD))
    met, most = np.zeros(pairs, bool), 1 << 12
    for r in range(most):
        met |= agree[r % walks][rng.integers(0, steps_of(n), sampled)].all(axis=0)
        if r >= 2 * walks - 1 and met.mean() >= recall:
            return r + 1
    raise ValueError(f"{most} keys of {sampled} outputs do not reach a recall of {recall} for items of {n} words and {edits} edits")


@dataclass
class ItemIndex:
    """Items of one block of the benchmark, by their number of words, with their keys."""

    items: list[tuple[int, str]]
    similarity: float = 0.8
    min_words: int = 1
    sampled: int = 2
    recall: float = 0.995
    walks: int = 8
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        coded = [(i, w) for i, t in self.items if len(w := words_of(t or "")) >= self.min_words]
        codes = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int32) for _, w in coded]
        by_size: dict[int, list[int]] = {}
        for k, c in enumerate(codes):
            by_size.setdefault(len(c), []).append(k)
        self.sizes = sorted(by_size)
        self.edits = {n: int((1 - self.similarity) * n + 1e-9) for n in self.sizes}
        self.ids = {n: np.array([coded[k][0] for k in by_size[n]], np.int64) for n in self.sizes}
        self.codes = {n: np.stack([codes[k] for k in by_size[n]]) for n in self.sizes}
        rng = np.random.default_rng(5)
        self.repeats = {n: repeats_of(m := self._rung(n), int((1 - self.similarity) * m + 1e-9), self.sampled, self.walks, self.recall) for n in self.sizes}
        self.places = {n: rng.integers(0, steps_of(n), (self.repeats[n], self.sampled)) for n in self.sizes}
        own = np.concatenate([np.full(len(c) - 1, k) for k, c in enumerate(codes)] or [np.empty(0, np.int64)])
        pairs = np.unique(np.stack([np.concatenate([self._pairs(c) for c in codes] or [own]), own], axis=1), axis=0)
        #: The pairs of neighbouring words, sorted, with the item that each is in, and a table that shows whether a pair can be there.
        self.pairs, self.pair_items = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.near = np.zeros(1 << 22, bool)
        self.near[self.pairs & 0x3FFFFF] = True
        self.item_size = np.array([len(c) for c in codes], np.int64)
        #: Different pairs of an item that k edits leave.
        self.needed = np.array([len(np.unique(self._pairs(c))) - 2 * self.edits[len(c)] for c in codes], np.int64)
        self.bits = [walk_bits(len(self.vocabulary), steps_of(max(self.sizes, default=0)), seed) for seed in range(self.walks)]
        self.tables = {}
        for n in self.sizes:
            embedded = self._embedded(self.codes[n])
            for r in range(self.repeats[n]):
                keys, valid = self._keys(embedded, n, r)
                order = np.flatnonzero(valid)[np.argsort(keys[valid], kind="stable")].astype(np.int32)
                self.tables[n, r] = keys[order], order

    @staticmethod
    def _rung(n: int) -> int:
        """The size that n is simulated as: n itself up to 20, then the next on a ladder."""
        m = 20
        while m < n:
            m = m * 5 // 4
        return n if n <= 20 else m

    @staticmethod
    def _pairs(codes: np.ndarray) -> np.ndarray:
        """A number for each two neighbouring words; -1 if one is unknown."""
        a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        return np.where((a < 0) | (b < 0), -1, (_mix((a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64)) >> np.uint64(2)).astype(np.int64))

    def _embedded(self, windows: np.ndarray) -> list[np.ndarray]:
        return [cgk(windows, bits) for bits in self.bits]

    def _keys(self, embedded: list[np.ndarray], n: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a repeat, and which of them hold no padding."""
        outputs = embedded[r % self.walks]
        key, valid = np.full(outputs.shape[1], r, np.uint64), np.ones(outputs.shape[1], bool)
        for place in self.places[n][r]:
            key = _mix(key ^ outputs[place].astype(np.int64).view(np.uint64))
            valid &= outputs[place] >= 0
        return key, valid

    def starts(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(size, start) of the windows with enough pairs of one item in reach."""
        m, out = len(codes), set()
        if not self.sizes or m < self.sizes[0] - self.edits[self.sizes[0]]:
            return out
        pair = self._pairs(codes)
        at = np.flatnonzero((pair >= 0) & self.near[pair & 0x3FFFFF])
        if len(at) >= self.needed.min():
            lo, hi = np.searchsorted(self.pairs, pair[at], "left"), np.searchsorted(self.pairs, pair[at], "right")
            n = hi - lo
            item = self.pair_items[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            at = np.repeat(at, n)
            order = np.lexsort((at, item))
            item, at = item[order], at[order]
            for k in np.unique(item[np.bincount(item, minlength=len(self.needed))[item] >= self.needed[item]]).tolist():
                size, need = int(self.item_size[k]), int(max(1, self.needed[k]))
                mine, reach = at[slice(*np.searchsorted(item, [k, k + 1]))], size + self.edits[size] - 2
                begin, last = mine[: len(mine) - need + 1], mine[need - 1 :]
                dense = last - begin <= reach
                spots = {s for f, t in zip(begin[dense].tolist(), last[dense].tolist(), strict=True) for s in range(max(0, t - reach), f + 1)}
                out.update((size, s) for s in self._varied(pair[mine], mine, np.array(sorted(spots), np.int64), reach, need))
        for n in {int(self.item_size[k]) for k in np.flatnonzero(self.needed <= 0)}:
            spots = range(max(0, m - (n - self.edits[n]) + 1)) if n > 1 else np.flatnonzero(np.isin(codes, self.codes[1])).tolist()
            out.update((n, s) for s in spots)
        return out

    @staticmethod
    def _varied(pair: np.ndarray, at: np.ndarray, starts: np.ndarray, reach: int, need: int) -> list[int]:
        """The starts with `need` different pairs within reach; pairs at places in order."""
        order = np.argsort(pair, kind="stable")
        before = np.full(len(at), -1)
        same = pair[order[1:]] == pair[order[:-1]]
        before[order[1:][same]] = at[order[:-1][same]]
        out: list[int] = []
        for s in np.array_split(starts, -(-len(starts) // 4096)) if len(starts) else []:
            lo, hi = np.searchsorted(at, s[0]), np.searchsorted(at, s[-1] + reach, "right")
            p, b = at[lo:hi], before[lo:hi]
            held = ((p >= s[:, None]) & (p <= s[:, None] + reach) & (b < s[:, None])).sum(axis=1) if hi - lo < 4096 else np.array([((w := slice(*np.searchsorted(at, [x, x + reach + 1]))), (before[w] < x).sum())[1] for x in s])
            out += s[held >= need].tolist()
        return out

    def search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item_id, distance, first word, words) of the nearest place of each item near a text; texts in codes."""
        spots = [(t, n, s) for t, codes in enumerate(texts) for n, s in sorted(self.starts(codes))]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for block in range(0, len(spots), 8192):
            text, size, start = (np.array(x) for x in zip(*spots[block : block + 8192], strict=True))
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                windows = np.full((len(rows), n), PAD, np.int32)
                for i, w in enumerate(rows):
                    part = texts[text[w]][start[w] : start[w] + n]
                    windows[i, : len(part)] = part
                mine, pairs = self._embedded(windows), []
                for r in range(self.repeats[n]):
                    keys, order = self.tables[n, r]
                    key, valid = self._keys(mine, n, r)
                    lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    hi = np.where(valid, hi, lo)
                    who = np.repeat(rows, hi - lo)
                    what = order[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(who))] if len(who) else order[:0]
                    pairs.append(np.stack([who, what], axis=1))
                pairs = np.unique(np.concatenate(pairs), axis=0)
                reach = n + self.edits[n]
                for at in range(0, len(pairs), 4096):
                    who, what = pairs[at : at + 4096].T
                    runs = np.full((len(who), reach), BEYOND, np.int32)
                    for i, w in enumerate(who):
                        part = texts[text[w]][start[w] : start[w] + reach]
                        runs[i, : len(part)] = part
                    far, words = edit_distances(runs, self.codes[n][what])
                    for i in np.flatnonzero(far <= self.edits[n]).tolist():
                        key = int(text[who[i]]), int(self.ids[n][what[i]])
                        found = int(far[i]), int(start[who[i]]), int(words[i])
                        best[key] = min(best.get(key, found), found)
        for (t, item), found in best.items():
            yield (t, item, *found)

    def coded(self, text: str | None) -> np.ndarray:
        words = words_of(text or "")
        return np.fromiter(map(self.vocabulary.get, words, repeat(UNKNOWN)), np.int32, len(words))


def _groups(column: pa.Array, index: ItemIndex, chars: int = 4_000_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of the texts of a batch in codes, with the place of the first; about `chars` characters each."""
    first, held, size = 0, [], 0
    for k, text in enumerate(column):
        held.append(index.coded(text := text.as_py()))
        size += len(text or "")
        if size > chars:
            yield first, held
            first, held, size = k + 1, [], 0
    yield first, held


def _found(index: ItemIndex) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column(1), index):
                rows = list(index.search(texts))
                ids = batch.column(0).take(pa.array([first + r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3, 4))], names=["doc_id", "item_id", "distance", "start", "words"])

    return run


def _clean(index: ItemIndex, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = {first + r[0] for first, texts in _groups(batch.column(text_at), index) for r in index.search(texts)}
            yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

    return run


def indexes(benchmark: DataFrame, block_chars: int = 4_000_000, **settings) -> Iterator[tuple[ItemIndex, bool]]:
    """The benchmark (item_id, text) in blocks of about `block_chars` characters, and whether it is one of several."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    for k in range(blocks):
        yield ItemIndex([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()], **settings), blocks > 1


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, item_id, distance, start, words), a row for each benchmark item that a document holds.

    The place is the nearest to the item, of these the first: `words` words from the word
    `start` on. Items of under five words allow no edit, so they are found as they stand,
    a single word too; `min_words` leaves the shortest out if that is not wanted. Null and
    empty texts hold nothing; rows that repeat give repeated results. Other columns are not
    read. Of a benchmark in several blocks, what one block finds is written before the next
    is read, so driver and tasks hold one block at a time.
    """
    prepare(docs.sparkSession)
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    for index, several in indexes(benchmark, **settings):
        found = rows.mapInArrow(_found(index), "doc_id long, item_id long, distance long, start long, words long")
        found = materialise(found, "leaks") if several else found
        out = found if out is None else out.union(found)
    return out


def _leaky(index: ItemIndex) -> Callable:
    """The sha256 of each text that holds an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sorted({first + r[0] for first, texts in _groups(batch.column(0), index) for r in index.search(texts)})
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(batch.column(0)[k].as_py().encode()).hexdigest() for k in at], pa.string())], names=["_leak"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no item of the benchmark.

    A benchmark of one block filters the rows as they are read. Of one of several, each block
    reads the texts and writes the hashes of those that hold an item; one join then drops
    their rows, so the documents are written by nobody and shuffled once.
    """
    prepare(docs.sparkSession)
    blocks = indexes(benchmark, **settings)
    index, several = next(blocks)
    if not several:
        return docs.mapInArrow(_clean(index, docs.columns.index(text_col)), docs.schema)
    texts, leaks = docs.select(F.col(f"`{text_col}`").alias("text")), None
    for index, _ in chain([(index, several)], blocks):
        found = materialise(texts.mapInArrow(_leaky(index), "_leak string").distinct(), "leaks")
        leaks = found if leaks is None else leaks.union(found)
    return docs.join(leaks.distinct(), F.sha2(F.col(f"`{text_col}`").cast("binary"), 256) == F.col("_leak"), "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return contaminated_passages(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
