"""A stored keyword index: blocks of rows, and beside each block its trigrams with a bound of what they can score.

A literal of three characters or more can only be in rows that hold all of its trigrams,
and no more often than the rarest of them. So the least of its trigrams' bounds in a block
bounds the score of every row there. A search looks up the trigrams of all its literals in
the blocks' lists, reads the rows of the blocks of the highest bounds, and then only of
those whose bound reaches the score of the last row kept. A block that several literals
want is read once for all of them. The answer is exact; what no literal wants is not read.
No pair of a literal and a block is ever a row: a task bounds them as arrays and passes on
its best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.repeats import codes_of
from ..functions.text import title_of
from ..registry import query
from ..sources.shared import materialise, prepare
from ..sources.tables import table
from .retrieval import _LITERALS, B, K1, asked_once, for_all, literals_of
from .retrieval import _blocks as parts_of

#: The weights of the fields.
FIELDS = {"title": 8.0, "creators": 4.0, "abstract": 2.0, "chunk_text": 1.0}
_STRINGS = ", ".join(f"{f}: string" for f in FIELDS)
BLOCKS = f"block long, rows array<struct<key: long, {_STRINGS}, dl: double>>, grams array<long>, bounds array<float>"
_ROW = pa.struct([("key", pa.int64()), *((f, pa.string()) for f in FIELDS), ("dl", pa.float64())])
#: A block is full with so many characters, whatever its rows; a longer row is still one row.
CHARS = 1 << 20
#: A reader has so many blocks in memory at once.
GROUP = 16
#: The automaton holds so much of a literal; the rest is compared where that is found.
PREFIX = 32


def saturation(f, share):
    """What a row scores whose weighted hits are f and whose length is `share` of the mean; grows with f."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * share))


def grams_of(text: str) -> np.ndarray:
    """Each three characters in a row, as one number."""
    codes = codes_of(text).astype(np.int64)
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:] if len(codes) > 2 else np.empty(0, np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def bounds_of(fields: list[list[str]], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a block in order, and the most that a row of it scores which holds one as often as it does, rounded up.

    `fields` are the texts of each field. All trigrams of the block are sorted once, as
    numbers over the signs that the block has, with the row and field at their end.
    """
    texts = [t for row in zip(*fields, strict=True) for t in row]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = np.maximum(lengths - 2, 0)
    if not n.sum():
        return np.empty(0, np.int64), np.empty(0, np.float32)
    codes = codes_of("".join(texts))
    signs = np.flatnonzero(np.bincount(codes))
    place = np.zeros(int(signs[-1]) + 1, np.uint64)
    place[signs] = np.arange(len(signs))
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(of)) + (np.cumsum(lengths) - lengths - np.cumsum(n) + n)[of]
    a, m, r = len(signs), len(texts), place[codes]
    grams, every = (r[at] * np.uint64(a) + r[at + 1]) * np.uint64(a) + r[at + 2], None
    if a**3 * m >= 1 << 63:
        every, grams = np.unique(grams, return_inverse=True)
        grams = grams.astype(np.uint64)
    kind = np.uint32 if every is None and a**3 * m < 1 << 32 else np.uint64
    keys = np.sort(grams.astype(kind) * kind(m) + of.astype(kind))
    first = _firsts(keys)
    times, keys = np.diff(np.append(first, len(keys))), keys[first]
    of = (keys % kind(m)).astype(np.int64)
    hits = times * np.array(list(FIELDS.values()))[of % len(FIELDS)]
    first = _firsts(keys // kind(len(FIELDS)))
    scores = saturation(np.add.reduceat(hits, first), share[of[first] // len(FIELDS)])
    grams = (keys[first] // kind(m)).astype(np.int64)
    first = _firsts(grams)
    top, grams = np.maximum.reduceat(scores, first), grams[first]
    if every is not None:
        grams = every[grams].astype(np.int64)
    up = top.astype(np.float32)
    return signs[grams // a // a] << 42 | signs[grams // a % a] << 21 | signs[grams % a], np.where(up < top, np.nextafter(up, np.float32(np.inf)), up)


def _blocks(size: int, mean: float) -> Callable:
    """Rows in blocks of `size`, in the order in which a task reads them, with the trigrams of each block and their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n = chars = 0

        def out() -> pa.RecordBatch:
            nonlocal number, n, chars
            cols = [pa.concat_arrays([b.column(c) for b in held]) for c in _ROW.names]
            grams, bounds = bounds_of([c.to_pylist() for c in cols[1:-1]], cols[-1].to_numpy() / mean)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            block = pa.RecordBatch.from_arrays([pa.array([number]), one(pa.StructArray.from_arrays(cols, fields=list(_ROW))), one(pa.array(grams)), one(pa.array(bounds))], names=["block", "rows", "grams", "bounds"])
            number, n, chars = number + 1, 0, 0
            held.clear()
            return block

        for batch in batches:
            at = 0
            for i, dl in enumerate(batch.column("dl").to_pylist(), 1):
                n, chars = n + 1, chars + dl
                if n == size or chars >= CHARS:
                    held.append(batch.slice(at, i - at))
                    yield out()
                    at = i
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield out()

    return run


@dataclass
class KeywordIndex:
    """A written table of blocks (block, rows, grams, bounds); grams are in order, a scan of grams and bounds reads no rows."""

    blocks: DataFrame
    rows: int
    mean: float


def build(rows: DataFrame, size: int = 64) -> KeywordIndex:
    """An index of rows (key, title, creators, abstract, chunk_text), case folded; a null field is an empty one.

    One pass for the mean length, one for the blocks; nothing is shuffled.
    """
    prepare(rows.sparkSession)
    folded = rows.select(F.col("key").cast("bigint").alias("key"), *(F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS))
    dl = sum((F.greatest(F.length(f) - 2, F.lit(0)) for f in FIELDS), F.lit(0)).cast("double")
    folded = folded.withColumn("dl", dl)
    whole = folded.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    mean = whole["mean"] or 1.0
    return KeywordIndex(materialise(folded.mapInArrow(_blocks(size, mean), BLOCKS), "blocks", GROUP), whole["n"], mean)


class _Asked:
    """Literals of three characters or more, as tasks look for them."""

    def __init__(self, literals: list[str]):
        grams = [np.unique(grams_of(t)) for t in literals]
        self.literals = literals
        self.grams, self.flat = np.unique(np.concatenate(grams), return_inverse=True)
        self.starts = np.cumsum([0, *map(len, grams[:-1])])

    def bounds(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What a row of a block can score for each literal; 0 where the block lacks one of its trigrams."""
        if not len(grams):
            return np.zeros(len(self.literals), np.float32)
        at = np.minimum(np.searchsorted(grams, self.grams), len(grams) - 1)
        return np.minimum.reduceat(np.where(grams[at] == self.grams, bounds[at], np.float32(0))[self.flat], self.starts)

    def machine(self):
        """An automaton of the beginnings of all literals: their length, and (literal, length, the literal if it goes on)."""
        import ahocorasick

        same: dict[str, list[tuple]] = {}
        for i, t in enumerate(self.literals):
            same.setdefault(t[:PREFIX], []).append((i, len(t), t if len(t) > PREFIX else None))
        out = ahocorasick.Automaton()
        for t, those in same.items():
            out.add_word(t, (len(t), those))
        out.make_automaton()
        return out


def _each(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The block's number and its values of list columns, block by block."""
    lists = [batch.column(c) for c in names]
    offsets = [x.offsets.to_numpy() for x in lists]
    for j, block in enumerate(batch.column("block").to_pylist()):
        yield block, *(x.values.slice(o[j], o[j + 1] - o[j]) for x, o in zip(lists, offsets, strict=True))


def _first(asked: _Asked, first: int) -> Callable:
    """Of the blocks of a task the `first` of the highest bounds for each literal: (literal, block, bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(asked.literals)
        top, where, every = np.zeros((first, n), np.float32), np.zeros((first, n), np.int64), np.arange(n)
        for batch in batches:
            for block, grams, bounds in _each(batch, "grams", "bounds"):
                got, least = asked.bounds(grams.to_numpy(), bounds.to_numpy()), top.argmin(axis=0)
                better = np.flatnonzero(got > top[least, every])
                top[least[better], better], where[least[better], better] = got[better], block
        slot, literal = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(literal), pa.array(where[slot, literal]), pa.array(top[slot, literal])], names=["literal", "block", "bound"])

    return run


def _rest(asked: _Asked, least: np.ndarray, had: dict[int, list[int]], block: int, got: np.ndarray) -> np.ndarray:
    """Which literals want a block in the second wave, where `got` bounds them: those whose last row kept it can reach, and that did not have it."""
    want = (got > 0) & (got >= least)
    want[had.get(block, [])] = False
    return want


def _counts(asked: _Asked, least: np.ndarray, had: dict[int, list[int]]) -> Callable:
    """(block, candidates, wanted): how many literals can be in a block, and how many want it in the second wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, grams, bounds in _each(batch, "grams", "bounds"):
                got = asked.bounds(grams.to_numpy(), bounds.to_numpy())
                out.append((block, int((got > 0).sum()), int(_rest(asked, least, had, block, got).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["block", "candidates", "wanted"])

    return run


def _read(asked: _Asked, ids: list[int], mean: float, k: int, had: dict[int, list[int]], least: np.ndarray | None = None) -> Callable:
    """(query_id, key, weight) of the rows of each block for the literals that want it, those of `had` or with `least` those of the second wave; a task keeps its k best of each literal.

    One pass over a text finds all literals; hits of a literal in a field do not overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, machine = len(ids), asked.machine()
        low = np.zeros(n) if least is None else least.copy()
        floor = low.tolist()
        held = [np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int64)]
        found: list[tuple[int, float, bool, int]] = []

        def trim() -> None:
            nonlocal held, floor
            new = zip(*found, strict=True) if found else [[]] * 4
            held = [np.concatenate([h, np.array(c, h.dtype)]) for h, c in zip(held, new, strict=True)]
            found.clear()
            literal, weight, named, key = held
            order = np.lexsort((key, named, -np.round(weight, 9), literal))
            rank = np.arange(len(order)) - np.searchsorted(literal[order], literal[order])
            last = order[rank == k - 1]
            low[literal[last]] = np.maximum(low[literal[last]], weight[last] - 1e-9)
            held, floor = [h[order[rank < k]] for h in held], low.tolist()

        for batch in batches:
            for block, rows, *summary in _each(batch, "rows", *(("grams", "bounds") if least is not None else ())):
                if least is None:
                    wants = np.zeros(n, bool)
                    wants[had.get(block, [])] = True
                else:
                    wants = _rest(asked, least, had, block, asked.bounds(*(s.to_numpy() for s in summary)))
                if not wants.any():
                    continue
                want = wants.tobytes()
                keys, *fields, lengths = (c.to_pylist() for c in rows.flatten())
                for key, dl, *texts in zip(keys, lengths, *fields, strict=True):
                    hits: dict[int, float] = {}
                    for text, weight in zip(texts, FIELDS.values(), strict=True):
                        if len(text) < 3:
                            continue
                        ends: dict[int, int] = {}
                        for at, (size, those) in machine.iter(text):
                            at += 1 - size
                            for i, length, whole in those:
                                if want[i] and at >= ends.get(i, 0) and (whole is None or text.startswith(whole, at)):
                                    ends[i] = at + length
                                    hits[i] = hits.get(i, 0.0) + weight
                    share = dl / mean
                    for i, f in hits.items():
                        if (score := saturation(f, share)) >= floor[i]:
                            found.append((i, score, key is not None, key or 0))
                if len(found) > 100_000:
                    trim()
        trim()
        literal, weight, named, key = held
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[literal]), pa.array(key, mask=~named), pa.array(weight)], names=["query_id", "key", "weight"])

    return run


_SCORED = "query_id bigint, key bigint, weight double"


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 9)), "key")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _searched(index: KeywordIndex, part: list, k: int, first: int, seen: list | None, listed: int = 2_000) -> DataFrame:
    """The waves of some literals: (query_id, key, weight), the k best of each among them."""
    ids, asked = [r[0] for r in part], _Asked([r[1] for r in part])
    some = lambda blocks: index.blocks.where(F.col("block").isin(blocks)) if len(blocks) <= listed else index.blocks
    lists = index.blocks.select("block", "grams", "bounds")
    tops = lists.mapInArrow(_first(asked, first), "literal bigint, block bigint, bound float")
    order = Window.partitionBy("literal").orderBy(F.desc("bound"), "block")
    had: dict[int, list[int]] = {}
    for literal, block in tops.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).select("literal", "block").collect():
        had.setdefault(block, []).append(literal)
    one = materialise(_best(some(list(had)).select("block", "rows").mapInArrow(_read(asked, ids, index.mean, k, had), _SCORED), k), "wave")
    number, least = {q: i for i, q in enumerate(ids)}, np.zeros(len(ids))
    for q, weight in one.where(F.col("rank") == k).select("query_id", "weight").collect():
        least[number[q]] = weight - 1e-9
    rest = materialise(lists.mapInArrow(_counts(asked, least, had), "block bigint, candidates bigint, wanted bigint"), "rest")
    if seen is not None:
        both = rest.agg(F.sum("candidates"), F.sum("wanted")).first()
        seen += [both[0] or 0, sum(map(len, had.values())) + (both[1] or 0)]
    blocks = [r[0] for r in rest.where("wanted > 0").select("block").limit(listed + 1).collect()]
    return one.drop("rank").unionByName(some(blocks).mapInArrow(_read(asked, ids, index.mean, k, had, least), _SCORED))


def search(index: KeywordIndex, queries: DataFrame, k: int, first: int = 4, seen: list | None = None, block: int = 65_536) -> DataFrame:
    """(query_id, key, weight, rank) of the k best rows for each literal: by weight, ties by key.

    `weight` is BM25 without the factor of the literal itself, which changes no order. Two
    waves read rows: for each literal its `first` blocks of the highest bounds, then all
    others whose bound reaches the k-th weight of these. Different literals go to tasks in
    blocks of about `block`, or fewer if they are long. `seen` gets how many pairs of a
    literal and a block were candidates and how many were read, for each such block.
    """
    each, members = asked_once(queries.select("query_id", F.lower("literal").alias("literal")), "literal")
    asked = each.select(F.col("query_id").cast("bigint").alias("query_id"), "literal").where(F.length("literal") > 2)
    whole = asked.agg(F.count("*").alias("n"), F.sum(F.length("literal")).alias("chars")).first()
    out = index.blocks.sparkSession.createDataFrame([], _SCORED)
    for part in parts_of(asked, "query_id", max(1, min(block, 4 * CHARS * whole["n"] // (whole["chars"] or 1)))):
        out = out.unionByName(_searched(index, part, k, first, seen))
    return for_all(_best(out, k), members)


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an index holds them: a row of the item, and one of its text."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    empty: Column = F.lit("")
    lines = F.split("text", "\n")
    item = F.struct((F.col("doc_id") * 2).alias("key"), title_of(F.col("text")).alias("title"), F.concat_ws(" ", "source", "lang").alias("creators"), F.element_at(lines, -1).alias("abstract"), empty.alias("chunk_text"))
    chunk = F.struct((F.col("doc_id") * 2 + 1).alias("key"), empty.alias("title"), empty.alias("creators"), empty.alias("abstract"), F.col("text").alias("chunk_text"))
    return d.select(F.explode(F.array(item, chunk)).alias("r")).select("r.*")


_ROWS = """ix AS (SELECT doc_id * 2 AS key, lower(split_part(text, chr(10), 1)) AS title, lower(source || ' ' || lang) AS creators, lower(split_part(text, chr(10), -1)) AS abstract, '' AS chunk_text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id * 2 + 1, '', '', '', lower(text) FROM documents WHERE text IS NOT NULL)"""
_HITS = " + ".join(f"{w}::DOUBLE * ((length({f}) - length(replace({f}, literal, ''))) // length(literal))" for f, w in FIELDS.items())
_DL = " + ".join(f"greatest(length({f}) - 2, 0)" for f in FIELDS)


@query(
    "keyword_index_topk",
    f"""WITH {_ROWS}, {_LITERALS}, sized AS (SELECT *, ({_DL})::DOUBLE AS dl FROM ix), whole AS (SELECT avg(dl) AS mean FROM sized),
    f AS (SELECT query_id, key, dl, {_HITS} AS f FROM literals, sized WHERE contains(title, literal) OR contains(creators, literal) OR contains(abstract, literal) OR contains(chunk_text, literal)),
    s AS (SELECT query_id, key, f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS weight FROM f, whole)
    SELECT query_id, key, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, key) AS rank FROM s) WHERE rank <= 10""",
)
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of a stored index for each literal, over title, creators, abstract and text of chunks."""
    found = search(build(rows_of(spark, sf_dir)), literals_of(spark, sf_dir), 10)
    return found.select("query_id", "key", F.round("weight", 6).alias("weight"), "rank")
