"""Suffix-array dedup: bytes that a repeated window of a fixed length covers go, by a radix sort that ends at that depth.

Only suffixes that start at anchors are ordered, one in some 150 bytes. The anchor of a
window is the place of its least hashed gram, the first of equal ones, so equal windows
have equal anchors at equal offsets, and all windows that could be equal lie in the bucket
of one gram. A stretch is the run of windows of one text that share an anchor.

1. Stretches are counted by bucket and by a digest of their bytes. Buckets of one stretch
   hold nothing that repeats; stretches that come twice repeat as a whole.
2. What is left are buckets of several different stretches. One of each kind is cut out of
   its text. Their suffixes from the anchor on, and from the anchor back, are ordered by
   passes over digits of eight bytes, most significant first, through the length of a
   window and no further; a suffix that is alone in its group takes no part in the next
   pass. Two windows at offset d are equal just if they are in one group at depth d
   backwards and in one at depth length - d forwards.
3. A bucket of very many different stretches (the edges of a passage that many texts share)
   is too large for one task. Its windows are dealt by the bytes that all windows of a block
   of offsets share, then window by window, both counted before and after the shuffle.

Places are carried as those of a text, known by its digest, so that texts that are copies
of each other are one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, shuffle_partitions
from .words import bytes_of, parts

#: The low bits of a value in the sliding minimum hold the place; what is looked at together is shorter.
PLACE = np.uint64((1 << 24) - 1)
TOGETHER = 1 << 21


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15) + b
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


#: A number of 64 bits for each byte.
OF_BYTE = _mixed(np.arange(256, dtype=np.uint64), np.uint64(0x94D049BB133111EB))


def _doubled(values: np.ndarray, size: int, both: Callable) -> np.ndarray:
    """`both` over each `size` values in a row, from runs of one, two, four and so on."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = both(values[:-step], values[step:])
        have += step
    return values


def stretches_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, anchor, starts, hash of the gram) of each run of windows with one anchor; starts are places in data."""
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    if not count.sum():
        return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.uint64))
    hashes = _doubled(OF_BYTE[data], gram, _mixed)
    least = _doubled(hashes & ~PLACE | np.arange(len(hashes), dtype=np.uint64), length - gram + 1, np.minimum)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(text)) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    anchor = (least[start] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    return text[first], start[first], anchor[first], np.diff(np.append(first, len(start))), hashes[anchor[first]]


def _digests(data: np.ndarray, begins: list[int], ends: list[int]) -> np.ndarray:
    """Two numbers of 64 bits for each stretch of bytes, of a cryptographic hash."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join(hashlib.blake2b(view[b:e], digest_size=16).digest() for b, e in zip(begins, ends, strict=True)), np.int64).reshape(-1, 2)


STRETCH = "doc_id long, key binary, bucket long, s1 long, s2 long, first int, reach int, starts int"


def _anchored(length: int, gram: int) -> Callable:
    def segments(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """A very long text in segments that overlap by a window less one byte, others together: (bytes, offsets, where the first starts)."""
        data, offsets = bytes_of(part.column(2))
        if part.num_rows > 1 or len(data) <= 2 * TOGETHER:
            yield data, offsets, 0
            return
        for at in range(0, len(data), TOGETHER):
            own = data[at : at + TOGETHER + length - 1]
            yield own, np.array([0, len(own)]), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2, TOGETHER):
                for data, offsets, base in segments(part):
                    text, start, anchor, starts, bucket = stretches_of(data, offsets, length, gram)
                    digests = _digests(data, start.tolist(), (start + starts - 1 + length).tolist())
                    rows = pa.array(text)
                    numbers = [(start - offsets[text] + base).astype(np.int32), (anchor - start).astype(np.int32), starts.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(bucket.view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *map(pa.array, numbers)], names=[c.split()[0] for c in STRETCH.split(", ")])

    return run


SPAN = "bucket long, s1 long, s2 long, copies long, stretches long, reach int, starts int, span binary"


def _cut(length: int) -> Callable:
    """The bytes of the stretches that are wanted of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0, TOGETHER):
                rows = [(w, t[w["first"] : w["first"] + w["starts"] - 1 + length]) for t, wants in zip(part.column(0).cast(pa.large_binary()).to_pylist(), part.column(1).to_pylist(), strict=True) for w in wants]
                yield pa.RecordBatch.from_pylist([{c: w[c] for c in ("bucket", "s1", "s2", "copies", "stretches", "reach", "starts")} | {"span": s} for w, s in rows], pa.schema([*((c, pa.int64()) for c in ("bucket", "s1", "s2", "copies", "stretches")), ("reach", pa.int32()), ("starts", pa.int32()), ("span", pa.binary())]))

    return run


def radix_order(groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers of the rows, in order of their group and then of their bytes.

    Passes go over digits of eight bytes, most significant first; rows that share all
    digits so far with no other are where they belong and take no part in the next.
    """
    digits = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8")
    order = np.argsort(groups, kind="stable")
    own = groups[order]
    head = np.concatenate(([True], own[1:] != own[:-1]))
    label = np.flatnonzero(head)[np.cumsum(head) - 1]  # where the group of each place begins
    for digit in digits.T:
        sizes = np.bincount(label, minlength=len(label))
        left = np.flatnonzero(sizes[label] > 1)
        if not len(left):
            break
        held, of = order[left], label[left]
        held = held[np.lexsort((digit[held], of))]
        order[left], value = held, digit[held]
        head = np.concatenate(([True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])))
        label[left] = left[head][np.cumsum(head) - 1]
    return order


def _shared(groups: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row in order shares with the one before; none with one of another group, as -1."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 4096):
        mine, before = order[at : at + 4096], order[at - 1 : at - 1 + len(order[at : at + 4096])]
        other = rows[mine] != rows[before]
        out[at : at + len(mine)] = np.where(groups[mine] != groups[before], -1, np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1]))
    return out


def repeated_offsets(bucket: np.ndarray, reach: np.ndarray, starts: np.ndarray, spans: list[bytes], length: int, gram: int) -> np.ndarray:
    """For each of some different stretches and each offset of an anchor in its window, whether another stretch of its bucket has that window."""
    n, back, groups = len(spans), length - gram, np.unique(bucket, return_inverse=True)[1]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    at, after, before = ends - [len(s) for s in spans] + reach, np.zeros((n, length), np.uint8), np.zeros((n, max(1, back)), np.uint8)
    for lo in range(0, n, 2048):
        rows = slice(lo, lo + 2048)
        places = at[rows, None] + np.arange(length)
        after[rows] = np.where(places < ends[rows, None], data[np.minimum(places, len(data) - 1)], 0)
        places = np.arange(before.shape[1])
        before[rows] = np.where(places < reach[rows, None], data[np.maximum(at[rows, None] - 1 - places, 0)], 0)
    sides = []
    for matrix in (before, after):
        order = radix_order(groups, matrix)
        sides.append((order, _shared(groups, matrix, order)))
    out, group = np.zeros((n, back + 1), bool), np.empty((2, n), np.int64)
    for d in range(back + 1):
        some = np.flatnonzero((reach >= d) & (reach - starts < d))
        if len(some) < 2:
            continue
        for side, ((order, shared), depth) in enumerate(zip(sides, (d, length - d), strict=True)):
            group[side, order] = np.cumsum(shared < depth)
        _, which, many = np.unique(group[0, some] * (n + 1) + group[1, some], return_inverse=True, return_counts=True)
        out[some, d] = many[which] > 1
    return out


VERDICT = "bucket long, s1 long, s2 long, low int, high int"


def _sorted(length: int, gram: int) -> Callable:
    """The windows of the stretches of a shard that others of it have: runs of starts, the first and the last."""

    def run(table: pa.Table) -> pa.Table:
        ids = [table.column(c).to_numpy() for c in ("bucket", "s1", "s2")]
        order = np.lexsort(ids[::-1])
        same = np.concatenate(([False], np.all([x[order][1:] == x[order][:-1] for x in ids], axis=0)))
        keep = order[~same]  # rows that repeat an id and its text are cut out twice
        table = table.take(pa.array(keep))
        reach, starts = (table.column(c).to_numpy().astype(np.int64) for c in ("reach", "starts"))
        found = repeated_offsets(ids[0][keep], reach, starts, table.column("span").to_pylist(), length, gram)
        found[table.column("copies").to_numpy() > 1] = False  # all of them are known to repeat
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        cols = [pa.array(x[keep][row]) for x in ids] + [pa.array((reach[row] - high + 1).astype(np.int32)), pa.array((reach[row] - low).astype(np.int32))]
        return pa.table(cols, names=["bucket", "s1", "s2", "low", "high"])

    return run


PART = "bucket long, s1 long, s2 long, reach int, low int, high int, c1 long, c2 long, p1 long, p2 long, part binary"


def _dealt(length: int, block: int) -> Callable:
    """Each stretch cut into its blocks of offsets, with digests of the bytes that all windows of the block share and of those that any has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, batch.schema.get_field_index("span"), TOGETHER // 8):
                rows = []
                for r in part.to_pylist():
                    low = r["reach"] - r["starts"] + 1
                    for b in range(low // block, r["reach"] // block + 1):
                        d0, d1 = max(low, b * block), min(r["reach"], b * block + block - 1)
                        # the whole block's windows share this much, wherever this stretch begins in it
                        shared = r["span"][r["reach"] - b * block : r["reach"] - (b * block + block - 1) + length] if b * block + block - 1 < length else b""
                        own = r["span"][r["reach"] - d1 : r["reach"] - d0 + length]
                        cut = [np.frombuffer(hashlib.blake2b(x, digest_size=16, salt=b"%d" % b).digest(), np.int64) for x in (shared, own + b"%d" % d0)]
                        rows.append((r["bucket"], r["s1"], r["s2"], r["reach"], d0, d1, *(int(x) for c in cut for x in c), own))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 11
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in PART.split(", ")])

    return run


def _windows(length: int) -> Callable:
    """Every window of a part, by a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, batch.schema.get_field_index("part"), TOGETHER // 32):
                rows = [(r["bucket"], r["s1"], r["s2"], r["reach"], d, *np.frombuffer(hashlib.blake2b(r["part"][r["high"] - d : r["high"] - d + length], digest_size=16).digest(), np.int64).tolist()) for r in part.to_pylist() for d in range(r["low"], r["high"] + 1)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "s1", "s2", "reach", "d", "w1", "w2"])

    return run


def _hot_verdicts(hot: DataFrame, length: int, block: int = 32) -> DataFrame:
    """The same for buckets of too many stretches for a task: by the bytes that blocks of offsets share, then window by window."""
    dealt = materialise(hot.mapInArrow(_dealt(length, block), PART), "dealt")
    core, whole = ["bucket", "c1", "c2"], ["bucket", "p1", "p2"]
    shared = dealt.groupBy(*core).agg(F.count("*").alias("n"), F.min("p1").alias("a"), F.max("p1").alias("b")).where("n > 1")
    same = dealt.groupBy(*whole).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    sure = dealt.join(same, whole, "left_semi")
    # of cores that hold different parts; parts that come twice stand for others here too, once
    mixed = dealt.join(shared.where("a <> b").select(*core), core, "left_semi").dropDuplicates([*whole, "low", "high"])
    windows = mixed.mapInArrow(_windows(length), "bucket long, s1 long, s2 long, reach int, d int, w1 long, w2 long")
    windows = materialise(windows, "windows")
    window = ["bucket", "d", "w1", "w2"]
    found = windows.join(windows.groupBy(*window).agg(F.count("*").alias("n")).where("n > 1").drop("n"), window, "left_semi")
    at = lambda d: (F.col("reach") - F.col(d)).alias("low" if d != "low" else "high")
    return sure.select("bucket", "s1", "s2", at("high"), at("low")).unionByName(found.select("bucket", "s1", "s2", at("d"), (F.col("reach") - F.col("d")).alias("high")))


def _key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def repeated_spans(docs: DataFrame, length: int = 400, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = 4_000, shard_bytes: int = 4_000_000) -> DataFrame:
    """(key, spans) of each different text that holds a repeated window: ranges of bytes, by start, which may overlap."""
    spark, gram = docs.sparkSession, gram or max(1, length // 4)
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= length)
    texts = texts.select("doc_id", _key(F.col("text")).alias("key"), "text")
    every = materialise(texts.mapInArrow(_anchored(length, gram), STRETCH), "stretches")
    # counts are written, so that the join deals both sides itself and Spark can split a bucket of very many rows
    shared = materialise(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    live = materialise(every.join(shared, "bucket", "left_semi"), "live")
    stretch = ["bucket", "s1", "s2"]
    kinds = live.groupBy(*stretch).agg(F.count("*").alias("copies"), F.max("reach").alias("reach"), F.max("starts").alias("starts"), F.min(F.struct("doc_id", "key", "first")).alias("of"))
    kinds = materialise(kinds, "kinds")
    several = materialise(kinds.groupBy("bucket").agg(F.count("*").alias("stretches")).where("stretches > 1"), "several")
    wanted = materialise(kinds.join(several, "bucket"), "wanted")
    whole = wanted.agg(F.sum(F.col("starts") + length).alias("bytes"), F.max("stretches").alias("most")).first()
    wants = wanted.select(F.col("of.doc_id").alias("of_id"), F.col("of.key").alias("key"), F.struct(*stretch, "copies", "stretches", "reach", "starts", F.col("of.first").alias("first")).alias("want"))
    wants = wants.groupBy("of_id", "key").agg(F.collect_list("want").alias("wants"))
    cut = texts.join(wants, (texts["key"] == wants["key"]) & texts["doc_id"].eqNullSafe(wants["of_id"])).select("text", "wants")
    spans = materialise(cut.mapInArrow(_cut(length), SPAN), "spans")
    shards = max(shuffle_partitions(spark), (whole["bytes"] or 0) // shard_bytes)
    cold = spans.where(F.col("stretches") <= hot).withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards)))
    verdicts = kinds.where("copies > 1").select(*stretch, F.lit(0).alias("low"), (F.col("starts") - 1).alias("high"))
    verdicts = verdicts.unionByName(materialise(cold.groupBy("shard").applyInArrow(_sorted(length, gram), VERDICT), "sorted"))
    if (whole["most"] or 0) > hot:
        verdicts = verdicts.unionByName(_hot_verdicts(spans.where(F.col("stretches") > hot), length))
    marks = live.select("key", *stretch, "first").join(verdicts, stretch)
    spot = F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + length).alias("stop"))
    return marks.groupBy("key").agg(F.sort_array(F.collect_set(spot)).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        for part in parts(batch, 1, TOGETHER):
            texts, rows = part.column(1).cast(pa.large_binary()).to_pylist(), []
            for text, marks in zip(texts, part.column(2).to_pylist(), strict=True):
                text, runs = text or b"", []
                for m in marks or ():
                    if runs and m["start"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], m["stop"])
                    else:
                        runs.append(dict(m))
                edges = [0, *(x for r in runs for x in (r["start"], r["stop"])), len(text)]
                rows.append((len(text), runs, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            n, runs, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row of docs: the maximal ranges of bytes that go, and the bytes that stay.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in
    the same text too; strings are those of the input and never cross texts. A null text is
    empty; a text of fewer bytes than `length` stays whole. Rows that repeat a text remove
    each other's, whatever their ids. Cut characters of several bytes stay cut, so `kept` is
    binary. Empty tables give an empty result; other columns are not read.
    """
    spans = materialise(repeated_spans(docs, length, id_col=id_col, text_col=text_col, **settings), "repeats")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", _key(F.col("text"))).join(spans, "key", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_kept, "doc_id long, n_bytes long, spans array<struct<start: int, stop: int>>, kept binary")


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document loses where 400 bytes repeat anywhere in all documents."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
