"""Best-fit packing of tokenised documents into sequences, under several capacities at once.

Each document is tokenised once, closed by an end token and cut into pieces; only the
sizes of pieces are shuffled. Pieces are dealt at random to groups of bounded size, and
each group packs its own by vector best-fit: in order of falling size, a piece goes to
the open sequence that fits it best under every capacity (tokens, documents, attention
cost), judged by the weighted dot product of its needs and what is left, or by the
weighted norm of what would remain.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[str, ...]:
    """Tokens beside the merges, such as that of the end of a text: they have their own ids wherever a text spells them."""
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _ranks(path: str):
    """The same vocabulary as ranks, where the folder of the tokenizer holds it: the same ids several times as fast."""
    if not os.path.exists(beside := os.path.splitext(path)[0] + ".tiktoken"):
        return None
    import public_tokenizers
    import tiktoken

    with open(beside, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def longest_run(data: bytes) -> int:
    """Bytes of the longest run of blanks or of anything else."""
    blank = np.frombuffer(data, np.uint8) <= 32
    return int(np.diff(np.flatnonzero(blank[1:] != blank[:-1]), prepend=-1, append=len(data) - 1).max(initial=0))


def encode(path: str, text: str, run: int = 2000) -> np.ndarray:
    """The ids of a whole text by the tokenizer, none added. The ranks give the same ids, but not for texts that spell an added token, and merge runs of over `run` bytes in quadratic time; those go to the tokenizer."""
    ranks = _ranks(path)
    if ranks is None or any(t in text for t in _added(path)) or len(text) > run and longest_run(text.encode()) > run:
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(ranks.encode_ordinary(text), "<u4")


@dataclass(frozen=True)
class Capacities:
    """Of one sequence: tokens, documents, attention cost (sum of squared lengths); weights of each for the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"

    def needs(self, lengths: np.ndarray) -> np.ndarray:
        n = lengths.astype(np.float64)
        return np.stack([n, np.ones_like(n), n * n], axis=1) / np.array([self.tokens, self.documents, self.attention], np.float64)


def pack(lengths: np.ndarray, caps: Capacities) -> np.ndarray:
    """The number of the sequence of each piece. A piece that alone breaks a capacity gets a sequence of its own."""
    needs, weights = caps.needs(lengths), np.array(caps.weights)
    order = np.lexsort((np.arange(len(lengths)), -(needs * weights).sum(axis=1)))
    out, room, used = np.empty(len(lengths), np.int64), np.empty((max(1, len(lengths)), 3)), 0
    open_, tiny = np.empty(0, np.int64), 1e-12
    least = needs.min(axis=0) if len(needs) else None
    for at, k in enumerate(order):
        need = needs[k]
        left = room[open_] - need
        fits = np.flatnonzero((left >= -tiny).all(axis=1))
        if len(fits):
            cost = (left[fits] ** 2 @ weights) if caps.rule == "norm" else -(room[open_[fits]] @ (weights * need))
            b = open_[fits[cost.argmin()]]
            room[b] -= need
        else:
            b = used
            room[b] = 1 - need
            open_ = np.append(open_, b)
            used += 1
        out[k] = b
        if at % 256 == 255:  # sequences that take no more piece
            open_ = open_[(room[open_] >= least - tiny).all(axis=1)]
    return out


def _pieces(path: str, tokens: int, end: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for k, text in enumerate(part.column(1)):
                    ids = np.append(encode(path, text.as_py() or ""), np.array([end], "<u4"))
                    first = (len(ids) - 1) % tokens + 1
                    for piece, stop in enumerate(range(first, len(ids) + 1, tokens)):
                        start = max(0, stop - tokens) if piece else 0
                        own = ids[start:stop].tobytes()
                        rows.append((k, piece, start, stop - start, zlib.crc32(own), own if with_ids else None))
                cols = list(zip(*rows, strict=True))
                arrays = [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(cols[i], pa.int64()) for i in (2, 3, 4)), pa.array(cols[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, tokens: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece, and its ids (unsigned, little-endian) if asked for.

    A document is its ids and the end token; a null text is an empty one. Documents of
    more than `tokens` are cut into pieces of that many, the first of which may be shorter.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), tokens, end, with_ids), schema)


def _packed(caps: Capacities) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        out, full = np.empty(len(lengths), np.int64), lengths >= caps.tokens
        packed = pack(lengths[~full], caps)
        out[~full] = packed
        out[full] = packed.max(initial=-1) + 1 + np.arange(full.sum())
        order = np.lexsort((-lengths, out))
        sorted_, size = out[order], lengths[order]
        total = np.cumsum(size) - size
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        offsets = np.empty(len(lengths), np.int64)
        offsets[order] = total - np.repeat(total[first], np.diff(np.append(first, len(sorted_))))
        group = table.column("pack_group").to_numpy()
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(group << 32 | out)).append_column("offset", pa.array(offsets))

    return run


def pack_pieces(pieces: DataFrame, caps: Capacities | None = None, group_tokens: int = 24_000_000, group_pieces: int = 200_000) -> DataFrame:
    """The pieces with sequence_id and offset: places in a sequence are gapless from 0.

    Pieces are dealt by a hash of what they are to groups of about `group_tokens` tokens, or
    of `group_pieces` pieces where those are short, so one group, its time and its waste,
    some sequences at most, do not grow with the corpus.
    Repeated rows are pieces of their own. `pieces` needs the column length, above 0, and
    is read twice: give a written table. No piece gives no sequence.
    """
    prepare(pieces.sparkSession)
    caps = caps or Capacities()
    held = pieces.agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).first()
    groups = 1 + max((held["tokens"] or 0) // group_tokens, held["n"] // group_pieces)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    keyed = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return keyed.groupBy("pack_group").applyInArrow(_packed(caps), schema)


def pack_documents(docs: DataFrame, caps: Capacities | None = None, tokenizer: str | None = None, end: int = 0, group_tokens: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document is."""
    caps = caps or Capacities()
    pieces = materialise(tokenised_pieces(docs, tokenizer, caps.tokens, end, id_col, text_col), "pieces")
    return pack_pieces(pieces, caps, group_tokens)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; documents and attention do not bind beyond that."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
