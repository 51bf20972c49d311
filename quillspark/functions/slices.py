"""Arrow batches in slices: what Python holds as objects is bounded in bytes, however many rows a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def slices(texts: pa.Array, most: int = 1 << 20, rows: int = 256) -> Iterator[pa.Array]:
    """An array of strings in slices of at most `rows` rows and about `most` bytes; a longer text is a slice of its own."""
    at = 0
    while at < len(texts):
        part = texts.slice(at, rows)
        while len(part) > 1 and part.nbytes > most:
            part = part.slice(0, len(part) // 2)
        yield part
        at += len(part)


def by_slices(texts: pa.Array, kind: pa.DataType, one: Callable) -> pa.Array:
    """`one` of each text, as an array of `kind`; only the texts and results of one slice are Python objects at once."""
    made = [pa.array([one(t) for t in part.to_pylist()], kind) for part in slices(texts)]
    return pa.concat_arrays(made) if made else pa.array([], kind)
