"""Cutting texts into overlapping chunks and lists into groups: greedy, so a walk over the parts of each text, linear in its length.

Tasks run these; a session of a cluster has to know the package (`sources.shared.prepare`).
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import by_slices


def packed(text: str, size: int, overlap: int, separator: str) -> list[str]:
    """The chunks of one text; see chunk_text."""
    plain: list[str] = []
    held: list[str] = []
    room = size
    for p in filter(None, (x.strip(" \t\r\n") for x in text.split(separator))):
        if held and (len(p) > size or len(p) + 2 > room):
            plain.append("\n\n".join(held))
            held, room = [], size
        if len(p) > size:
            plain += [p[i : i + size] for i in range(0, len(p), size - overlap)]
        else:
            room -= len(p) + 2 * bool(held)
            held.append(p)
    if held:
        plain.append("\n\n".join(held))
    return [before[-overlap:] + c if before is not None else c for before, c in zip([None, *plain], plain, strict=False)]


def grouped(sizes: list[int], limit: int) -> list[int]:
    """How many of some sizes in a row make each group."""
    out, left = [], -1
    for n in sizes:
        if out and n <= left:
            out[-1] += 1
            left -= n
        else:
            out.append(1)
            left = limit - n
    return out


def chunk_text(text: Column, size: int = 4000, overlap: int = 300, separator: str = "\n\n") -> Column:
    """array<string>: paragraphs packed greedily up to `size` characters, two for each joint.

    A paragraph that is longer ends what is packed so far and becomes windows of its own,
    which overlap. Each chunk but the first then starts with the last `overlap`
    characters of the one before, as that was without such a start. A null or blank text
    has no chunk.
    """

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return by_slices(texts, pa.list_(pa.string()), lambda t: packed(t or "", size, overlap, separator))

    return cut(text)


def byte_groups(units: Column, limit: int = 65536) -> Column:
    """array<array<string>>: units in order, grouped greedily while a group stays within `limit` bytes of UTF-8; a larger unit is a group of its own."""

    @F.pandas_udf("array<struct<at: int, n: int>>")
    def cut(sizes: pd.Series) -> pd.Series:
        def spans(own) -> list[dict]:
            out, at = [], 1
            for n in grouped(list(own), limit):
                out.append({"at": at, "n": n})
                at += n
            return out

        return sizes.map(lambda own: [] if own is None else spans(own))

    return F.transform(cut(F.transform(units, lambda u: F.octet_length(u))), lambda s: F.slice(units, s["at"], s["n"]))
