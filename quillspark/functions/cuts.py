"""Cutting a text at safe places within a bound of bytes: a walk over sorted places, one step a chunk."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .repeats import codes_of

#: The end of a row of a table, the bytes up to which such an end is looked for, what is never cut.
ROW_END = re.compile("</tr>", re.IGNORECASE)
SOFT = 1024
ATOM = re.compile(r"⟦PH_\d{6}⟧")
_BLANKS = (9, 10, 32)


class Cuts:
    """The places of a text at which it may be cut, and how many bytes are before each."""

    def __init__(self, text: str):
        codes = codes_of(text)
        wide = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        self.text, self.bytes = text, np.concatenate(([0], np.cumsum(wide)))
        whole = np.ones(len(text) + 1, bool)
        for atom in ATOM.finditer(text):
            whole[atom.start() + 1 : atom.end()] = False
        self.whole = np.flatnonzero(whole)  # not within an atom
        self.blanks = np.flatnonzero(np.isin(codes, _BLANKS)) + 1
        self.rows = np.array([m.end() for m in ROW_END.finditer(text)], np.int64)

    def _row_end(self, at: int, limit: int, soft: int) -> int | None:
        """The last end of a row within `soft` bytes, else the first that there is, up to a place."""
        ends = self.rows[np.searchsorted(self.rows, at + len("</tr>")) : np.searchsorted(self.rows, limit, "right")]
        if not len(ends):
            return None
        near = int(np.searchsorted(self.bytes[ends], self.bytes[at] + soft, "right"))
        return int(ends[max(near - 1, 0)])

    def after(self, at: int, most: int, soft: int) -> int:
        """Where the chunk that begins at a place ends."""
        end, left = len(self.text), int(self.bytes[-1] - self.bytes[at])
        if left <= most:
            row = self._row_end(at, end, soft) if left > soft else None
            return end if row is None else row
        hard = int(self.whole[np.searchsorted(self.bytes[self.whole], self.bytes[at] + most, "right") - 1])
        if hard <= at:
            raise ValueError(f"{most} bytes are too few for one character or placeholder")
        row = self._row_end(at, hard, soft)
        if row is not None:
            return row
        blank = int(np.searchsorted(self.blanks, hard, "right"))
        return int(self.blanks[blank - 1]) if blank and self.blanks[blank - 1] > at else hard


def safe_chunks(text: str, most: int, soft: int = SOFT) -> list[str]:
    """A text in chunks of at most `most` bytes of UTF-8, an upper bound of any tokens; joined they are the text.

    A chunk ends with the row of a table where one ends, else after the last blank or line
    end, else before the sign that no longer fits; placeholders are never cut. Rows are kept
    within `soft` bytes where they can be. An empty text is one empty chunk.
    """
    cuts, at, out = Cuts(text), 0, []
    while at < len(text):
        end = cuts.after(at, most, soft)
        out.append(text[at:end])
        at = end
    return out or [""]


def chunks_of(text: Column, most: int, soft: int = SOFT) -> Column:
    """array<string> of safe_chunks; null for null."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else safe_chunks(t, most, soft))

    return cut(text)
