"""Words of whole texts as places in the UTF-8 bytes of an Arrow column; nothing here loops over characters.

A word is a longest run of ASCII letters and digits and of anything beyond ASCII; only
A-Z are lower-cased. Every byte of a character beyond ASCII is above 0x7F, so runs of
bytes are runs of characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[128:] = True
#: The remainders of all bytes by the polynomial of CRC-32, least bit first.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ 0xEDB88320, CRC >> 1).astype(np.uint32)
#: The lowest n bytes of eight.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def parts(batch: pa.RecordBatch, column: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of a text column: what is held at once follows neither rows nor batches."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts, the first at 0; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Where the words of some texts are: `data` are the lower-cased bytes, `text` the number of the text of each word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    texts: int

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        raw, offsets = bytes_of(column)
        data = LOWER[raw]
        held = IN_WORD[data]
        some = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins, stops = held.copy(), held.copy()
        begins[1:] &= ~held[:-1]
        stops[:-1] &= ~held[1:]
        begins[some] = held[some]
        stops[some[1:] - 1] = held[some[1:] - 1]
        starts = np.flatnonzero(begins)
        return cls(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, "right") - 1, len(column))

    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)

    def crc32(self, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
        """The crc32 of what `crc` is the crc32 of and then the words `which`."""
        out, starts, sizes = ~crc, self.starts[which], (self.ends - self.starts)[which]
        left = np.arange(len(which))
        for k in range(24):
            left = left[sizes[left] > k]
            if not len(left):
                return ~out
            old = out[left]
            out[left] = CRC[(old ^ self.data[starts[left] + k]) & 0xFF] ^ old >> 8
        out = ~out
        for i in left[sizes[left] > 24].tolist():
            out[i] = zlib.crc32(self.data[starts[i] + 24 : starts[i] + sizes[i]], int(out[i]))
        return out

    def keys(self) -> np.ndarray:
        """Three numbers for each word: its length and its bytes, eight and eight; of a word of over 16 bytes two hashes of 64 bits instead of them."""
        size = self.ends - self.starts
        room = np.concatenate([self.data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))
        out = np.stack([size.astype(np.uint64), eight[self.starts] & LOW_BYTES[np.minimum(size, 8)], eight[np.minimum(self.starts + 8, len(self.data))] & LOW_BYTES[np.clip(size - 8, 0, 8)]])
        for i in np.flatnonzero(size > 16).tolist():
            word = xxhash.xxh3_128_intdigest(self.data[self.starts[i] : self.ends[i]])
            out[1, i], out[2, i] = word >> 64, word & (1 << 64) - 1
        return out


def mixed(keys: np.ndarray) -> np.ndarray:
    """One number of 64 bits for the three of a word, by which words are looked up before all three are compared."""
    out = keys[1] * np.uint64(0x9E3779B97F4A7C15) ^ keys[2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[0]
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
