"""What repeats within a text and between texts, over arrays of code points: no loop over characters.

Hashes of runs come from those of runs half as long; equal runs are found by one stable
sort of the hashes and compared sign by sign before they count.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(codes: np.ndarray) -> np.ndarray:
    """How many letters and digits stand before each place, and in all."""
    signs, where = np.unique(codes, return_inverse=True)
    return np.concatenate(([0], np.cumsum(np.array([chr(c).isalnum() for c in signs], np.int64)[where]))) if len(codes) else np.zeros(1, np.int64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ a >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + b
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def over_runs(values: np.ndarray, size: int, both: Callable) -> np.ndarray:
    """`both` folded over each `size` values in a row, where a value may count twice in a row longer than a power of two."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values, have = both(values[:-step], values[step:]), have + step
    return values


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` signs in a row."""
    return over_runs(_mixed(codes.astype(np.uint64), np.uint64(0xC2B2AE3D27D4EB4F)), size, _mixed) if len(codes) >= size else np.empty(0, np.uint64)


def same_runs(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` signs from a place of a are those from a place of b, for each pair of places."""
    out, step = np.ones(len(at_a), bool), np.arange(size)
    for lo in range(0, len(at_a), 4096):
        own = slice(lo, lo + 4096)
        out[own] = (a[at_a[own, None] + step] == b[at_b[own, None] + step]).all(axis=1)
    return out


def repeats_before(codes: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` signs the last place before it where the same run starts, or -1."""
    hashes = gram_hashes(codes, size)
    order = np.argsort(hashes, kind="stable")
    out = np.full(len(hashes), -1, np.int64)
    twin = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]]) if len(order) else order
    later, earlier = order[twin + 1], order[twin]
    same = same_runs(codes, later, codes, earlier, size)
    out[later[same]] = earlier[same]
    return out


def doubled_units(codes: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(place, length) of units that stand twice in a row: the first place first, there the longest unit, none within another pair."""
    unit = np.zeros(len(codes), np.int64)
    for p in range(least, min(most, len(codes) // 2) + 1):
        run = np.concatenate(([0], np.cumsum(codes[p:] == codes[:-p])))
        unit[np.flatnonzero(run[p:] - run[:-p] == p)] = p
    places, out, free = np.flatnonzero(unit), [], 0
    while (k := np.searchsorted(places, free)) < len(places):
        at = int(places[k])
        out.append((at, int(unit[at])))
        free = at + 2 * out[-1][1]
    return out


def repeated_regions(text: str, gram: int = 16, reach: int = 600, merge: float = 0.03, meaningful: int = 4) -> np.ndarray:
    """Where, as shares of the text, units of 4 to 15 signs stand twice in a row or `gram` signs come again within `reach`.

    Units and grams need `meaningful` letters or digits. Of grams that repeat at one
    distance, side by side, the first counts. Places no further than `merge` from the last
    that is kept fall to it.
    """
    text = re.sub(r"\s+", " ", text).strip()
    codes = codes_of(text)
    if not len(codes):
        return np.empty(0)
    held = letters(codes)
    pairs = [at + p for at, p in doubled_units(codes, 4, 15) if held[at + p] - held[at] >= meaningful]
    before = repeats_before(codes, gram)
    start = np.arange(len(before))
    apart = np.where((before >= 0) & (held[start + gram] - held[start] >= meaningful) & (start - before >= gram) & (start - before <= reach), start - before, 0)
    first = np.flatnonzero((apart > 0) & (np.concatenate(([0], apart[:-1])) != apart)) if len(apart) else start
    places = np.sort(np.concatenate([np.array(pairs, np.float64), (before[first] + first + gram) / 2])) / len(codes)
    kept: list[float] = []
    while len(places):  # at most as often as `merge` fits into the text
        kept.append(float(places[0]))
        places = places[places - kept[-1] > merge]
    return np.array(kept)


def winnowed(codes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places): the least hashed gram of each `size` signs in a row, each place once; two texts that share such a run share one of its grams."""
    hashes = gram_hashes(codes, gram)
    window = size - gram + 1
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    places = np.unique(over_runs((hashes & ~np.uint64((1 << 32) - 1)) | np.arange(len(hashes), dtype=np.uint64), window, np.minimum) & np.uint64((1 << 32) - 1)).astype(np.int64)
    return hashes[places], places


def shares_run(a: np.ndarray, b: np.ndarray, size: int, meaningful: int = 0) -> bool:
    """Whether two texts have `size` signs in a row in common, of which `meaningful` are letters or digits."""
    left, right = gram_hashes(a, size), gram_hashes(b, size)
    if meaningful and len(left):
        held = letters(a)
        left = np.where(held[size:] - held[:-size] >= meaningful, left, np.uint64(0))
    common, at_a, at_b = np.intersect1d(left, right, return_indices=True)
    return bool(same_runs(a, at_a, b, at_b, size).any()) if len(common) else False
