"""The chunker against its definition: every place tried from the end backwards."""

import random
import re

import pytest

from quillspark.functions.cuts import safe_chunks

M = "⟦PH_000007⟧"


def plain(text, most, soft):
    """Prefixes of what is left, the longest first; what may end a chunk is read off the prefix itself."""
    size = lambda s: len(s.encode())
    out = []
    while text:
        inside = {p for m in re.finditer(r"⟦PH_\d{6}⟧", text) for p in range(m.start() + 1, m.end())}
        fits = [p for p in range(1, len(text) + 1) if size(text[:p]) <= most and p not in inside]
        if not fits:
            raise ValueError
        hard = fits[-1]
        rows = [p for p in range(1, hard + 1) if text[:p].lower().endswith("</tr>")]
        soft_rows = [p for p in rows if size(text[:p]) <= soft]
        row = (soft_rows[-1:] or rows[:1] or [None])[0]
        if hard == len(text):
            end = row if row is not None and size(text) > soft else hard
        else:
            blanks = [p for p in range(1, hard + 1) if text[p - 1] in " \t\n"]
            end = row if row is not None else (blanks[-1:] or [hard])[0]
        out.append(text[:end])
        text = text[end:]
    return out or [""]


@pytest.mark.parametrize("seed", range(6))
def test_chunks(seed):
    rng = random.Random(seed)
    parts = ["a", "é", "日", "😀", " ", "\n", "\t", "word", "</tr>", "</TR>", M, ". ", "<td>"]
    for _ in range(150):
        text = "".join(rng.choices(parts, [rng.random() ** 3 for _ in parts], k=rng.randrange(70)))
        most, soft = rng.randrange(15, 60), rng.randrange(5, 50)
        got = safe_chunks(text, most, soft)
        assert got == plain(text, most, soft)
        assert "".join(got) == text and all(len(c.encode()) <= most for c in got) and not any(M in text and c.endswith(M[:5]) for c in got)


def test_too_narrow_and_empty():
    with pytest.raises(ValueError):
        safe_chunks("x" + M, 10)
    assert safe_chunks("", 5) == [""] and safe_chunks("ab", 1) == ["a", "b"]


def test_a_long_text_is_cut_in_time():
    text = ("some words of a line " * 20 + "\n") * 5000
    got = safe_chunks(text, 512)
    assert "".join(got) == text and max(map(len, got)) <= 512
