"""Repetition, copies and winnowing against plain searches."""

import random
import re

import numpy as np
import pytest

from quillspark.functions import repeats


def texts(seed, n=60):
    rng = random.Random(seed)
    for _ in range(n):
        words = ["".join(rng.choice("abcé日 -") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice((2, 5, 12)))]
        yield " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))


def plain_regions(text):
    """By the definition: every unit and every pair of grams looked for by itself."""
    text = re.sub(r"\s+", " ", text).strip()
    n, found = len(text), []
    able = lambda s: len([c for c in s if c.isalnum()]) >= 4
    at = 0
    while at < n:
        units = [p for p in range(15, 3, -1) if at + 2 * p <= n and text[at : at + p] == text[at + p : at + 2 * p]]
        if units:
            found += [(at + units[0]) / n] if able(text[at : at + units[0]]) else []
            at += 2 * units[0]
        else:
            at += 1

    def gap(s):
        """The distance to the last such gram before, 0 if it does not count."""
        p = text.rfind(text[s : s + 16], 0, s + 15)
        return s - p if s >= 0 and p >= 0 and able(text[s : s + 16]) and 16 <= s - p <= 600 else 0

    found += [(2 * s - gap(s) + 16) / 2 / n for s in range(n - 15) if gap(s) and (s == 0 or gap(s - 1) != gap(s))]
    out = []
    for f in sorted(found):
        if not out or f - out[-1] > 0.03:
            out.append(f)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_regions(seed):
    some = 0
    for t in texts(seed):
        want = plain_regions(t)
        assert repeats.repeated_regions(t) == pytest.approx(want), t
        some += bool(want)
    assert some > 10
    assert len(repeats.repeated_regions("")) == len(repeats.repeated_regions("   ")) == 0


def test_long_texts_take_no_quadratic_time():
    text = "word " * 60_000 + "".join(random.Random(1).choice("abcdefghij ") for _ in range(300_000))
    assert len(repeats.repeated_regions(text)) >= 10


@pytest.mark.parametrize("seed", range(3))
def test_shared_runs(seed):
    rng, some = random.Random(seed), set()
    for a, b in zip(texts(seed), texts(seed + 10), strict=True):
        if len(a) > 40 and rng.random() < 0.5:
            b = b[:30] + a[5 : 5 + rng.choice((19, 20, 21))] + b[30:]
        want = any(a[i : i + 20] in b and sum(c.isalnum() for c in a[i : i + 20]) >= 6 for i in range(len(a) - 19))
        assert repeats.shares_run(repeats.codes_of(a), repeats.codes_of(b), 20, 6) == want
        some.add(want)
    assert some == {True, False}


def test_texts_with_a_common_run_share_a_winnowed_gram():
    rng = random.Random(4)
    for _ in range(200):
        run = "".join(rng.choice("abc") for _ in range(40))
        sides = [repeats.codes_of("".join(rng.choice("abc") for _ in range(rng.randrange(60))) + run + "".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for _ in range(2)]
        assert len(np.intersect1d(*(repeats.winnowed(s, 40, 20)[0] for s in sides)))
    assert len(repeats.winnowed(repeats.codes_of("a" * 39), 40, 20)[0]) == 0


@pytest.mark.parametrize("few", [10**6, 0])
def test_copied_spans_of_references_as_large_as_documents(spark, few):
    """Both sides of many texts; every pair by brute force."""
    from quillspark.operators.translation import copied_spans

    rng = random.Random(9)
    source = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(20, 200))) for _ in range(40)]
    docs, refs = [(i, source[i]) for i in range(20)], [(i, source[20 + i]) for i in range(20)]
    for _ in range(25):
        (i, a), (j, b) = rng.choice(docs), rng.choice(refs)
        at, cut = rng.randrange(len(a)), rng.randrange(25, 40)
        refs[j] = (j, b[: len(b) // 2] + a[at : at + cut] + b[len(b) // 2 :])
    docs += [(20, None), (21, ""), (22, refs[0][1]), (22, refs[0][1])]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    got = sorted(map(tuple, copied_spans(frame(docs, "doc_id"), frame(refs, "item_id"), 30, few).collect()))
    assert got == sorted({(i, j) for i, a in docs for j, b in refs if any((a or "")[k : k + 30] in b for k in range(len(a or "") - 29))})
    assert len(got) > 10


def test_alignment_and_salvage():
    from quillspark.operators.acceptance import _put_in, _salvage

    mark = lambda n: f"⟦PH_{n:06d}⟧"
    assert _put_in(f"ab {mark(1)} cd", "abcdef ghij") == f"abcdef{mark(1)} ghij"
    assert _put_in(f"{mark(1)}{mark(2)}", "") == f"{mark(1)}{mark(2)}" and _put_in("no marks", "plain") == "plain"
    assert _put_in(f"{mark(1)}text{mark(2)}", "one two") == f"{mark(1)}one two{mark(2)}"
    assert _put_in(f"a{mark(1)}a{mark(2)}aaaaaaaa", "abcdefghij") == f"{mark(1)}{mark(2)}abcdefghij"
    assert _salvage('<think>[9]</think>x {bad ["a"] [{"a": ",]"},]') == "[]" and _salvage('{"terms": [{"a": ",]"}, 3,], }') == '[{"a": ",]"}]'
    assert _salvage('<NER_JSON>```json\n[{"b": 1}]```</NER_JSON> [{"c": 2}]') == '[{"b": 1}]' and _salvage("none [ here") is None
