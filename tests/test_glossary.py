"""The glossary on texts of its own: matching, what is demanded, segments by place, excerpts."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import glossary as G

M = "⟦PH_000001⟧"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_places_against_regular_expressions(spark):
    """Words whatever their case; forms with CJK signs anywhere; one form inside another; none of one form overlap."""
    rng = random.Random(8)
    forms = ["ab", "ab cd", "cd", "Ünï", "天地", "地a", "天天", "(x)", "a_b", "b"]
    alphabet = ["ab", "cd", " ", "ÜNÏ", "天", "地", "a", "(x)", "_", "b", "-", "AB", "İ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(80)] + [None, "", "天天天天"]
    got = G.places(frame(spark, list(enumerate(texts)), "unit long, text string").repartition(3), frame(spark, list(enumerate(forms)), "form long, value string"))
    want = []
    for u, t in enumerate(texts):
        for i, f in enumerate(forms):
            pattern = re.escape(f) if re.search("[一-鿿]", f) else rf"\b{re.escape(f)}\b"
            want += [(u, i, m.start(), m.end()) for m in re.finditer(pattern, t or "", 0 if re.search("[一-鿿]", f) else re.IGNORECASE)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_demanded_and_missing(spark):
    glossary = frame(spark, [(0, "fox|vixen", "Fuchs"), (1, "dog", "Hund"), (2, "the", "der"), (3, "old dog", "alter Hund"), (4, "cat", ""), (5, " ", "x"), (6, "cat", None)], "entry long, source string, translation string")
    chunks = frame(spark, [(1, 0, "the fox, the vixen, the old dog", "der Fuchs und der alte Hund"), (1, 1, "dog", "Hunde"), (2, 0, None, None)], "unit long, chunk long, source string, output string")
    top, _ = G.demanded(chunks, glossary, 3)
    assert sorted(map(tuple, top.collect())) == [(1, 0, 0, 2, 2), (1, 0, 2, 3, 3), (1, 0, 3, 1, 1), (1, 1, 1, 1, 1)]
    assert sorted(map(tuple, G.missing(chunks, glossary, top).collect())) == [(1, 0, 3), (1, 1, 1)]


def test_report_pairs_segments_by_place(spark):
    glossary = frame(spark, [(0, "fox", "Fuchs"), (1, "hen", "Huhn")], "entry long, source string, translation string")
    source = f"{M}a fox and a fox{M} no beast {M}the fox again{M}"
    chunks = frame(spark, [(1, 0, source, f"{M}ein Tier{M} keins {M}das Tier{M}"), (1, 1, "third fox", "drittes"), (2, 0, "one hen" + M, "eins"), (3, 0, "fox", "Fuchs")], "unit long, chunk long, source string, output string")
    out = sorted(map(tuple, G.report(chunks, glossary).collect()))
    assert out == [(1, 0, 0, 1, "a fox and a fox", "ein Tier"), (1, 0, 0, 3, "the fox again", "das Tier")]


def test_segments_and_as_of(spark):
    chunks = frame(spark, [(1, 0, f"ab{M}{M}cd"), (1, 1, M), (2, 0, "")], "unit long, chunk long, source string")
    seg = G.stretches(chunks, "source")
    assert sorted((r["unit"], r["chunk"], r["segment"], r["start"], r["n"], r["text"]) for r in seg.collect()) == [(1, 0, 0, 0, 3, "ab"), (1, 0, 1, 13, 3, ""), (1, 0, 2, 24, 3, "cd"), (1, 1, 0, 0, 2, ""), (1, 1, 1, 11, 2, ""), (2, 0, 0, 0, 1, "")]
    spans = frame(spark, [(1, 0, p) for p in range(27)], "unit long, chunk long, start long")
    got = {r["start"]: r["s"]["segment"] for r in G.in_segments(spans, seg).collect()}
    assert got == {p: 0 if p < 13 else 1 if p < 24 else 2 for p in range(27)}


def test_excerpts(spark):
    rows = [(" short ", 0, 3), ("x" * 100 + "term" + "y" * 100, 100, 104), ("a " * 60, 0, 1), ("b " * 60, 118, 119)]
    out = [r[0] for r in frame(spark, rows, "t string, a int, b int").select(G.excerpt(F.col("t"), F.col("a"), F.col("b"), 20)).collect()]
    assert out == ["short", "…" + "x" * 8 + "term" + "y" * 8 + "…", ("a " * 10).strip() + "…", "…" + ("b " * 10).strip()]
