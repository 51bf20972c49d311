"""Sections of lines and of any ranges: one pass, no join of ranges."""

import contextlib
import io
import random

import pytest

from quillspark.operators import structure
from quillspark.registry import QUERIES
from conftest import SF


@pytest.mark.parametrize("name", ["section_ranges", "note_join", "recovered_sections", "section_of_range"])
def test_one_pass_over_the_lines(spark, name):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        QUERIES[name](spark, SF).explain()
    plan = said.getvalue()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_deepest_of_any_ranges(spark):
    """Ranges that overlap, end early, repeat or are empty; against every pair."""
    rng = random.Random(6)
    ranges = [(d, f"s{i}", a := rng.randrange(60), a + rng.randrange(-1, 25), rng.randrange(1, 5)) for d in range(6) for i in range(rng.randrange(1, 12))] + [(1, "null", None, 5, 1), (7, "alone", 3, 3, 1)]
    lines = [(d, rng.randrange(90), i) for d in (*range(6), 8) for i in range(25)]
    sections = spark.createDataFrame(ranges, "doc_id long, id string, start_line long, end_line long, level long").repartition(3)
    out = structure.deepest_section(spark.createDataFrame(lines, "doc_id long, line long, x int"), sections)

    def best(d, line):
        held = [(level, s, i) for k, i, s, e, level in ranges if k == d and s is not None and s <= line <= e]
        return max(held)[2] if held else None

    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((d, n, x, best(d, n)) for d, n, x in lines), key=repr)
    assert sum(best(d, n) is not None for d, n, _ in lines) > 40
    assert structure.deepest_section(spark.createDataFrame(lines[:2], "doc_id long, line long, x int"), sections.where("false")).where("deepest IS NULL").count() == 2


def test_marks_are_those_of_lines(spark):
    """Marks in one pass and marks out of lines are the same, nulls, empty documents and anchors included."""
    texts = [["a", "# b", "<!-- page: 3 -->", "x [^1] ![^2]", "[^1]: y", "```", "# no [^9]", "```", "#### d"], [], None, [None, "  ", "# "], ["<!-- page: 99999999999999999999 -->", "# after"], ["plain"], ["`open", "# in span` [^3]", "#no", "#######"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, lines array<string>")
    key = lambda df: sorted((r["doc_id"], r["line_no"], r["visible"], r["n"], r["held"]) for r in df.select("doc_id", "line_no", "visible", "n", "held").collect())
    got, want = key(structure.read_marks(docs)), key(structure._marks(structure.read_lines(docs)))
    assert got == want and len(got) == 12
    assert sorted(map(tuple, structure.recover(structure.read_marks(docs)).collect())) == sorted(map(tuple, structure.recover(structure.read_lines(docs)).collect()))
