"""Rules of Markdown, pages, XHTML and translations on small texts of their own."""

import re

from conftest import SF
from pyspark.sql import functions as F

from quillspark.functions import markdown as M
from quillspark.functions import names as N
from quillspark.functions import paths as P
from quillspark.functions.repeats import repeated_regions
from quillspark.operators import acceptance, books, pages, stores, structure, xhtml


def one(spark, column, **values):
    row = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in row.items())).select(column.alias("x")).first()["x"]


def md(spark, *texts):
    return structure.read_lines(spark.createDataFrame([(k, t.split("\n")) for k, t in enumerate(texts)], "doc_id long, lines array<string>"))


def test_line_states():
    lines = "a\n````md\n```\n# no\n`````\nb `` c\n# no ` still\nd `` e\n<!-- x\n```\n--> y ```\n~~~\n```\n~~~ z\n~~~\nend\n```a`b\n    ```".split("\n")
    states = M.line_states(lines)
    assert [f for f, _, _ in states] == [False] + [True] * 4 + [False] * 6 + [True] * 4 + [False] * 3
    seen = [v for _, v, _ in states]
    assert seen[5:8] == ["b ", "", " e"] and seen[8:10] == ["", ""] and seen[10].startswith(" y ")
    assert M.line_states([]) == [] and M.line_states(["<!-- a --> b <!-- c", "d --> e"]) == [(False, " b ", True), (False, " e", True)]


def test_sections_notes_and_repairs(spark):
    text = "intro [^a]\n# Part One\n<!-- page: 4 -->\n## Notes\n[^a]: body\n[^b]: lonely\n### deep [^c] [^a]\n# Bibliography\n## After\n```\n# not\n```\n## [^d]: small"
    lines = md(spark, text, "no heading\nhere", "", " ")
    rows = {(r["doc_id"], r["title"]): r for r in structure.recover(lines).collect()}
    assert rows[0, "Front Matter"]["end_line"] == 1 and rows[0, "Part One"]["kind"] == "part" and rows[0, "Notes"]["role"] == "backmatter"
    assert rows[0, "After"]["role"] == "backmatter" and rows[0, "Part One"]["end_line"] == 7 and rows[0, "deep [^c] [^a]"]["section_id"] == "section_004"
    assert rows[1, "Body"]["end_line"] == 2 and not any(d in (2, 3) for d, _ in rows)
    notes = {r["label"]: r for r in structure.notes_of(lines).collect()}
    assert (notes["a"]["refs"], notes["a"]["def_line"], notes["a"]["kind"], notes["a"]["anomaly"]) == (2, 5, "endnote", "")
    assert notes["b"]["anomaly"] == "note has no references" and notes["c"]["anomaly"] == "note definition is missing"
    assert [notes[x]["ordinal"] for x in "acb"] == [1, 2, 3]
    assert one(spark, F.regexp_extract("t", M.NOTE_HEADING, 1), t="## [^d]: small") == "[^d]: small"


def test_running_heads_and_titles(spark):
    def lines(*texts):
        rows = [(1, p, 10 * p + k, line) for p, t in enumerate(texts, 1) for k, line in enumerate(t.split("\n"))]
        return spark.createDataFrame(rows, "doc_id long, page long, line_no long, line string")

    book = lines("# Law as Art\nbody one\n1", "## Law as Art 2\nbody two", "**3 Law as Art**\nbody three\niii", "## 4 Law as Art\nbody four", "Chapter 1\nx", "Chapter 2\ny")
    heads = pages.heads_of(book).collect()
    assert [(r["head"], r["pages"], r["title_level"]) for r in heads] == [("law as art", 4, 1)]
    left = [r["line"] for r in pages.without_heads(book).orderBy("line_no").collect()]
    assert left == ["# Law as Art", "body one", "1", "body two", "body three", "iii", "body four", "Chapter 1", "x", "Chapter 2", "y"]
    assert pages.heads_of(lines("A B C\nx", "A B C\ny", "A B C\nz")).count() == 0
    wrapped = lines("# On the\n\n# Nature of Law,\n# and Art\n# PART I\n# Of Laws\n## x -\n# y")
    assert [(r["title"], r["next_title"]) for r in pages.wrapped(wrapped).where("merges").orderBy("line_no").collect()] == [("On the", "Nature of Law,")]
    demote = lines("# 1 First\n# Aside\n## Below\n# 3.2 Dotted", "# 2 Second\n###### Deep", "# 3.1. Late\ntext")
    out = {r["line_no"]: r["new_level"] for r in pages.demoted(demote).collect()}
    assert out == {10: 1, 11: 2, 12: 3, 13: 2, 20: 1, 21: 6, 30: 2}
    assert all(r["new_level"] == r["level"] for r in pages.demoted(lines("# One\n# Two", "text\n# Three")).collect())
    for text, bare in (("xiv", True), (" - 12 - ", True), ("12345", False), ("civil", False), ("---", False), ("mix", True)):
        assert one(spark, pages.bare_number(F.col("t")), t=text) is bare, text


def test_chapters_and_units(spark):
    text = "\n".join(["# A", "word " * 60, "```", "code " * 100, "```", "é" * 300, "# B", "x"])
    out = {r["k"]: r for r in books.bound_chapters(md(spark, text, "no heading"), 200).collect()}
    assert set(out) == {1, 2} and "".join(out[1]["units"]) == out[1]["text"]
    assert all(len(u.encode()) <= 200 or u.startswith("```") for u in out[1]["units"]) and any(u.startswith("```") and u.endswith("```\n") for u in out[1]["units"])
    assert list(books.hard_bound("ab cd ef", 5)) == ["ab ", "cd ef"] and list(books.hard_bound("é" * 5, 3)) == ["é"] * 5 and list(books.hard_bound("", 3)) == []
    toc = books.toc_entries(md(spark, "# Contents\n- One  3\n2. Two words 14\n- One 5\n## sub\nThree 7\n# Next\nFour 9")).collect()
    assert {(r["entry"], r["page"]) for r in toc} == {("one", 5), ("two words", 14), ("three", 7)}
    for block, only in (("<!-- a -->", True), ("<!-- a -->\n <!-- b -->", True), ("<!-- a", False), ("<!-- a --> x", False), ("<!-- a <!-- b -->", False)):
        assert one(spark, books.comment_only(F.col("t")), t=block) is only, block


def test_xhtml(spark):
    html = """<html><head><title>no</title></head><body><h2>Top <em>it</em></h2><h3>Under</h3><p>One &amp; <b>two </b>three<sup><a href="#n1">1</a></sup>
    <a href="http://x.y/">out</a> <a href="ch2.xhtml">in</a><ul><li>a<ul><li>b</ul><li>c</ul><ol><li>x<li>y</ol>
    <table><tr><th>H|1<th>H2<tr><td>1</table><blockquote>q<br/>r</blockquote><pre>a ``` b
 c</pre><p># not a heading <math alttext="x^2"><mi>x</mi></math>.</p><aside class="footnote" id="n1"><p>The note.</p></aside><script>var p = "<p>";</script></span></body></html>"""
    docs = spark.createDataFrame([(7, html, None), (8, None, None), (9, "<p>plain", " From nav "), (10, "", None)], "page_id long, html string, toc_title string")
    out = {r["page_id"]: r["markdown"] for r in xhtml.to_markdown(xhtml.page_blocks(docs)).collect()}
    assert out[7] == (
        "# Top *it*\n\n## Under\n\nOne & **two** three[^fn-7-1] [out](http://x.y/) in\n\n- a\n  - b\n- c\n1. x\n2. y\n\n| H\\|1 | H2 |\n| --- | --- |\n| 1 |  |\n\n> q\n> r\n\n````\na ``` b\n c\n````\n\n\\# not a heading $x^2$.\n\n[^fn-7-1]: The note."
    )
    assert out[9] == "# From nav\n\nplain" and out[10] == "# Chapter 10"
    nav = spark.createDataFrame([(1, '<nav><ol><li><a href="a#x"> A  <b>b</b></a><ol><li><a href="b">B</a></li></ol></li><li><a href="a#y">C</a></li></ol></nav><nav><a href="z">Z</a></nav>')], "page_id long, html string")
    assert [(r["entry"], r["depth"], r["parent"], r["label"]) for r in xhtml.navigation(nav).orderBy("entry").collect()] == [(1, 1, None, "A b"), (2, 2, 1, "B"), (3, 1, None, "C")]


def test_placeholders_and_alignment(spark):
    text = "---\na: 1\n---\n# Head `code`\n\nSee [x](http://a/b) and $y$ [^1] <b>bold</b>\n\n[^1]: note\n```\n# in\n```\n$$ z\n$$"
    p = acceptance.protected(spark.createDataFrame([(1, text), (2, "has ⟦PH_000001⟧"), (3, None)], "k long, text string"))
    rows = {r["k"]: r for r in p.withColumn("back", acceptance.restored(F.col("marked"), F.col("marked"), F.col("kept"))).collect()}
    assert rows[1]["back"] == text and "http" not in rows[1]["marked"] and "# in" not in rows[1]["marked"] and rows[2]["marked"] is None and rows[3]["marked"] is None
    swapped = spark.createDataFrame([("⟦PH_000002⟧ ⟦PH_000001⟧", "⟦PH_000001⟧ ⟦PH_000002⟧", ["a", "b"])], "c string, m string, k array<string>")
    assert swapped.select(acceptance.restored(F.col("c"), F.col("m"), F.col("k"))).first()[0] is None
    assert acceptance._put_in("ab ⟦PH_000001⟧cd⟦PH_000002⟧", "hello world") == "hello ⟦PH_000001⟧world⟦PH_000002⟧"
    assert acceptance._put_in("⟦PH_000001⟧", "x") == "⟦PH_000001⟧x"


def test_acceptance_of_candidates(spark):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [("plain words here", "andere Worte hier", True), (long, "x " + long[5:300], False), ("# h\n\na", "a", False), ("short one", "again and again and again and again and", False), ("a", "a<br>", False), ("ha ha ha ha ha ha ha ha", "ho ho ho ho ho ho ho ho", True)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, source string, target string, good boolean")
    df = df.withColumns({"a": acceptance.repetition_profile(F.col("source")), "b": acceptance.repetition_profile(F.col("target"))})
    out = df.select("k", "good", acceptance.accepted(F.col("source"), F.col("target"), F.col("a"), F.col("b"))["accepted"].alias("x")).collect()
    assert {r["k"]: r["x"] for r in out} == {r["k"]: r["good"] for r in out}
    text = "the same sixteen signs and more. " * 2
    assert len(repeated_regions(text)) >= 1 and len(repeated_regions("nothing here comes twice")) == len(repeated_regions("")) == 0

    def plain(source, candidate):
        i = 0
        for c in candidate:
            while i < len(source) and source[i] < c - 0.25:
                i += 1
            if i >= len(source) or source[i] > c + 0.25:
                return False
            i += 1
        return True

    for s, c in (([], []), ([], [0.1]), ([0.1], []), ([0.1, 0.5], [0.3, 0.4]), ([0.1, 0.9], [0.3, 0.4]), ([0.2, 0.25, 0.9], [0.2, 0.3, 0.95]), ([0.9], [0.5])):
        got = spark.createDataFrame([(s, c)], "s array<double>, c array<double>").select(acceptance.regions_align(F.col("s"), F.col("c"))).first()[0]
        assert got is plain(s, c), (s, c)


def test_answers_with_candidates(spark):
    answers = [(1, '<NER_JSON>[{"source": "A", "translation": "B", "category": "PERSON"}, {"source": "a", "translation": "C"}]</NER_JSON> [9]'), (2, 'text {"x": 1 then {"items": [{"term": "T}", "target": "U"},]}'), (3, "none"), (4, None), (5, '```json\n[1, {"name": "N", "target_term": "M", "type": "ufo"}]```')]
    out = sorted(map(tuple, acceptance.term_candidates(spark.createDataFrame(answers, "key long, answer string")).select("key", "source", "translation", "category").collect()))
    assert out == [(1, "A", "B", "person"), (2, "T}", "U", "other"), (5, "N", "M", "other")]


def test_names_and_values(spark):
    check = lambda c, expected, **v: assert_equal(one(spark, c, **v), expected)

    def assert_equal(a, b):
        assert a == b, (a, b)

    t = F.col("t")
    check(N.safe_slug(t), "a b c", t=' a:/b\t\n"c ')
    check(N.safe_slug(t), "untitled", t="???")
    check(N.safe_filename(t), "Deep_Learning", t="._Deep Learning._")
    check(N.url_stem(t), "Book_2024", t="Book (2024)")
    check(N.directory_key(t), "stra\u00dfe".casefold() + "\u00e9", t="STRASSE" + "e\u0301")
    check(N.project_slug(t), "ABC_x_1", t="ＡＢＣ: x//1 _")
    check(N.project_slug(t), None, t=" ._- ")
    check(N.normalised_text(t), "a\n\nb", t=" a \x00 \n\n\n\nb  \n")
    check(N.excerpt(t, F.lit(150), F.lit(160), 20), "…" + "x" * 20 + "…", t="x" * 300)
    check(N.excerpt(t, F.lit(0), F.lit(1), 20), "ab", t=" ab ")
    check(N.signed_pages(t, F.lit(5)), [5, 1, 2, 3], t="-1, 1-3,5")
    for bad in ("0", "6", "3-1", "x", "", "1,,2"):
        check(N.signed_pages(t, F.lit(5)), None, t=bad)
    check(N.fence_for(t), "`````", t="a ```` b ` c")
    check(N.sentence_cut(t, 5), "One. Two.", t="One. Two. Three.")
    check(N.word_boundary(t, F.lit(7)), 6, t="hello world")
    check(N.word_boundary(t, F.lit(9)), 11, t="hello world")
    check(P.resolve(F.lit("OPS/t/a.html"), t), "OPS/b c.html", t="../b%20c.html#f")
    check(P.resolve(F.lit("a.html"), t), "a.html", t="#f")
    check(P.rewrite_references(t, "m"), "![x](m/a.png) [y](http://z) <img src='m/b.png'> [r](#f)", t="![x](a.png) [y](http://z) <img src='b.png'> [r](#f)")
    check(P.escapes_root(F.lit("OPS/a.css"), t), True, t="../../x")
    check(P.escapes_root(F.lit("OPS/a.css"), t), False, t="../x")
    check(P.srcset_urls(t), ["a.png", "data:x,y", "b.png"], t=" a.png 1x , data:x,y 2x, b.png")
    check(P.home_relative(t, "/home/me"), "~/x", t="/home/me/x")


def test_coverage_and_batches(spark):
    for p, n, up, status in (([1, 2, 3], 3, False, "local_complete"), ([1, 3], 3, True, "uploaded_partial"), ([1, 1], 3, False, None), ([], 3, False, None), ([0, 1], 3, False, None), ([4], 3, False, None), ([3, 2], 3, True, None), ([2], 2, False, "local_partial"), ([1], 1, True, "completed")):
        df = spark.createDataFrame([(p, n, up)], "p array<int>, n int, up boolean")
        assert df.select(stores.coverage(F.col("p"), F.col("n"), F.col("up"))).first()[0] == status, (p, n)
    items = spark.createDataFrame([(k * 40_000, "vlm", 450) for k in range(5)] + [(3, "html", 10)], "k long, model string, pages int")
    out = stores.parts_in_batches(items, 200, 4).orderBy("model", "k", "part").collect()
    assert [r["batch"] for r in out] == [0] + [k // 4 for k in range(15)] and [r["pages"] for r in out[1:4]] == [200, 200, 50]


def test_bounded_units_keep_their_promise(spark):
    out = books.bounded_units(spark, SF)
    assert out.where("NOT whole OR (largest > 600 AND NOT fenced)").count() == 0
    assert re.match("# ", xhtml.chapter_markdown(spark, SF).first()["first_line"])
