"""Small rows on which queries once gave other rows than their SQL."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF, TABLES, assert_same
from quillspark import catalogue  # noqa: F401
from pyspark.sql import functions as F
from quillspark.functions.slices import by_slices, slices
from quillspark.operators import pages, retrieval, translation, trigram_index, xhtml
from quillspark.registry import ORACLES, QUERIES
from quillspark.sources.shared import shared_dir


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables into a folder; those that are not written are empty."""

    def write(**tables) -> str:
        for name in TABLES:
            df = tables.get(name)
            pq.write_table((spark.range(0) if df is None else df).toArrow(), f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def same(spark, sf: str, name: str) -> None:
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_outline_keeps_references(spark, folder):
    page = "<html><head><script>x</script></head><body><nav><ul><li><a href='/a'>a</a></li></ul></nav><h1>{}</h1><p>{}</p></body></html>"
    rows = [(1, page.format("cut &amp;&amp", "x")), (2, page.format("a = &quot;b", "&copy; y")), (3, page.format("a &amp;amp; b &#39;c", "© z")), (4, page.format("plain &lt;b&gt;", "&copy z"))]
    same(spark, folder(pages=spark.createDataFrame(rows, "page_id long, html string")), "chapter_outline")


def test_whole_messages_are_redacted(spark, folder):
    rows = [(1, 1, "short"), (1, 2, "word " * 500 + "end")]
    same(spark, folder(conversations=spark.createDataFrame(rows, "conv_id long, turn long, text string")), "error_redaction")


def test_pages_end_as_written(spark, folder):
    """A blank before a carriage return stays; numbers go from heads only where three characters are left."""
    rows = [(1, "one. two \r"), (2, "one. two \n \n"), (3, "12 ab. ab 12. a - 5. a b - 5. xiv. ... . 𝐀𝐁 7. " * 40)]
    for name in ("pages_without_heads", "running_heads", "page_edges"):
        same(spark, folder(documents=spark.createDataFrame(rows, "doc_id long, text string")), name)


def test_heads_are_taken_once(spark):
    """Each step of a head names the one before once, and of the lines of pages the edges are taken before they are joined."""
    plan = spark.createDataFrame([("x",)], "line string").select(pages.head_key(F.col("line")).alias("head"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 6
    assert "Window" not in QUERIES["pages_without_heads"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def broadcasts(spark, run) -> int:
    """How many broadcasts the plans of everything that `run` executes hold, as Spark's own store of executions has them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    run()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsList().size())]
    return sum("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("name", ["index_sync", "index_full_sync", "note_contract"])
def test_large_sides_are_not_broadcast(spark, name):
    assert broadcasts(spark, lambda: QUERIES[name](spark, SF).collect()) == 0


def test_equal_searches_run_once(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"a title {k % 3}", "some text of it") for k in range(20)], "key long, title string, abstract string")
    asked = spark.createDataFrame([(1, "Title 1"), (2, "title 1"), (3, "text"), (4, "title 1")], "query_id long, literal string")
    counted = []
    plain = retrieval.keyword_hits
    monkeypatch.setattr(retrieval, "keyword_hits", lambda rows, queries, *a: counted.append(queries.count()) or plain(rows, queries, *a))
    out = {}
    for r in retrieval.bm25(items, asked, 4).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["key"], r["score"], r["rank"]))
    assert counted == [2] and sorted(out) == [1, 2, 3, 4] and out[1] == out[2] == out[4] and len(out[1]) == len(out[3]) == 4
    v = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(10)], "vec_id long, embedding array<float>")
    ids, near = [], retrieval._nearest
    monkeypatch.setattr(retrieval, "_nearest", lambda i, *a: ids.append(i) or near(i, *a))
    found = retrieval.nearest(v, v, 2).collect()
    assert sum(map(len, ids)) == 5 and len(found) == 20 and {r["key"] for r in found if r["query_id"] == 7} == {2, 7}


def test_short_searches_keep_the_best_of_a_task(spark):
    rows = spark.createDataFrame([(k, "ab" if k % 7 == 0 else "x", "", "", "ab b" * (k % 2)) for k in range(200)], "key long, title string, creators string, abstract string, chunk_text string")
    asked = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "b"), (4, "zz")], "query_id long, literal string")
    every, best = retrieval.short_hits(rows, asked).collect(), retrieval.short_hits(rows.repartition(3), asked, k=5).collect()
    want = [(q, k, s, n + 1) for q in (1, 2, 3) for n, (s, k) in enumerate(sorted((r["score"], r["key"]) for r in every if r["query_id"] == q)[:5])]
    assert sorted((r["query_id"], r["key"], r["score"], r["rank"]) for r in best) == want and len(want) == 15


def test_index_searches_equal_literals_once(spark):
    rows = spark.createDataFrame([(k, f"title {k % 4}", "", "", "words " * k) for k in range(40)], "key long, title string, creators string, abstract string, chunk_text string")
    index, one, many = trigram_index.build(rows, 4), [], []
    asked = lambda ids: spark.createDataFrame([(i, "Title 2") for i in ids], "query_id long, literal string")
    trigram_index.search(index, asked([1]), 3, seen=one)
    assert trigram_index.search(index, asked([1, 2, 3]), 3, seen=many).count() == 9 and one == many


def test_repeated_documents_ask_for_context_once(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(k * 50, f"two words {k % 2}\n" + "two words in it\n" * k, "en", "web") for k in range(1, 7)], "doc_id long, text string, lang string, source string")
    counted, plain = [], retrieval.keyword_hits
    monkeypatch.setattr(retrieval, "keyword_hits", lambda rows, queries, *a: counted.append(queries.count()) or plain(rows, queries, *a))
    same(spark, folder(documents=docs), "fulltext_context")
    assert counted == [1]


def test_packages_meet_by_id(spark):
    opf = '<package><metadata><title>T</title></metadata><manifest><item id="a" href="a.x"/><item id="b" href="b%20.x"/><item id="a" href="late.x"/></manifest><spine><itemref idref="b" linear="no"/><itemref idref="gone"/><itemref idref="a"/><itemref idref="b"/></spine></package>'
    rows = xhtml.read_packages(spark.createDataFrame([(1, "O/p.opf", opf), (1, "p.opf", opf)], "book long, path string, opf string")).collect()
    assert sorted(tuple(r) for r in rows) == sorted((1, "T", n, i, base + p, linear) for base in ("O/", "") for n, i, p, linear in ((1, "b", "b .x", "no"), (2, "a", "a.x", "yes"), (3, "b", "b .x", "no")))


def test_overlap_tries_no_length_by_itself(spark):
    texts = ["", None, "a", "aa", "xaa", "aab", "ab" * 500, "b" + "ab" * 450, "é" * 801, "aé", "éa"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    out = rows.select("a", "b", translation.overlap(F.col("a"), F.col("b")).alias("n"))
    for r in out.collect():
        a, b = (r["a"] or "")[-800:], (r["b"] or "")[:800]
        assert r["n"] == max((k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]), default=0)
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_slices_bound_what_python_holds():
    texts = pa.array(["x" * 600_000, "y" * 600_000, None, *["z"] * 1_000, "w" * 3_000_000])
    parts = list(slices(texts))
    assert pa.concat_arrays(parts).equals(texts) and all(len(p) == 1 or p.nbytes <= 1 << 20 and len(p) <= 256 for p in parts) and len(parts) > 5
    assert by_slices(texts, pa.int64(), lambda t: t and len(t)).to_pylist() == [t and len(t) for t in texts.to_pylist()]
    assert len(by_slices(texts.slice(0, 0), pa.int64(), len)) == 0


def written(spark) -> int:
    """Rows of the intermediate tables written so far."""
    top = Path(shared_dir(spark).removeprefix("file://"))
    return sum(pq.read_metadata(p).num_rows for p in top.rglob("part-*.parquet"))


def test_index_search_forms_no_pairs_of_literals_and_blocks(spark):
    """120 literals that each of 100 blocks can hold: what a search writes follows literals and blocks, not their product."""
    words = [f"{a}{b}{c}" for a in "abcd" for b in "efghi" for c in "klmnop"]
    rows = spark.createDataFrame([(k, "", "", "", " ".join(words)) for k in range(400)], "key long, title string, creators string, abstract string, chunk_text string").coalesce(4)
    index, seen = trigram_index.build(rows, 4), []
    asked = spark.createDataFrame(list(enumerate(words)), "query_id long, literal string")
    before = written(spark)
    got = trigram_index.search(index, asked, 3, first=2, seen=seen).collect()
    assert len(got) == 360 and {(r["key"], r["rank"]) for r in got} == {(0, 1), (1, 2), (2, 3)} and seen[0] == 12_000
    assert written(spark) - before < 2_000


def test_index_finds_what_a_plain_count_finds(spark):
    """Hits that overlap, literals within others, long ones that begin alike, signs beyond 16 bits, a row with no key, a text longer than a block; literals in several parts."""
    alike = "x" * trigram_index.PREFIX
    texts = ["aaaaaaa aaa", "abababab", alike + "one " + alike + "two" + alike, "b" + alike + "one", "\U0001f600ab\U0001f600ab\U0001f600", "ABAB " * 7, "", "abc" * 400_000, "tail abab"]
    rows = [(None if k == 8 else k, t[:40] if k % 2 else None, None, "ababa" if k % 3 else "", t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "key long, title string, creators string, abstract string, chunk_text string").coalesce(1)
    literals = ["aaa", "aba", "abab", "bab", alike, alike + "one", alike + "two", alike + "on", "\U0001f600ab", "ab\U0001f600", "cabc", "aaaa", "bababa"]
    folded = [(k, [(x or "").lower() for x in r]) for k, *r in rows]
    length = {k: sum(max(len(x) - 2, 0) for x in r) for k, r in folded}
    mean, want = sum(length.values()) / len(rows), []
    for q, t in enumerate(literals):
        hits = [(k, sum(w * x.count(t) for w, x in zip((8, 4, 2, 1), r, strict=True))) for k, r in folded]
        best = sorted((-round(f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[k] / mean)), 9), -1 if k is None else k) for k, f in hits if f)[:4]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    index = trigram_index.build(frame, 3)
    asked = spark.createDataFrame(list(enumerate(literals)), "query_id long, literal string")
    for first, block in ((1, 100), (4, 3)):
        got = trigram_index.search(index, asked, 4, first=first, block=block).collect()
        assert sorted((r["query_id"], r["rank"], -1 if r["key"] is None else r["key"], round(r["weight"], 9)) for r in got) == want
    assert index.blocks.count() == 4


def test_index_readers_hold_few_blocks(spark):
    """A reader has a row group in memory, so it holds few blocks, however many a file has."""
    rows = spark.createDataFrame([(k, "", "", "", f"words {k}") for k in range(200)], "key long, title string, creators string, abstract string, chunk_text string").coalesce(1)
    index = trigram_index.build(rows, 2)
    groups = [m.row_group(i).num_rows for m in (pq.read_metadata(p.removeprefix("file://")) for p in index.blocks.inputFiles()) for i in range(m.num_row_groups)]
    assert sum(groups) == 100 and max(groups) <= 16
