"""Folds and text functions against plain Python, at the edges."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.chunking import byte_groups, chunk_text
from quillspark.operators.library import depth_and_root, pivot_eav, unpivot_eav
from quillspark.operators.retrieval import bm25, fuse, nearest
from quillspark.operators.state import merge
from quillspark.operators.structure import pages_of, parents
from quillspark.operators.translation import protect, restore, token_chunks


def chunks_in_python(text, size, overlap, separator="\n\n"):
    done, cur = [], ""
    for p in (x.strip(" \t\r\n") for x in text.split(separator)):
        if not p:
            continue
        if len(p) > size:
            done += [cur] if cur else []
            done += [p[i : i + size] for i in range(0, len(p), size - overlap)]
            cur = ""
        elif len(cur) + len(p) + 2 <= size:
            cur = f"{cur}\n\n{p}" if cur else p
        else:
            done += [cur] if cur else []
            cur = p
    done += [cur] if cur else []
    return [c if i == 0 else done[i - 1][-overlap:] + c for i, c in enumerate(done)]


TEXTS = ["", " ", "a", "a\n\nb", "x" * 3999, "x" * 4000, "x" * 4001, "y" * 7700, "z" * 8000, "a\n\n" + "b" * 3995 + "\n\nc", "p" * 3990 + "\n\n" + "q" * 5000 + "\n\nr", "é" * 4100, "a😀b\n\n" * 900]


def test_chunk_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    for r in rows.select("t", chunk_text(F.col("t")).alias("c")).collect():
        assert r["c"] == chunks_in_python(r["t"] or "", 4000, 300)


def test_byte_groups(spark):
    units = ["a" * 30, "b" * 30, "é" * 30, "c" * 200, "d", "e" * 99, "f"]
    got = spark.range(1).select(byte_groups(F.array(*map(F.lit, units)), 100).alias("g")).first()["g"]
    assert [u for g in got for u in g] == units
    assert all(len(g) == 1 or sum(len(u.encode()) for u in g) <= 100 for g in got)
    assert got == [["a" * 30, "b" * 30], ["é" * 30], ["c" * 200], ["d", "e" * 99], ["f"]]


def test_text_functions(spark):
    rows = spark.createDataFrame([(" A  b\t\nc ", "A-b_C d!", "circa 1985, revised", "x2021y", "日本 a")], "s string, t string, d string, e string, c string")
    r = rows.select(
        T.collapse(F.col("s")).alias("collapsed"), T.title_key(F.col("t")).alias("key"), T.slug(F.col("t")).alias("slug"), T.slug(F.lit("日本")).alias("bare"), T.bibliographic_year(F.col("d")).alias("year"),
        T.bibliographic_year(F.col("e")).alias("none"), T.attachment_year(F.col("e")).alias("loose"), T.cjk_ratio(F.col("c")).alias("cjk"), T.cjk_ratio(F.lit("")).alias("empty"), T.truncate(F.lit("abc  def"), 5).alias("cut"), T.like_escape(F.lit("100% a_b")).alias("like"),
    ).first()
    assert (r.collapsed, r.key, r.slug, len(r.bare), r.year, r.none, r.loose, round(r.cjk, 4), r.empty, r.cut, r.like) == ("A b c", "ab_cd", "a-b-c-d", 12, 1985, None, "2021", 0.6667, 0.0, "abc...", r"100\% a\_b")


def test_trees(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent string")
    most = (1 << 63) - 1  # nodes on or below a cycle or a missing parent have a row too
    assert sorted(map(tuple, depth_and_root(nodes).collect()), key=str) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", None, most), ("y", None, most), ("z", None, most)]
    heads = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 4, 3, 2, 1, 3])], "doc_id long, line_no long, level long")
    assert [r["parent_line"] for r in parents(heads).orderBy("line_no").collect()] == [None, 0, 1, 1, 0, None, 5]


def test_eav_round_trip(spark):
    items = spark.createDataFrame([(1, "t", None), (2, None, "v")], "id long, title string, venue string")
    assert sorted(map(tuple, pivot_eav(unpivot_eav(items, "id", ["title", "venue"]), ["title", "venue"]).collect())) == [(1, "t", None), (2, None, "v")]


def test_pages(spark):
    rows = spark.createDataFrame([("1,3-5", 4), ("2-2,2", 9), ("9", 3)], "s string, n int")
    assert [r[0] for r in rows.select(pages_of(F.col("s"), F.col("n"))).collect()] == [[1, 3, 4], [2], []]


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, made string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "k long, v string, made string")
    assert sorted(map(tuple, merge(old, new, ["k"], kept=("made",), filled=("v",)).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "w")]
    assert sorted(map(tuple, merge(old, new, ["k"]).collect()), key=str) == [(1, "a", "x"), (2, None, "z"), (3, "c", "w")]


def test_protect_and_restore(spark):
    rows = spark.createDataFrame([("see https://a.b/c and x@y.z 1234567 end",), ("plain",), ("",), ("`code` 999999",)], "t string")
    marked, kept = protect(F.col("t"))
    out = rows.select("t", marked.alias("m"), kept.alias("k")).select("t", "m", "k", restore(F.col("m"), F.col("k")).alias("r"), restore(F.lit("⟦PH_000002⟧"), F.col("k")).alias("bad"))
    for r in out.collect():
        assert r["r"] == r["t"] and r["bad"] is None
    assert out.first()["m"] == "see ⟦PH_000001⟧ and ⟦PH_000002⟧ ⟦PH_000003⟧ end"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!é\n", max_size=80), min_size=1, max_size=6))
def test_token_chunks(spark, texts):
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_chunks(F.col("t"), 16).alias("c")).collect():
        assert "".join(r["c"]) == r["t"]
        assert all(len(c.encode()) <= 16 or not re.search(r"\s\S", c) for c in r["c"])


def test_nearest_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 5)).astype(np.float32)
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    got = nearest(rows, rows.where("vec_id % 50 = 0 or vec_id = 3"), 6, block=2).orderBy("query_id", "rank").collect()
    for q in (0, 3, 50, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        assert [r["key"] for r in got if r["query_id"] == q] == np.lexsort((np.arange(120), d.round(9)))[:6].tolist()
    assert nearest(rows, rows.where("vec_id < 0"), 3).count() == 0


def test_keyword_and_fusion(spark):
    items = spark.createDataFrame([(1, "Exact Term", "body"), (2, "other", "exact term exact term"), (3, "none", "nothing"), (4, None, None)], "key long, title string, abstract string")
    got = bm25(items, spark.createDataFrame([(9, "exact term"), (8, "absent")], "query_id long, literal string"), 5)
    assert [(r["query_id"], r["key"]) for r in got.orderBy("rank").collect()] == [(9, 1), (9, 2)]
    vector = spark.createDataFrame([(9, 3, 0.1, 1), (9, 1, 0.2, 2)], "query_id long, key long, distance double, rank long")
    fused = fuse(vector, got, 3).orderBy("rank").collect()
    assert [r["key"] for r in fused] == [1, 3, 2]
    assert fused[0]["rrf"] == pytest.approx(1 / 62 + 1 / 61)


# --- retrieval, merges, trees, copies ---------------------------------------


def test_nearest_with_ties_nulls_and_ragged_vectors(spark):
    from quillspark.operators.retrieval import nearest

    rows = [(k, [1.0, 2.0]) for k in range(500)] + [(600, None), (601, [1.0, None]), (602, [1.0, 2.0, 3.0]), (603, []), (None, [1.0, 2.0]), (604, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    out = nearest(v, v.where("vec_id IN (7, 600, 602, 604)"), 5).collect()
    of = lambda q: sorted((r["rank"], r["key"]) for r in out if r["query_id"] == q)
    assert of(7) == [(k + 1, k) for k in range(5)] and of(600) == [] and of(602) == [(1, 602)]
    assert of(604) == [(1, 604)] + [(k + 2, k) for k in range(4)]


def test_merge_keeps_rows_with_a_null_key(spark):
    from quillspark.operators.state import merge

    old = spark.createDataFrame([(None, "a"), (1, "c")], "k int, v string")
    new = spark.createDataFrame([(None, "b"), (2, None)], "k int, v string")
    assert sorted(merge(old, new, ["k"]).collect(), key=str) == sorted([(1, "c"), (2, None), (None, "b")], key=str)
    assert merge(old.where("false"), new, ["k"]).where("k IS NULL").first()["v"] == "b"
    assert merge(old, new, ["k"], kept=("v",)).where("k IS NULL").first()["v"] == "a"


def test_depth_of_long_chains_cycles_and_orphans(spark):
    from quillspark.operators.library import depth_and_root

    rows = [("n0", None)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 300)] + [("a", "b"), ("b", "c"), ("c", "a"), ("below", "a"), ("orphan", "gone"), ("child", "orphan")]
    out = {r["id"]: (r["root"], r["depth"]) for r in depth_and_root(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert all(out[f"n{k}"] == ("n0", k) for k in range(300))
    assert all(out[x] == (None, (1 << 63) - 1) for x in ("a", "b", "c", "below", "orphan", "child"))


def test_copied_spans_wherever_they_are(spark):
    from quillspark.operators.translation import copied_spans

    passage = " ".join(f"word{k}" for k in range(100))
    docs = {1: "x" * 33 + passage[217 : 217 + 160] + "y" * 50, 2: passage[217 : 217 + 159] + "#" + passage[377:400], 3: passage[:40], 4: None, 5: passage[300:500]}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(9, passage), (10, "short"), (11, None)], "item_id long, text string")
    assert sorted(map(tuple, copied_spans(d, b).collect())) == [(1, 9), (5, 9)]


def test_next_in_a_group_that_is_cut(spark):
    from quillspark.operators.text_metrics import next_in_group

    rows = spark.createDataFrame([("a", k) for k in (0, 3, 4, 9, 25, 26)] + [("b", 7), (None, 1), (None, 30)], "source string, doc_id long")
    out = sorted(map(str, (tuple(r) for r in next_in_group(rows, "source", "doc_id", span=5).where("following IS NOT NULL").collect())))
    assert out == sorted(map(str, [("a", 0, 3), ("a", 3, 4), ("a", 4, 9), ("a", 9, 25), ("a", 25, 26), (None, 1, 30)]))
