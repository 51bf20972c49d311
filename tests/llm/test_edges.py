"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, exact_dedup, language, licenses, packing, pii, quality, simhash, toxicity, url_filter
from quillspark.llm.components import connected_components

CLASHES = "doc_id long, text string, lang string, source string, n_chars long, fp long, norm string, n long, score double, label string, kept boolean, salt int, pos int, sha string, new string, x double, row string, key long, _dropped long, keep_id long, points long"
LONG = "lorem ipsum dolor " * 30_000 + "z" * 200_000


@pytest.fixture(scope="module")
def odd(spark):
    rest = (None,) * 16
    texts = [(1, "some words are here today"), (1, "some words are here today"), (2, None), (3, ""), (4, " \t\n"), (None, "some words  are here today"), (5, LONG), (6, "日本語 テキスト"), (7, "1234 !!!"), (None, None)]
    return spark.createDataFrame([(i, t, "en", None, None, *rest) for i, t in texts], CLASHES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHES)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "some words are here today"), (2, None), (3, ""), (4, "too short"), (None, "no item id is in here at all")], "item_id long, text string")


def test_pii(odd, empty):
    out = pii.surrogate_texts(odd, "k")
    assert out.count() == 10 and out.where("n_entities > 0").count() == 0
    assert out.where("text is null").count() == 2
    assert pii.surrogate_texts(empty, "k").count() == 0
    mine = odd.withColumn("text", F.when(F.col("text").isNull(), None).otherwise(F.concat("text", F.lit(" mail a.b@c.org or 10.0.0.1"))))
    rows = pii.surrogate_texts(mine, "k").collect()
    assert len(rows) == 10 and sum(r["n_entities"] == 2 for r in rows) == 8 and not any("a.b@c.org" in (r["text"] or "") for r in rows)
    assert len({r["text"] for r in rows if r["doc_id"] == 1}) == 1


def test_licenses(odd, empty):
    assert licenses.license_spans(odd).count() == 0
    assert licenses.license_spans(empty).count() == 0
    mine = odd.withColumn("text", F.when(F.col("text").isNull(), None).otherwise(F.concat("text", F.lit(" released under the MIT License"))))
    rows = licenses.license_spans(mine).where("license = 'MIT'").collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 1, 3, 4, 5, 6, 7] and len({r["start"] for r in rows if r["doc_id"] == 1}) == 1


def test_packing(odd, empty):
    out = packing.pack_documents(odd).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 5, 6, 7, None}
    assert sum(r["piece"] == 0 for r in out) == 10
    assert all(0 < r["length"] <= 2048 for r in out)
    assert packing.pack_documents(empty).count() == 0


def test_language(odd, empty):
    out = language.identify(odd, language.train(odd)).collect()
    assert len(out) == 10
    assert {r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 4, 7)} == {"und"}
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 5, 6)} <= {"en", "und"}
    assert language.identify(empty, language.train(empty)).count() == 0
    assert language.fit([]) is None


def test_exact(odd, empty):
    out = exact_dedup.exact_duplicates(odd).collect()
    assert len(out) == 10
    same = [r for r in out if r["group_size"] == 3]
    assert len(same) == 3 and {r["keep_id"] for r in same} == {None} and sum(r["kept"] for r in same) == 1
    blank = [r for r in out if r["group_size"] == 4]
    assert len(blank) == 4 and {r["keep_id"] for r in blank} == {4}
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_exact_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(3, "a b")] * 4 + [(2, "ab")] * 2 + [(9, "ab c")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(rows).collect())) == [(3, "a b"), (9, "ab c")]
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(rows, rows_per_salt=1).collect()} == {(3, 3, 6, True), (2, 3, 6, False), (9, 9, 1, True)}
    assert exact_dedup.exact_duplicates(rows, broadcast_rows=0).count() == 7


def test_quality(odd, empty, labels):
    out = quality.quality_scores(odd, labels).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(odd, labels.where("false")).where("score = 0.5").count() == 10


def test_simhash(odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == 10
    assert {r["component_id"] for r in out if r["doc_id"] == 1} == {1}
    assert {(r["fp"], r["component_id"]) for r in out if r["doc_id"] in (2, 3, 4)} == {(0, 2)}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4)").count() == 0 and kept.where("doc_id = 2").count() == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_toxicity(odd, empty, labels):
    out = toxicity.score_documents(odd, toxicity.train(odd, labels)).collect()
    assert len(out) == 10 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out if r["doc_id"] in (2, 3, 4)} == {0.0}
    assert toxicity.score_documents(empty, None).count() == 0 and toxicity.drop_toxic(empty, None).count() == 0
    assert toxicity.drop_toxic(odd, None).count() == 10
    assert toxicity.train(odd, labels.where("false")) is None


def test_urls(spark, labels):
    urls = [(1, None), (2, "no scheme"), (3, "http://"), (3, "http://A.Example.com/en/7x?q#f"), (4, "https://x.org"), (None, "http://b.net/de/8"), (5, "ftp://h?x"), (6, "http://example.com/en/8#t")]
    pages = spark.createDataFrame([(i, u, "h", 0.5) for i, u in urls], "page_id long, url string, host string, bad_rate double")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    out = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_pages(pages, outcomes).collect()}
    assert (3, "a.example.com", "/en/7x", "example.com/en/7", "allow") in out and (None, "b.net", "/de/8", "net/de/", "block") in out
    assert (6, "example.com", "/en/8", "com/en/", "block") in out and (5, "h", "", None, "block") not in out
    assert {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "x.org", "", None, "allow"), (5, "h", "", None, "allow")} <= out
    assert url_filter.judge_pages(pages.where("false"), outcomes).count() == 0
    assert url_filter.judge_pages(pages, outcomes.where("false")).where("verdict = 'allow'").count() == 6


def test_decontamination(odd, empty, benchmark):
    out = decontamination.contaminated_passages(odd, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["distance"], r["start"]) for r in out) == [(0, 1, 0, 0), (1, 1, 0, 0), (1, 1, 0, 0)]
    clean = decontamination.decontaminate(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == 7
    assert decontamination.contaminated_passages(odd, benchmark.where("false")).count() == 0
    assert decontamination.decontaminate(empty, benchmark).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 1), (7, 6), (6, 5)] + [(k, k + 1) for k in range(100, 160)], "a long, b long").repartition(7)
    out = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert out == {2: 1, 3: 1, 5: 4, 6: 4, 7: 4} | {k: 100 for k in range(101, 161)}
    assert connected_components(edges.where("false")).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, empty and very long texts go through all stages; so do tables without rows."""
    import corpus_pipeline

    rest = (None,) * 16
    rows = [(1, "some words are here today", "en", None, None, *rest)] * 2 + [(i, t, None, None, None, *rest) for i, t in ((2, None), (3, ""), (5, LONG), (6, "日本語 テキスト"), (None, "quite other words than those are here"))]
    docs, tables = spark.createDataFrame(rows, CLASHES), {}
    tables["labels"] = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    tables["benchmark"] = spark.createDataFrame([(1, "no such passage is in any of these texts"), (2, None)], "item_id long, text string")
    for name, of in (("full", docs), ("none", docs.where("false"))):
        of.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t, df in tables.items():
            (df if name == "full" else df.where("false")).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"] for r in out if r["piece"] == 0} >= {1, 6, None} and len([r for r in out if r["doc_id"] == 1]) == 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_on_empty_tables(spark, tmp_path):
    """Every query of this subpackage gives no row, and its columns, from tables without rows."""
    from conftest import SF

    from quillspark.llm.common import table
    from quillspark.llm.queries import queries

    for t in ("documents", "labels", "pages", "benchmark"):
        table(spark, SF, t).where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in queries().items():
        out = query(spark, str(tmp_path))
        assert out.columns and out.count() == 0, name


@pytest.mark.parametrize("outcomes", [0, 1, 3, 300])
def test_urls_little_known(spark, outcomes):
    """Hosts of which nothing is known are allowed however few outcomes there are; a host that is bad throughout is blocked once there are enough."""
    pages = spark.createDataFrame([(k, f"http://{h}/x") for k, h in enumerate(["bad.com"] * 300 + ["good.org", "new.net", "fine.co", "sub.bad.com"])], "page_id long, url string")
    bad = spark.createDataFrame([(k, 1) for k in range(outcomes)] + [(300, 0)] * (outcomes > 1), "page_id long, bad int")
    out = {r["host"]: r["verdict"] for r in url_filter.judge_pages(pages, bad).collect()}
    assert {out[h] for h in ("good.org", "new.net", "fine.co")} == {"allow"}
    assert out["bad.com"] == ("block" if outcomes == 300 else "allow")


def test_urls_without_spread(spark):
    """Three outcomes of two hosts are no evidence that all hosts are alike."""
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.com/"), (3, "http://b.org/"), (4, "http://new.net/"), (5, "http://fine.co/")], "page_id long, url string")
    bad = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "page_id long, bad int")
    rows = url_filter.judge_pages(pages, bad).collect()
    assert {r["verdict"] for r in rows} == {"allow"} and all(r["bad_rate_low"] < 0.5 for r in rows)
