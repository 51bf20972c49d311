"""Resampling, suffix dedup and ranked search against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, assert_same
from pyspark.sql import functions as F
from test_edges import CLASHES, LONG

from quillspark.llm import ranked_search, resampling, suffix_dedup, words
from quillspark.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, "A", "x" * 70, "Ünï Cödé-ÉÀ 日本語テキスト_z9 q\x00r", "a" * 15 + " " + "b" * 16 + " " + "c" * 17 + " " + "é" * 40, " \t\n", "end", "1234 !!! -", "end"]


@pytest.fixture(scope="module")
def odd(spark):
    rest = (None,) * 16
    texts = [(1, "some words are here today"), (1, "some words are here today"), (2, None), (3, ""), (4, " \t\n"), (None, "some words  are here today"), (5, LONG), (6, "日本語 テキスト"), (7, "1234 !!!"), (None, None)]
    return spark.createDataFrame([(i, t, "en", None, None, *rest) for i, t in texts], CLASHES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHES)


# --- words -------------------------------------------------------------------


@pytest.mark.parametrize("cut", [0, 3])
def test_words_are_those_of_the_pattern(cut):
    w = words.Words.of(pa.array(ODD).slice(cut))
    found = [(int(t), w.data[s:e].tobytes().decode()) for t, s, e in zip(w.text, w.starts, w.ends, strict=True)]
    want = [(i, m) for i, t in enumerate(ODD[cut:]) for m in WORD.findall((t or "").translate(LOW))]
    assert found == want
    assert w.crc32(np.arange(len(want)), np.zeros(len(want), np.uint32)).tolist() == [zlib.crc32(x.encode()) for _, x in want]
    keys = list(map(tuple, w.keys().T.tolist()))
    assert len(set(keys)) == len({x for _, x in want}) and all((a == b) == (x[1] == y[1]) for a, x in zip(keys, want, strict=True) for b, y in zip(keys, want, strict=True))


def test_parts_cover_a_batch_and_stay_small():
    rows = ["x" * n for n in (5, 0, 9, 100, 1, 1, 1, 0)] + [None, "yy"]
    got = list(words.parts(pa.record_batch([pa.array(rows)], names=["t"]), 0, 10))
    assert [x for p in got for x in p.column(0).to_pylist()] == rows
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 10 for p in got)


# --- importance resampling ----------------------------------------------------


def brute_resample(docs, target, percent=10, least=20, longest=1, buckets=10_000, seed="2024"):
    def features(text):
        w = WORD.findall((text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    held = [(i, *features(x)) for i, x in docs]
    for _, _, f in held:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in held:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("setting", [{}, {"longest": 3, "least": 5, "percent": 37, "buckets": 97, "seed": "s"}])
def test_resampling_against_brute_force(spark, setting):
    docs, target = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = sorted((tuple(r) for r in resampling.importance_resample(docs.repartition(5), target, **setting).collect()), key=repr)
    assert got == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], **setting)


def test_resampling_of_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("today some",), (None,), ("",)], "text string")
    got = sorted((tuple(r) for r in resampling.importance_resample(odd, target, least=1, percent=70).collect()), key=repr)
    assert got == brute_resample([(r["doc_id"], r["text"]) for r in odd.collect()], ["today some"], least=1, percent=70)
    assert resampling.importance_resample(odd, target.where("false")).count() == 10
    assert resampling.importance_resample(empty, target).count() == 0


def test_ranks_have_no_gap_and_are_not_made_in_one_task(spark):
    rows = spark.range(5000).select((F.col("id") % 900).alias("doc_id"), F.lit("a b c").alias("text"))
    out = resampling.importance_resample(rows, rows.limit(1), least=1, percent=100)
    got = sorted(((r["rank"], r["score"], r["doc_id"]) for r in out.collect()))
    assert [r[0] for r in got] == list(range(1, 5001))
    assert [r[1:] for r in got] == sorted((r[1:] for r in got), key=lambda x: (-x[0], x[1]))
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


# --- suffix dedup -------------------------------------------------------------


def brute_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return out


def spans_of(df):
    return sorted((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("setting", [{}, {"hot": 1}, {"shard_bytes": 10_000}])
def test_repeats_against_brute_force(spark, setting):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *w) for r, w in zip(rows, brute_repeats([r["text"] for r in rows], 400), strict=True))
    assert sum(w[2] > 0 for w in want) > 20
    assert spans_of(suffix_dedup.without_repeats(docs.repartition(3), **setting)) == want


@pytest.mark.parametrize("hot", [4000, 2])
@pytest.mark.parametrize("length", [1, 2, 7, 40])
def test_repeats_of_small_alphabets(spark, length, hot):
    """Texts of few letters, with runs of one letter and periods, so that nearly everything repeats somewhere in part."""
    rng = random.Random(length)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(90))) for _ in range(25)] + ["a" * 50, "a" * 39, "ab" * 30, "x" + "ab" * 25, "", None, "unique but short", "é" * 25]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted((i, *w) for i, w in enumerate(brute_repeats(texts, length)))
    assert spans_of(suffix_dedup.without_repeats(docs, length=length, hot=hot)) == want


def test_a_passage_in_many_contexts(spark):
    """One passage of many documents, each with other words around it, makes buckets too large for a task."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(20))
    texts = [" ".join(word() for _ in range(rng.randrange(30))) + " " + passage[: rng.choice((len(passage), 100))] + " " + " ".join(word() for _ in range(rng.randrange(30))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted((i, *w) for i, w in enumerate(brute_repeats(texts, 60)))
    assert spans_of(suffix_dedup.without_repeats(docs, length=60, hot=10)) == want


def test_repeats_of_odd_rows(odd, empty):
    got = {(r[0], *r[2:4]) for r in spans_of(suffix_dedup.without_repeats(odd.where("doc_id is not null"), length=20))}
    assert {(1, 25, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0), (6, 0, 0), (7, 0, 0)} < got and len(got) == 7
    assert suffix_dedup.without_repeats(odd, length=20).count() == 10
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    """Segments overlap, so windows across their ends are found."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 256)
    run = suffix_dedup._anchored(50, 12)
    batch = pa.record_batch([pa.array([1]), pa.array([b"k"]), pa.array([text])], names=["doc_id", "key", "text"])
    starts = sorted(x for b in run(iter([batch])) for f, n in zip(b.column(5).to_pylist(), b.column(7).to_pylist(), strict=True) for x in range(f, f + n))
    assert starts == list(range(len(text) - 49))


def test_radix_order_is_that_of_bytes():
    rng = np.random.default_rng(1)
    rows, groups = rng.integers(0, 3, (500, 21)).astype(np.uint8), rng.integers(0, 4, 500)
    rows[100:140] = rows[0]
    order = suffix_dedup.radix_order(groups, rows)
    got = [(int(groups[i]), rows[i].tobytes()) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(500))


# --- ranked search ------------------------------------------------------------


def test_search_against_sql(spark):
    assert_same(ranked_search.op13_ranked_search(spark, SF), ranked_search.OP13_SQL)


def test_search_in_blocks_and_small_shards(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    whole = sorted(map(tuple, ranked_search.op13_ranked_search(spark, SF).collect()))
    assert sorted(map(tuple, ranked_search.rank_documents(docs.repartition(7), items, block_chars=1000, fan_out=3).collect())) == whole


def brute_search(docs, items, k):
    terms = lambda t: ranked_search.TERM.findall((t or "").translate(LOW))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, size = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // max(size, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            scores += [(-s, i is None, i or 0, i)] * (s > 0)
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_search_of_odd_rows_and_ties(spark, odd, empty):
    items = [(1, "words today"), (1, "HERE"), (2, None), (3, ""), (4, "nowhere at all"), (None, "日本語 lorem 1234")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, ranked_search.rank_documents(odd, frame, k=2).collect()), key=repr)
    assert got == brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], items, 2)
    assert ranked_search.rank_documents(empty, frame).count() == 0 and ranked_search.rank_documents(odd, frame.where("false")).count() == 0


def test_search_of_many_equal_scores(spark):
    """Ties by ascending id although the smallest ids lie anywhere."""
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 700)
    docs = [(i, rng.choice(("a b", "b c", "a c d", "d", "a a b"))) for i in ids]
    items = [(1, "a"), (2, "b d"), (3, "c a b"), (4, "d d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ranked_search.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"), k=25, fan_out=4).collect()), key=repr)
    assert got == brute_search(docs, items, 25)


def test_max_tree_opens_few_ranges():
    rng = np.random.default_rng(0)
    n, terms = 20_000, 30
    where = [np.sort(rng.choice(n, rng.integers(50, 4000), replace=False)) for _ in range(terms)]
    term, place = np.repeat(np.arange(terms), [len(w) for w in where]), np.concatenate(where)
    impact = rng.integers(1, 1000, len(place))
    impact[rng.choice(len(place), 200, replace=False)] += 20_000
    tree = ranked_search.MaxTree(n, term, place, impact)
    own, weight = np.arange(0, terms, 3), rng.integers(1, 9000, terms)
    scores = np.zeros(n, np.int64)
    for t in own:
        scores[where[t]] += weight[t] * impact[term == t]
    want = sorted(((int(s), -i) for i, s in enumerate(scores) if s), reverse=True)[:10]
    assert tree.best(own, weight[own], list(range(n)), 10) == [(s, -i) for s, i in want]
    assert tree.opened < n / 16 / 10
