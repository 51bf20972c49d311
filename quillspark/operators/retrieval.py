"""Retrieval: exact nearest vectors, literal keyword search by BM25, and their fusion.

A set of queries runs against all rows in blocks: the queries of a block, bounded in
number, go to every task, each task keeps its best for each of them, and a window over
what is left keeps the best of all. No pair of rows is formed by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import title_key, title_of
from ..registry import query
from ..sources.shared import materialise, prepare
from ..sources.tables import table

RRF = 60
K1, B = 1.2, 0.75
WEIGHTS = {"title": 8.0, "abstract": 2.0}


def _blocks(queries: DataFrame, id_col: str, size: int) -> Iterator[list]:
    """The queries in blocks of about `size` rows."""
    n = 1 + queries.count() // size
    for b in range(n):
        if rows := queries.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == b).orderBy(id_col).collect():
            yield rows


def asked_once(queries: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """Each different `what` of queries (query_id, what) under the least id that asks for it, and (first, query_id) of all that ask.

    Queries that ask for the same have the same answer, so it is found once: rows that are
    repeated do not multiply with the queries that are repeated with them.
    """
    q = queries.select("query_id", what)
    each = materialise(q.groupBy(what).agg(F.min("query_id").alias("query_id")).select("query_id", what), "asked")
    return each, q.join(each.withColumnRenamed("query_id", "first"), what).select("first", "query_id")


def for_all(found: DataFrame, members: DataFrame) -> DataFrame:
    """Answers to the first that asks as answers to all."""
    rest = [c for c in found.columns if c != "query_id"]
    return found.withColumnRenamed("query_id", "first").join(members, "first").select("query_id", *rest)


def _nearest(ids: list[int], vectors: np.ndarray, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            size = (rows**2).sum(axis=1)
            near = size[None] - 2 * vectors @ rows.T
            slack = 1e-9 * (1 + size.max() + (vectors**2).sum(axis=1))  # rounding of the products
            for q, v in enumerate(vectors):
                # all that can be among the k nearest, ties of the last one too
                some = np.flatnonzero(near[q] <= np.partition(near[q], k - 1)[k - 1] + slack[q]) if len(key) > k else np.arange(len(key))
                d = np.concatenate([best[q][0], np.sqrt(((rows[some] - v) ** 2).sum(axis=1))])
                i = np.concatenate([best[q][1], key[some]])
                top = np.lexsort((i, np.round(d, 9)))[:k]
                best[q] = d[top], i[top]
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))], names=["query_id", "key", "distance"]
            )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, key, distance, rank): the k rows of least L2 distance to each query, ties by key. Exact.

    A query meets the vectors of its own dimension; rows whose vector is null, empty or
    holds a null are no neighbours, and as queries have none. k is at least 1.
    """
    prepare(vectors.sparkSession)
    whole = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    rows, out = whole(vectors), None
    each, members = asked_once(whole(queries).select(F.col("id").alias("query_id"), "v"), "v")
    for part in _blocks(each, "query_id", block):
        for dim in sorted({len(r[1]) for r in part}):
            ids, vs = [r[0] for r in part if len(r[1]) == dim], np.array([r[1] for r in part if len(r[1]) == dim], np.float64)
            found = rows.where(F.size("v") == dim).mapInArrow(_nearest(ids, vs, k), "query_id bigint, key bigint, distance double")
            out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id bigint, key bigint, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "key")
    return for_all(out.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k), members)


def _hits(ids: list[int], literals: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, same = ahocorasick.Automaton(), {}
        for i, literal in zip(ids, literals, strict=True):
            same.setdefault(literal, []).append(i)
        for literal in same:
            machine.add_word(literal, literal)
        if same:
            machine.make_automaton()
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for key, title, text, dl in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                title, text = title or "", text or ""
                found = {literal for value in (title, text) for _, literal in machine.iter(value)} if same else set()
                rows += [(i, key, title.count(literal), text.count(literal), dl) for literal in found for i in same[literal]]
            arrays = [*(pa.array([r[c] for r in rows], pa.int64()) for c in range(4)), pa.array([r[4] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "key", "title_hits", "abstract_hits", "dl"])

    return run


def keyword_hits(items: DataFrame, queries: DataFrame, block: int = 4096) -> DataFrame:
    """(query_id, key, title_hits, abstract_hits, dl): occurrences, none overlapping, of each literal (query_id, literal) in items (key, title, abstract, dl), case folded.

    One pass over the texts for each block of literals, all of them looked for at once.
    """
    prepare(items.sparkSession)
    dl = F.col("dl") if "dl" in items.columns else F.lit(0.0)
    rows, out = items.select("key", F.lower("title").alias("title"), F.lower("abstract").alias("abstract"), dl.cast("double").alias("dl")), None
    for part in _blocks(queries.select("query_id", F.lower("literal").alias("literal")).where("literal <> ''"), "query_id", block):
        found = rows.mapInArrow(_hits([r[0] for r in part], [r[1] for r in part]), "query_id bigint, key bigint, title_hits bigint, abstract_hits bigint, dl double")
        out = found if out is None else out.union(found)
    return out if out is not None else items.sparkSession.createDataFrame([], "query_id bigint, key bigint, title_hits bigint, abstract_hits bigint, dl double")


def bm25(items: DataFrame, queries: DataFrame, k: int, among: str | None = None) -> DataFrame:
    """(query_id, key, score, rank) of the k best items for each literal; a smaller score is better, ties by key.

    Lengths are in trigrams; the weights of the fields multiply their hits. `among` is a
    condition on items for those that are ranked; the number of items and their mean length
    are of all. The hits of a literal are counted by a grouped sum and cut to the best
    before they meet, so a literal that is everywhere is no hot group.
    """
    length = (F.greatest(F.length("title") - 2, F.lit(0)) + F.greatest(F.length("abstract") - 2, F.lit(0))).cast("double")
    whole = items.agg(F.count("*").alias("n"), F.avg(length).alias("avgdl")).first()
    some = items.where(among) if among else items
    each, members = asked_once(queries.select("query_id", F.lower("literal").alias("literal")), "literal")
    hits = materialise(keyword_hits(some.withColumn("dl", length), each), "hits")
    df = hits.groupBy("query_id").agg(F.count("*").cast("double").alias("df"))
    n, f = F.lit(float(whole["n"])), F.col("title_hits") * WEIGHTS["title"] + F.col("abstract_hits") * WEIGHTS["abstract"]
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(whole["avgdl"] or 1.0)))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), "key")
    ranked = hits.join(df, "query_id").select("query_id", "key", score.alias("score"))
    return for_all(ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k), members)


def fuse(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: the k best keys of each query.

    Ties go to keys with a keyword score, then to the order of the vector list, then to the key.
    """
    both = vector.select("query_id", "key", F.col("rank").alias("vector_rank"), F.lit(None).cast("bigint").alias("keyword_rank")).union(
        keyword.select("query_id", "key", F.lit(None).cast("bigint").alias("vector_rank"), F.col("rank").alias("keyword_rank"))
    )
    merged = both.groupBy("query_id", "key").agg(F.max("vector_rank").alias("vector_rank"), F.max("keyword_rank").alias("keyword_rank"))
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(RRF)) + F.col(c)), F.lit(0.0))
    merged = merged.withColumn("rrf", share("vector_rank") + share("keyword_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 9)), F.col("keyword_rank").isNull(), F.col("vector_rank").asc_nulls_last(), "key")
    return merged.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the title is the first line, the abstract the text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("key"), title_of(F.col("text")).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("item_type"), F.col("lang").alias("tag"))


def literals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal of each document whose id is divisible by 50: its first two words."""
    d = table(spark, sf_dir, "documents").where("doc_id % 50 = 0")
    return d.select(F.col("doc_id").alias("query_id"), F.substring_index(F.lower(title_of(F.col("text"))), " ", 2).alias("literal")).where(F.length("literal") >= 3)


_ITEMS = "items AS (SELECT doc_id AS key, split_part(text, chr(10), 1) AS title, text AS abstract, source AS item_type, lang AS tag FROM documents)"
_LITERALS = "literals AS (SELECT * FROM (SELECT doc_id AS query_id, array_to_string(string_split(lower(split_part(text, chr(10), 1)), ' ')[1:2], ' ') AS literal FROM documents WHERE doc_id % 50 = 0) WHERE length(literal) >= 3)"
_VEC = """vec AS (
  SELECT query_id, key, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), key) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS key, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0))"""
_KW = """sized AS (SELECT key, title, abstract, (greatest(length(title) - 2, 0) + greatest(length(abstract) - 2, 0))::DOUBLE AS dl FROM items),
whole AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM sized),
hits AS (
  SELECT query_id, key, dl, (length(lower(title)) - length(replace(lower(title), literal, ''))) / length(literal) AS th,
         (length(lower(abstract)) - length(replace(lower(abstract), literal, ''))) / length(literal) AS ah
  FROM literals, sized WHERE contains(lower(abstract), literal) OR contains(lower(title), literal)),
f AS (SELECT query_id, key, dl, th * 8.0::DOUBLE + ah * 2.0::DOUBLE AS f, count(*) OVER (PARTITION BY query_id)::DOUBLE AS df FROM hits),
kws AS (SELECT query_id, key, -greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score FROM f, whole),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), key) AS rank FROM kws)"""


def _vector_pool(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 50 = 0"), k)


@query("knn_l2_topk", f"WITH {_VEC} SELECT query_id, key, round(distance, 6) AS distance, rank FROM vec WHERE rank <= 10")
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 50."""
    return _vector_pool(spark, sf_dir, 10).select("query_id", "key", F.round("distance", 6).alias("distance"), "rank")


@query("keyword_bm25_topk", f"WITH {_ITEMS}, {_LITERALS}, {_KW} SELECT query_id, key, round(score, 6) AS score, rank FROM kw WHERE rank <= 10")
def keyword_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items for each literal."""
    return bm25(items_of(spark, sf_dir), literals_of(spark, sf_dir), 10).select("query_id", "key", F.round("score", 6).alias("score"), "rank")


_RRF = """pool AS (SELECT query_id, key, rank AS vector_rank, NULL::BIGINT AS keyword_rank FROM vec WHERE rank <= 50
  UNION ALL SELECT query_id, key, NULL, rank FROM kw WHERE rank <= 50),
merged AS (SELECT query_id, key, max(vector_rank) AS vector_rank, max(keyword_rank) AS keyword_rank FROM pool GROUP BY query_id, key),
scored AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS rrf FROM merged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, keyword_rank IS NULL, vector_rank ASC NULLS LAST, key) AS rank FROM scored)"""


@query("rrf_hybrid", f"WITH {_ITEMS}, {_LITERALS}, {_VEC}, {_KW}, {_RRF} SELECT query_id, key, coalesce(vector_rank, 0) AS vector_rank, coalesce(keyword_rank, 0) AS keyword_rank, round(rrf, 9) AS rrf, rank FROM ranked WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: fifty of either channel, fused, ten kept, for each query."""
    out = fuse(_vector_pool(spark, sf_dir, 50), bm25(items_of(spark, sf_dir), literals_of(spark, sf_dir), 50), 10)
    return out.select("query_id", "key", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("vector_rank", "keyword_rank")), F.round("rrf", 9).alias("rrf"), "rank")


@query(
    "hybrid_filtered",
    f"""WITH {_ITEMS}, {_LITERALS}, {_VEC.replace("FROM embeddings q, embeddings v WHERE", "FROM embeddings q, embeddings v JOIN documents d ON d.doc_id = v.vec_id AND d.lang = 'en' WHERE")},
    {_KW.replace("FROM literals, sized WHERE (", "(").replace("FROM literals, sized WHERE contains(lower(abstract), literal) OR contains(lower(title), literal)", "FROM literals, sized JOIN items i USING (key) WHERE i.tag = 'en' AND (contains(lower(sized.abstract), literal) OR contains(lower(sized.title), literal))").replace("lower(title)", "lower(sized.title)").replace("lower(abstract)", "lower(sized.abstract)")}, {_RRF}
    SELECT query_id, key, round(rrf, 9) AS rrf, rank FROM ranked WHERE rank <= 10""",
)
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search among the items of one tag: the filter comes before either channel ranks."""
    items, e = items_of(spark, sf_dir), table(spark, sf_dir, "embeddings")
    allowed = items.where("tag = 'en'").select("key")
    vector = nearest(e.join(allowed, F.col("vec_id") == F.col("key"), "left_semi"), e.where("vec_id % 50 = 0"), 50)
    ranked = bm25(items, literals_of(spark, sf_dir), 50, among="tag = 'en'")
    return fuse(vector, ranked, 10).select("query_id", "key", F.round("rrf", 9).alias("rrf"), "rank")


@query(
    "parent_best_distance",
    f"""WITH {_VEC} SELECT query_id, parent, round(min(distance), 6) AS distance, arg_min(key, (round(distance, 9), key)) AS best_key
    FROM (SELECT query_id, key, distance, key // 4 AS parent FROM vec WHERE rank <= 50) GROUP BY query_id, parent""",
)
def parent_best_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunk of each parent in a pool of fifty; four chunks in a row share a parent."""
    pool = _vector_pool(spark, sf_dir, 50).withColumn("parent", F.floor(F.col("key") / 4).cast("bigint"))
    best = F.min(F.struct(F.round("distance", 9).alias("d"), F.col("key").alias("k"), F.col("distance")))
    return pool.groupBy("query_id", "parent").agg(best.alias("b")).select("query_id", "parent", F.round("b.distance", 6).alias("distance"), F.col("b.k").alias("best_key"))


@query(
    "keyword_short",
    """SELECT doc_id AS key, -(CASE WHEN contains(lower(split_part(text, chr(10), 1)), 'ñl') THEN 8.0 ELSE 0.0 END + CASE WHEN contains(lower(text), 'ñl') THEN 2.0 ELSE 0.0 END)::DOUBLE AS score
    FROM documents WHERE contains(lower(text), 'ñl')""",
)
def keyword_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of under three characters: minus the weights of the fields that hold them."""
    has = lambda c: F.contains(F.lower(c), F.lit("ñl"))
    score = -(F.when(has(F.col("title")), WEIGHTS["title"]).otherwise(0.0) + F.when(has(F.col("abstract")), WEIGHTS["abstract"]).otherwise(0.0))
    return items_of(spark, sf_dir).where(has(F.col("abstract")) | has(F.col("title"))).select("key", score.alias("score"))


def _short(ids: list[int], literals: list[str], k: int | None) -> Callable:
    """The literals of one or two characters that each row holds: those among its own single characters and pairs. With k a task keeps its k best for each."""
    of = dict(zip(literals, ids, strict=True))

    def made(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, float]] = []
        best: dict[int, list[tuple[float, int]]] = {i: [] for i in ids}
        last: dict[int, tuple[float, int]] = {}
        for batch in batches:
            for key, *fields in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                score: dict[str, float] = {}
                for text, w in zip(fields, _SHORT.values(), strict=True):
                    for literal in of.keys() & {*text, *map("".join, pairwise(text))}:
                        score[literal] = score.get(literal, 0.0) - w
                if k is None:
                    rows += [(of[t], key, s) for t, s in score.items()]
                    if len(rows) > 50_000:
                        yield made(rows)
                        rows.clear()
                    continue
                for t, s in score.items():
                    i = of[t]
                    if i in last and (s, key) >= last[i]:
                        continue
                    best[i].append((s, key))
                    if len(best[i]) >= 4 * k:
                        best[i] = sorted(best[i])[:k]
                        last[i] = best[i][-1]
        for i in best:
            rows += [(i, key, s) for s, key in sorted(best[i])[:k]]
        yield made(rows)

    return run


_SHORT = {"title": 8.0, "creators": 4.0, "abstract": 2.0, "chunk_text": 1.0}


def short_hits(rows: DataFrame, queries: DataFrame, block: int = 4096, k: int | None = None) -> DataFrame:
    """(query_id, key, score) of rows (key, title, creators, abstract, chunk_text) that hold a literal (query_id, literal) of one or two characters: minus the weights of the fields that hold it, case folded.

    Such a literal has no trigram, so all rows are read, once for each block of literals;
    different literals are looked for at once, and each once for all queries that ask for it.
    With k the rows are the k best of each query, ties by key, and have their rank. A null
    field holds nothing.
    """
    prepare(rows.sparkSession)
    low = rows.select("key", *(F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in _SHORT))
    asked = queries.select("query_id", F.lower(F.trim("literal")).alias("literal")).where("length(literal) IN (1, 2)")
    each, members = asked_once(asked, "literal")
    out = None
    for part in _blocks(each, "query_id", block):
        found = low.mapInArrow(_short([r["query_id"] for r in part], [r["literal"] for r in part], k), "query_id bigint, key bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, key bigint, score double" + (", rank bigint" if k else ""))
    if k:
        order = Window.partitionBy("query_id").orderBy("score", "key")
        out = out.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return for_all(out, members)


@query(
    "keyword_short_topk",
    """WITH ix AS (SELECT doc_id AS key, lower(split_part(text, chr(10), 1)) AS title, lower(source || ' ' || lang) AS creators, lower(split_part(text, chr(10), -1)) AS abstract, lower(text) AS chunk_text FROM documents WHERE text IS NOT NULL),
    q AS (SELECT doc_id AS query_id, lower(right(trim(split_part(text, chr(10), 1)), 2)) AS literal FROM documents WHERE doc_id % 50 = 0 AND trim(split_part(text, chr(10), 1)) <> ''),
    s AS (SELECT query_id, key, -(CASE WHEN contains(title, literal) THEN 8.0 ELSE 0.0 END + CASE WHEN contains(creators, literal) THEN 4.0 ELSE 0.0 END + CASE WHEN contains(abstract, literal) THEN 2.0 ELSE 0.0 END + CASE WHEN contains(chunk_text, literal) THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
      FROM q, ix WHERE length(trim(literal)) IN (1, 2) AND literal = trim(literal))
    SELECT query_id, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, key) AS rank FROM s WHERE score < 0) WHERE rank <= 10""",
)
def keyword_short_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for the last two characters of the title of each document whose id is divisible by 50."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = d.select(F.col("doc_id").alias("key"), title_of(F.col("text")).alias("title"), F.concat_ws(" ", "source", "lang").alias("creators"), F.element_at(F.split("text", "\n"), -1).alias("abstract"), F.col("text").alias("chunk_text"))
    q = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.lower(F.right(F.trim(title_of(F.col("text"))), F.lit(2))).alias("literal")).where("literal = trim(literal)")
    return short_hits(rows, q, k=10)


@query(
    "embedding_text",
    """SELECT doc_id AS key, concat_ws(chr(10), nullif(split_part(text, chr(10), 1), ''), 'In: ' || source, 'Tags: ' || lang, nullif(text, '')) AS embedding_text FROM documents""",
)
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of an item: its filled fields, a line each."""
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return items_of(spark, sf_dir).select("key", F.concat_ws("\n", full("title"), F.concat(F.lit("In: "), "item_type"), F.concat(F.lit("Tags: "), "tag"), full("abstract")).alias("embedding_text"))


@query(
    "dedupe_groups",
    r"""WITH k AS (SELECT doc_id, regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}_]+', '', 'g') AS title_key FROM documents)
    SELECT title_key, count(*) AS n_items, min(doc_id) AS first_key, max(doc_id) AS last_key FROM k WHERE title_key <> '' GROUP BY title_key HAVING count(*) > 1""",
)
def dedupe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share the key of their title."""
    k = items_of(spark, sf_dir).select("key", title_key(F.col("title")).alias("title_key")).where("title_key <> ''")
    return k.groupBy("title_key").agg(F.count("*").alias("n_items"), F.min("key").alias("first_key"), F.max("key").alias("last_key")).where("n_items > 1")
