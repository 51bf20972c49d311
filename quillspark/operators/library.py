"""Relational queries over the library.

The abstractions of a bibliographic library sit on the base tables: collections are
regions and their nations, members are customers, attachments are orders, items are
documents or parts, and an entity-attribute-value store is a part unpivoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bibliographic_year, like_escape
from ..registry import query
from ..sources.shared import materialise
from ..sources.tables import table

#: A customer is deleted, an order unsupported or its file missing, by these residues of the key.
DELETED = "c_custkey % 11 = 0"


def unpivot_eav(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(item_id, field, value as text): a row for each filled field."""
    pairs = ", ".join(f"'{c}', cast({c} as string)" for c in fields)
    return df.selectExpr(f"{id_col} AS item_id", f"stack({len(fields)}, {pairs}) AS (field, value)").where("value IS NOT NULL")


def pivot_eav(eav: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each item, a column for each field, null where there is none; a map-side aggregate."""
    return eav.groupBy("item_id").agg(*(F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in fields))


def eligibility(content_type: Column, path: Column, exists: Column, attachment: Column) -> Column:
    """The first that holds of: no attachment, unsupported content, unresolved path, missing file, else eligible."""
    return (
        F.when(attachment.isNull(), F.lit("no_attachment"))
        .when(content_type != "PDF", F.lit("unsupported_content_type"))
        .when(path.isNull(), F.lit("unresolved_path"))
        .when(~exists, F.lit("missing_file"))
        .otherwise(F.lit("eligible_pdf"))
    )


@query("tag_frequency", "SELECT lang AS tag, count(*) AS n_items FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by tag."""
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy(F.col("lang").alias("tag")).agg(F.count("*").alias("n_items"))


@query(
    "item_eav_pivot",
    "SELECT p_partkey AS item_id, p_name AS title, p_brand AS venue, p_type AS publisher, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS pages FROM part",
)
def item_eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items put together from an entity-attribute-value store; a field that is missing is null."""
    fields = {"title": "p_name", "venue": "p_brand", "publisher": "p_type", "pages": "CASE WHEN p_size % 7 <> 0 THEN p_size END"}
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", *(f"{e} AS {c}" for c, e in fields.items()))
    return pivot_eav(unpivot_eav(part, "p_partkey", list(fields)), list(fields))


@query(
    "collection_counts",
    """SELECT n.n_nationkey AS key, n.n_name AS name, r.r_name AS parent_name, count(c.c_custkey) AS item_count
    FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
    GROUP BY n.n_nationkey, n.n_name, r.r_name""",
)
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with their parent and the number of members; an empty one has 0. Members are counted before the join."""
    members = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(members, n.n_nationkey == members.c_nationkey, "left")
    return out.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("item_count"))


@query("collection_members", "SELECT c.c_custkey AS key, c.c_name AS title, n.n_name AS collection FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 2 AND c.c_custkey % 11 <> 0")
def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, not deleted, of the collections below one parent."""
    n = table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").where(f"NOT ({DELETED})")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("n_name").alias("collection"))


_SNAPSHOT = """SELECT c.c_custkey AS key, n.n_name AS collection, o.o_orderkey AS attachment_key,
  CASE WHEN o.o_orderkey IS NULL THEN 'no_attachment' WHEN o.o_orderpriority LIKE '5%' THEN 'unsupported_content_type'
       WHEN o.o_orderkey % 13 = 0 THEN 'unresolved_path' WHEN o.o_orderstatus = 'P' THEN 'missing_file' ELSE 'eligible_pdf' END AS eligibility
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey % 11 <> 0"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    o = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority").startswith("5"), "other").otherwise("PDF").alias("content"), F.when(F.col("o_orderkey") % 13 != 0, F.lit("storage")).alias("path"), (F.col("o_orderstatus") != "P").alias("there"))
    out = c.where(f"NOT ({DELETED})").join(n, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey, "left")
    return out.select(F.col("c_custkey").alias("key"), F.col("n_name").alias("collection"), F.col("o_orderkey").alias("attachment_key"), eligibility(F.col("content"), F.col("path"), F.col("there"), F.col("o_orderkey")).alias("eligibility"))


@query("collection_snapshot", _SNAPSHOT)
def collection_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with each attachment, if any, and whether it can be converted."""
    return snapshot(spark, sf_dir)


@query("eligibility_counts", f"SELECT collection, eligibility, count(*) AS n FROM ({_SNAPSHOT}) GROUP BY collection, eligibility")
def eligibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of each collection by eligibility."""
    return snapshot(spark, sf_dir).groupBy("collection", "eligibility").agg(F.count("*").alias("n"))


@query("not_deleted_anti", "SELECT o_orderkey AS key, o_custkey AS parent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0)")
def not_deleted_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments whose parent isn't deleted."""
    gone = table(spark, sf_dir, "customer").where(DELETED).select("c_custkey")
    o = table(spark, sf_dir, "orders")
    return o.join(gone, o.o_custkey == gone.c_custkey, "left_anti").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("parent"))


@query(
    "exists_or_search",
    r"""SELECT p_partkey AS key, p_name AS title FROM part p WHERE lower(p_name) LIKE '%10%' ESCAPE '\'
    OR EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_partkey = p.p_partkey AND s.s_name LIKE '%#00000007%' ESCAPE '\')""",
)
def exists_or_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose title, or the name of any of whose creators, holds a literal: a semi join beside a filter."""
    lit = lambda s: F.concat(F.lit("%"), like_escape(F.lit(s)), F.lit("%"))
    s = table(spark, sf_dir, "supplier").where(F.like("s_name", lit("#00000007"))).select("s_suppkey")
    made = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_partkey").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.join(made, p.p_partkey == made.l_partkey, "left").where(F.like(F.lower("p_name"), lit("10")) | F.col("l_partkey").isNotNull()).select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"))


@query("filtered_keys", "SELECT DISTINCT c_custkey AS key FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND year(o_orderdate) BETWEEN 1995 AND 1996")
def filtered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of one type with an attachment of a range of years; the range of dates reaches the scan."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' AND o_orderdate < timestamp_ntz'1997-01-01'").select("o_custkey")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select(F.col("c_custkey").alias("key"))


@query("recent_items", "SELECT o_orderkey AS key, CAST(o_orderdate AS VARCHAR)[1:10] AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 newest."""
    o = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)
    return o.select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


@query("notes_for_item", "SELECT l_orderkey AS parent, l_linenumber AS note, l_returnflag AS kind, o_orderstatus AS parent_status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'")
def notes_for_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with what is known of their parent."""
    l, o = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return l.join(o, l.l_orderkey == o.o_orderkey, "left").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("note"), F.col("l_returnflag").alias("kind"), F.col("o_orderstatus").alias("parent_status"))


@query(
    "index_stats",
    """WITH c AS (SELECT doc_id, list_count(string_split(text, chr(10))) AS n FROM documents)
    SELECT (sum(n) + count(*))::BIGINT AS total, sum(n)::BIGINT AS chunk_rows, count(*) AS metadata_rows, count(*) FILTER (WHERE n > 0) AS parents FROM c""",
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index with a row for each item and each of its lines."""
    c = table(spark, sf_dir, "documents").select(F.size(F.split("text", "\n")).cast("bigint").alias("n"))
    return c.agg((F.sum("n") + F.count("*")).alias("total"), F.sum("n").alias("chunk_rows"), F.count("*").alias("metadata_rows"), F.count_if(F.col("n") > 0).alias("parents"))


@query(
    "sibling_duplicates",
    """WITH d AS (SELECT doc_id, source, lang, md5(text) AS h FROM documents), r AS (
    SELECT a.doc_id AS key, b.doc_id AS sibling, row_number() OVER (PARTITION BY a.doc_id ORDER BY CASE b.lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, b.doc_id DESC) AS k
    FROM d a JOIN d b ON a.source = b.source AND a.h = b.h AND a.doc_id <> b.doc_id) SELECT key, sibling FROM r WHERE k = 1""",
)
def sibling_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the best other one of its parent with the same bytes: by rank of status, then the newest.

    The two best of each group are enough for every member, so no group is joined with itself.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"), F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("status"))
    order = F.struct("status", F.bitwise_not("doc_id").alias("id"))
    first = d.groupBy("source", "h").agg(F.min(order).alias("a"), F.count("*").alias("n")).where("n > 1")
    others = d.join(first.select("source", "h", "a"), ["source", "h"]).where(order != F.col("a")).groupBy("source", "h").agg(F.min(order).alias("b"))
    best = first.join(others, ["source", "h"]).select("source", "h", F.bitwise_not("a.id").alias("a"), F.bitwise_not("b.id").alias("b"))
    return d.join(best, ["source", "h"]).select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("sibling"))


@query(
    "provenance_chain",
    """SELECT d.doc_id AS key, coalesce(l.doc_id, e.vec_id, s.only_key) AS source_key,
    CASE WHEN l.doc_id IS NOT NULL THEN 'note' WHEN e.vec_id IS NOT NULL THEN 'table' WHEN s.only_key IS NOT NULL THEN 'sibling' ELSE 'none' END AS via
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    LEFT JOIN (SELECT source, lang, min(doc_id) AS only_key FROM documents GROUP BY source, lang HAVING count(*) = 1) s ON s.source = d.source AND s.lang = d.lang""",
)
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a derived item comes from: the first that knows of a note, a table, a sole sibling."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    note = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_key"))
    old = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("table_key"))
    sole = d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("only_key")).where("n = 1").drop("n")
    out = d.join(note, d.doc_id == note.note_key, "left").join(old, d.doc_id == old.table_key, "left").join(sole, ["source", "lang"], "left")
    via = F.when(F.col("note_key").isNotNull(), "note").when(F.col("table_key").isNotNull(), "table").when(F.col("only_key").isNotNull(), "sibling").otherwise("none")
    return out.select(F.col("doc_id").alias("key"), F.coalesce("note_key", "table_key", "only_key").alias("source_key"), via.alias("via"))


@query("already_converted_anti", "SELECT o_orderkey AS key FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F')")
def already_converted_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that nothing finished has been made of."""
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(done, o.o_orderkey == done.l_orderkey, "left_anti").select(F.col("o_orderkey").alias("key"))


@query(
    "target_status_left",
    """SELECT d.doc_id AS key, coalesce(j.n, 0) AS attempts, CASE WHEN j.n IS NULL THEN 'pending' WHEN j.errors > 0 THEN 'failed' ELSE 'done' END AS status
    FROM documents d LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id) j ON j.user_id = d.doc_id""",
)
def target_status_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with the state of their job; pending where there is none."""
    j = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    status = F.when(F.col("n").isNull(), "pending").when(F.col("errors") > 0, "failed").otherwise("done")
    return d.join(j, d.doc_id == j.user_id, "left").select(F.col("doc_id").alias("key"), F.coalesce("n", F.lit(0)).cast("bigint").alias("attempts"), status.alias("status"))


@query(
    "case_ranked_sort",
    """SELECT key, status, pages, place FROM (SELECT p_partkey AS key, p_brand AS status, p_size AS pages, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#2' THEN 0 WHEN 'Brand#1' THEN 1 ELSE 2 END, coalesce(p_size, 100000), lower(p_name), p_partkey) AS place FROM part) WHERE place <= 100""",
)
def case_ranked_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by rank of status, pages (none last), title without case, key: a top-k, then numbered."""
    rank = F.when(F.col("p_brand") == "Brand#2", 0).when(F.col("p_brand") == "Brand#1", 1).otherwise(2)
    order = [rank, F.coalesce("p_size", F.lit(100000)), F.lower("p_name"), F.col("p_partkey")]
    top = table(spark, sf_dir, "part").orderBy(*order).limit(100)
    return top.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("status"), F.col("p_size").alias("pages"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@query(
    "year_range_filter",
    """SELECT o_orderkey AS key, year(o_orderdate) AS year FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'O'""",
)
def year_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a range of years read from their free-form date."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    year = bibliographic_year(F.concat(F.lit("published "), F.date_format("o_orderdate", "yyyy")))
    return o.select(F.col("o_orderkey").alias("key"), year.alias("year")).where("year BETWEEN 1994 AND 1995")


@query(
    "ordered_lists",
    "SELECT l_orderkey AS key, string_agg(CAST(l_suppkey AS VARCHAR), '; ' ORDER BY l_linenumber, l_suppkey) AS creators, count(*) AS n_creators, CASE WHEN count(*) = 1 THEN (list(l_suppkey ORDER BY l_linenumber, l_suppkey))[1]::VARCHAR WHEN count(*) = 2 THEN string_agg(CAST(l_suppkey AS VARCHAR), ' & ' ORDER BY l_linenumber, l_suppkey) ELSE (list(l_suppkey ORDER BY l_linenumber, l_suppkey))[1]::VARCHAR || ' et al. (' || count(*) || ')' END AS short FROM lineitem GROUP BY l_orderkey",
)
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creators of each item in their order, in full and in short."""
    made = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string"))
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(made.alias("all"))
    n, first = F.size("all").cast("bigint"), F.get("all", F.lit(0))
    short = F.when(n == 1, first).when(n == 2, F.array_join("all", " & ")).otherwise(F.concat(first, F.lit(" et al. ("), n.cast("string"), F.lit(")")))
    return out.select("key", F.array_join("all", "; ").alias("creators"), n.alias("n_creators"), short.alias("short"))


@query(
    "tree_depth_root",
    """WITH RECURSIVE node AS (
      SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), walk AS (
      SELECT id, id AS root, 0::BIGINT AS depth FROM node WHERE parent IS NULL UNION ALL SELECT node.id, walk.root, walk.depth + 1 FROM node JOIN walk ON node.parent = walk.id)
    SELECT id, root, depth FROM walk""",
)
def tree_depth_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and root of each node of a tree given by parents."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = (
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
        .union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
        .union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    )
    return depth_and_root(node)


def depth_and_root(node: DataFrame) -> DataFrame:
    """(id, root, depth) of nodes (id, parent): null and the largest number for those on or below a cycle or a missing parent.

    Parents are doubled: each round a node's ancestor becomes its ancestor's ancestor, so a
    chain of n nodes takes log2 n rounds, each written to the shared folder. A node that
    still has an ancestor after as many rounds as there can be is on or below a cycle.
    """
    known = node.select(F.col("id").alias("parent")).distinct().withColumn("known", F.lit(True))
    start = node.join(known, "parent", "left")
    lost = F.col("parent").isNotNull() & F.col("known").isNull()
    at = materialise(start.select("id", F.when(~lost, F.col("parent")).alias("up"), F.col("id").alias("top"), lost.alias("lost"), F.lit(0).cast("bigint").alias("depth")).withColumn("top", F.coalesce("up", "top")).withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("bigint")), "tree")
    for _ in range(max(1, at.count().bit_length())):
        if at.where("up IS NOT NULL").isEmpty():
            break
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("top").alias("above"), F.col("lost").alias("above_lost"), F.col("depth").alias("more"))
        done = at.where("up IS NULL")
        going = at.where("up IS NOT NULL").join(above, "up").select("id", F.col("next").alias("up"), F.col("above").alias("top"), F.col("above_lost").alias("lost"), (F.col("depth") + F.col("more")).alias("depth"))
        at = materialise(done.unionByName(going), "tree")
    bad = F.col("lost") | F.col("up").isNotNull()
    return at.select("id", F.when(~bad, F.col("top")).alias("root"), F.when(bad, F.lit((1 << 63) - 1)).otherwise(F.col("depth")).alias("depth"))
