"""Small scalar operations of one kind, a query for each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources.tables import table


@query(
    "array_pack",
    "WITH a AS (SELECT l_orderkey AS key, list(l_linenumber ORDER BY l_linenumber) AS l, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY l_orderkey) SELECT key, len(l) AS n, l[1:len(l) // 2] = list_sort(l[1:len(l) // 2]) AS rising, array_to_string(list_sort(f), ',') AS kinds, list_has_all(f, ['A', 'R']) AS has_both, list_max(l) + 1 AS next_number FROM a",
)
def array_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of an item: halves, order, distinct kinds, required kinds, the next number."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"), F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    half = F.slice("l", F.lit(1), F.floor(F.size("l") / 2).cast("int"))
    need = F.array(F.lit("A"), F.lit("R"))
    return a.select("key", F.size("l").cast("bigint").alias("n"), (half == F.array_sort(half)).alias("rising"), F.array_join("f", ",").alias("kinds"), (F.size(F.array_except(need, F.col("f"))) == 0).alias("has_both"), (F.array_max("l") + 1).alias("next_number"))


@query("json_pack", """SELECT event_id, try_cast(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS lacks, '{"eventId":' || event_id || ',"eventType":"' || event_type || '"}' AS payload FROM events""")
def json_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from open JSON, and a payload with keys of another style."""
    e = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(F.col("event_id").alias("eventId"), F.col("event_type").alias("eventType")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("lacks"), payload.alias("payload"))


@query(
    "decision_pack",
    """SELECT p_partkey AS key, CASE WHEN p_size > 10 AND p_size <= 30 THEN 'middle' WHEN p_size > 30 THEN 'large' ELSE 'small' END AS band, CASE WHEN p_type = 'PROMO' THEN 'external' WHEN p_name LIKE 'part 1%' THEN 'escape' ELSE 'inside' END AS safety,
    (p_brand = 'Brand#1' AND p_size > 25) OR p_retailprice > 1500 AS accepted FROM part""",
)
def decision_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands, ordered cases and conjunctions."""
    size, p = F.col("p_size"), table(spark, sf_dir, "part")
    band = F.when((size > 10) & (size <= 30), "middle").when(size > 30, "large").otherwise("small")
    safety = F.when(F.col("p_type") == "PROMO", "external").when(F.col("p_name").startswith("part 1"), "escape").otherwise("inside")
    return p.select(F.col("p_partkey").alias("key"), band.alias("band"), safety.alias("safety"), (((F.col("p_brand") == "Brand#1") & (size > 25)) | (F.col("p_retailprice") > 1500)).alias("accepted"))


@query("note_units", "SELECT l_suppkey AS note, count(DISTINCT l_orderkey) AS units, min(l_orderkey) AS first_unit FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey")
def note_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different units that define or refer to each note."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return l.groupBy(F.col("l_suppkey").alias("note")).agg(F.countDistinct("l_orderkey").alias("units"), F.min("l_orderkey").alias("first_unit"))


@query(
    "package_audit_sets",
    "SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'unexpected' ELSE 'missing' END AS finding FROM (SELECT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels UNION SELECT vec_id FROM embeddings) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL",
)
def package_audit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one of two sets has and the other lacks."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.lit(True).alias("a"))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")).union(table(spark, sf_dir, "embeddings").select("vec_id")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full").where("a IS NULL OR b IS NULL").select(F.col("k").alias("key"), F.when(F.col("a").isNull(), "unexpected").otherwise("missing").alias("finding"))


@query(
    "scalar_text_pack",
    r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5, CASE WHEN regexp_matches(text, '^([#>*+-]|[0-9]+[.)])') THEN TRUE ELSE FALSE END AS structural, 'doc-' || left(sha256(text), 24) AS data_id,
    CASE WHEN regexp_matches(text, '(1[5-9][0-9]{2}|2[01][0-9]{2})') THEN regexp_extract(text, '(1[5-9][0-9]{2}|2[01][0-9]{2})', 1) ELSE 'unknown' END AS year FROM documents""",
)
def scalar_text_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes, structural starts, content ids and years."""
    c, out = F.col("text"), F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("escaped_md5"), c.rlike(r"^([#>*+-]|[0-9]+[.)])").alias("structural"), F.concat(F.lit("doc-"), F.left(F.sha2(c, 256), F.lit(24))).alias("data_id"), T.attachment_year(c).alias("year"))
