"""Incremental sync of a stored index: what changed is rewritten, all at once or not at all.

An index has a row for each item and one for each of its chunks. A sync compares both with
the source: items by key and date, chunks by how many there are, their texts, the hash of
the source and the contracts they were made under. What it changes becomes one version of
the table; the rows of items that nothing changes are not written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import materialise, shared_dir
from ..sources.tables import table
from ..sources.versions import VersionedTable

#: chunk_idx is null in the row of the item itself; `written` is the version that wrote a row.
INDEX = "parent long, chunk_idx int, date_modified timestamp_ntz, body string, sha string, contract string, profile string, source string, written int"
MANAGED, SCOPED = "sync", "item_scoped"


def item_scoped(source: Column, sha: Column, contract: Column, profile: Column) -> Column:
    """Whether a chunk was made for its item alone: it says so, or says nothing and carries a whole identity."""
    whole = [F.coalesce(c, F.lit("")) != "" for c in (sha, contract, profile)]
    return F.coalesce(source == SCOPED, F.lit(False)) | (source.isNull() & whole[0] & whole[1] & whole[2])


def _merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the index: keys alone lie in files so small that Spark would broadcast them, and they fill the driver."""
    return df.hint("merge")


def sync_index(store: VersionedTable, items: DataFrame, chunks: DataFrame, contract: str, profile: str, full: bool = False) -> dict[str, int]:
    """Bring a stored index up to items (parent, date_modified, body) and chunks (parent, chunk_idx, body, sha); what was done, in numbers.

    An item is written if it is new or its date differs. Its chunks are replaced as a whole
    if anything of their identity differs, and managed ones removed where it has no text any
    more. Items that the source lacks stay. A full sync writes all anew: managed rows go
    first, item-scoped chunks stay, and items that have some get no others. A failure on the
    way, or another writer who is faster (versions.Conflict), leaves the index as it was.
    """
    base = store.version()
    index = store.read(base)
    kept_scoped = item_scoped(F.col("source"), F.col("sha"), F.col("contract"), F.col("profile"))
    old_items, old_chunks = index.where("chunk_idx IS NULL"), index.where("chunk_idx IS NOT NULL").withColumn("scoped", kept_scoped)
    same = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("chunk_idx", F.coalesce("body", F.lit("")).alias("body"), "sha", "contract", "profile")))), 256)
    fresh = chunks.where(F.trim(F.coalesce("body", F.lit(""))) != "").withColumns({"contract": F.lit(contract), "profile": F.lit(profile)})
    identity = lambda rows, name: rows.groupBy("parent").agg(same.alias(name))
    was = old_chunks.groupBy("parent").agg(same.alias("was"), F.bool_or("scoped").alias("has_scoped"), F.bool_or(~F.col("scoped")).alias("has_managed"))
    plan = items.select("parent", "date_modified").join(old_items.select("parent", F.col("date_modified").alias("old_date"), F.lit(True).alias("there")).transform(_merged), "parent", "left")
    plan = plan.join(_merged(identity(fresh, "now")), "parent", "left").join(_merged(was), "parent", "left")
    meta = F.lit(full) | F.col("there").isNull() | ~F.col("date_modified").eqNullSafe(F.col("old_date"))
    text = F.when(F.lit(full) & F.coalesce("has_scoped", F.lit(False)), "scoped").when(F.col("now").isNull(), F.when(F.coalesce("has_managed", F.lit(False)), "remove").otherwise("none")).when(F.col("now").eqNullSafe(F.col("was")) & F.lit(not full), "keep").otherwise("replace")
    plan = materialise(plan.select("parent", meta.alias("meta"), text.alias("text")), "plan")
    did = {(r["meta"], r["text"]): r["n"] for r in plan.groupBy("meta", "text").agg(F.count("*").alias("n")).collect()}
    stats = {"total": sum(did.values()), "embedded": sum(n for (m, _), n in did.items() if m)} | {what: sum(n for (_, t), n in did.items() if t == what) for what in ("replace", "remove", "keep")}

    columns, now = [f.name for f in store.schema.fields], F.lit(base + 1).alias("written")
    nulls = [F.lit(None).cast("string").alias(c) for c in ("sha", "contract", "profile", "source")]
    item_rows = items.join(_merged(plan.where("meta").select("parent")), "parent", "left_semi").select("parent", F.lit(None).cast("int").alias("chunk_idx"), "date_modified", "body", *nulls, now)
    date = F.lit(None).cast("timestamp_ntz").alias("date_modified")
    chunk_rows = fresh.join(_merged(plan.where("text = 'replace'").select("parent")), "parent", "left_semi").select("parent", "chunk_idx", date, "body", "sha", "contract", "profile", F.lit(MANAGED).alias("source"), now)
    made = item_rows.select(*columns).unionByName(chunk_rows.select(*columns))
    if full:
        # items that the source lacks lose their managed rows too; item-scoped chunks outlive them
        store.overwrite(made.unionByName(old_chunks.join(_merged(plan.where("text = 'replace'").select("parent")), "parent", "left_anti").where("scoped").select(*columns)))
        return stats
    changed = plan.where("meta OR text IN ('replace', 'remove')")
    kept_items = old_items.join(_merged(changed.where("NOT meta").select("parent")), "parent", "left_semi")
    kept_chunks = old_chunks.join(_merged(changed.where("text <> 'replace'").select("parent", "text")), "parent").where("scoped OR text <> 'remove'")
    store.replace(changed.select("parent"), made.unionByName(kept_items.select(*columns)).unionByName(kept_chunks.select(*columns)), base)
    return stats


# --- the seat: orders are items, their line items, as shipped so far, the chunks ------

def _source(spark: SparkSession, sf_dir: str, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """Orders with a line shipped before `high`, dated by the last such; their lines from `low` on as chunks."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(high).cast("timestamp_ntz"))
    items = l.groupBy(F.col("l_orderkey").alias("parent")).agg(F.max("l_shipdate").alias("date_modified"), F.concat(F.lit("order "), F.min("l_partkey")).alias("body"))
    lines = l.where(F.col("l_shipdate") >= F.lit(low).cast("timestamp_ntz")).select(F.col("l_orderkey").alias("parent"), F.concat_ws(" ", "l_linenumber", "l_partkey", "l_suppkey").alias("line"))
    every = lines.groupBy("parent").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    chunks = every.select("parent", F.md5(F.array_join("lines", "\n")).alias("sha"), F.posexplode("lines").alias("chunk_idx", "body"))
    return items, chunks


def _stored(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """An index of what was shipped before July 1996; chunks of the urgent orders are made for their item alone."""
    items, chunks = _source(spark, sf_dir, "1900-01-01", "1996-07-01")
    store = VersionedTable(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "parent", INDEX, buckets=8)
    sync_index(store, items, chunks, "c1", "p1")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("parent"))
    own = store.read().join(_merged(urgent), "parent", "left_semi").withColumn("source", F.when(F.col("chunk_idx").isNotNull(), SCOPED))
    store.replace(own.select("parent"), own)
    return store


_SYNC = """l1 AS (SELECT l_orderkey AS parent, l_shipdate, l_partkey, concat_ws(' ', l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-07-01'), l2 AS (SELECT l_orderkey AS parent, l_shipdate, l_partkey, concat_ws(' ', l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-07-01'),
    i1 AS (SELECT parent, max(l_shipdate) AS d, 'order ' || min(l_partkey) AS body FROM l1 GROUP BY parent), i2 AS (SELECT parent, max(l_shipdate) AS d, 'order ' || min(l_partkey) AS body FROM l2 GROUP BY parent),
    c1 AS (SELECT parent, list_sort(list(line)) AS lines FROM l1 GROUP BY parent), c2 AS (SELECT parent, list_sort(list(line)) AS lines FROM l2 WHERE l_shipdate >= TIMESTAMP '1993-01-01' GROUP BY parent),
    u AS (SELECT o_orderkey AS parent FROM orders WHERE o_orderpriority = '1-URGENT'),
    p AS (SELECT i2.parent, c1.lines AS was, c2.lines AS now, u.parent IS NOT NULL AND c1.lines IS NOT NULL AS scoped FROM i2 LEFT JOIN c1 USING (parent) LEFT JOIN c2 USING (parent) LEFT JOIN u USING (parent))"""


@query(
    "index_sync",
    f"""WITH {_SYNC}, rows AS (
      SELECT i2.parent, NULL::INT AS chunk_idx, i2.d AS date_modified, CASE WHEN i1.d = i2.d THEN i1.body ELSE i2.body END AS body, NULL AS source, CASE WHEN i1.d = i2.d THEN 1 ELSE 3 END AS written FROM i2 LEFT JOIN i1 USING (parent)
      UNION ALL SELECT parent, unnest(range(0, len(now)))::INT, NULL, unnest(now), CASE WHEN now = was AND scoped THEN 'item_scoped' ELSE 'sync' END, CASE WHEN now = was THEN 1 ELSE 3 END FROM p WHERE now IS NOT NULL
      UNION ALL SELECT parent, unnest(range(0, len(was)))::INT, NULL, unnest(was), 'item_scoped', 1 FROM p WHERE now IS NULL AND scoped)
    SELECT parent, chunk_idx, date_modified, body, source, written FROM rows""",
)
def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index after a sync with what was shipped a year later, less what had left by 1993: every row, and which version wrote it."""
    store = _stored(spark, sf_dir)
    sync_index(store, *_source(spark, sf_dir, "1993-01-01", "1997-07-01"), "c1", "p1")
    return store.read().select("parent", "chunk_idx", "date_modified", "body", "source", "written")


@query(
    "index_full_sync",
    f"""WITH {_SYNC} SELECT parent, NULL::INT AS chunk_idx, d AS date_modified, body, NULL AS source, 3 AS written FROM i2
      UNION ALL SELECT parent, unnest(range(0, len(now)))::INT, NULL, unnest(now), 'sync', 3 FROM p WHERE now IS NOT NULL AND NOT scoped
      UNION ALL SELECT parent, unnest(range(0, len(was)))::INT, NULL, unnest(was), 'item_scoped', 1 FROM p WHERE scoped""",
)
def index_full_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a full sync: all managed rows anew, item-scoped chunks as they were."""
    store = _stored(spark, sf_dir)
    sync_index(store, *_source(spark, sf_dir, "1993-01-01", "1997-07-01"), "c1", "p1", full=True)
    return store.read().select("parent", "chunk_idx", "date_modified", "body", "source", "written")
