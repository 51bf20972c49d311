"""Incremental and state-like operators: sync plans, merges, leases, recovery, roll-ups.

Old and new snapshots of a store are orders before and from a date on; jobs are users of
events, whose types are states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

_OLD = "old AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, max(o_orderdate) AS made_at FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey)"
_NEW = "new AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, max(o_orderdate) AS made_at FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_custkey)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(k, price, made_at) of the newest order of each customer before a date, and from it on."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")

    def newest(df: DataFrame) -> DataFrame:
        best = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("b")
        return df.groupBy(F.col("o_custkey").alias("k")).agg(best).select("k", F.col("b.o_totalprice").alias("price"), F.col("b.o_orderdate").alias("made_at"))

    cut = "timestamp_ntz'1996-01-01'"
    return newest(o.where(f"o_orderdate < {cut}")), newest(o.where(f"o_orderdate >= {cut}"))


@query("sync_plan", f"WITH {_OLD}, {_NEW} SELECT coalesce(new.k, old.k) AS k, CASE WHEN old.k IS NULL THEN 'add' WHEN new.k IS NULL THEN 'gone' WHEN old.price <> new.price THEN 'update' ELSE 'keep' END AS action FROM new FULL JOIN old ON new.k = old.k")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be done for each key so that an index follows its source."""
    old, new = snapshots(spark, sf_dir)
    both = new.select("k", F.col("price").alias("p")).join(old.select("k", F.col("price").alias("q")), "k", "full")
    return both.select("k", F.when(F.col("q").isNull(), "add").when(F.col("p").isNull(), "gone").when(F.col("p") != F.col("q"), "update").otherwise("keep").alias("action"))


def merge(old: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...] = (), filled: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by keys, null being a key like any other: new rows win; of columns in `kept` the old value stays, in `filled` a null doesn't overwrite."""
    a, b = old.withColumn("_there", F.lit(True)).alias("a"), new.withColumn("_there", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    there, came = (F.col(f"{x}._there").isNotNull() for x in "ab")

    def value(c: str):
        o, n = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys:
            return F.coalesce(n, o).alias(c)
        if c in kept:
            return F.when(there, o).otherwise(n).alias(c)
        if c in filled:
            return F.coalesce(n, o).alias(c)
        return F.when(came, n).otherwise(o).alias(c)

    return both.select(*(value(c) for c in old.columns))


@query("merge_upsert", f"WITH {_OLD}, {_NEW} SELECT coalesce(new.k, old.k) AS k, CASE WHEN new.k IS NOT NULL THEN new.price ELSE old.price END AS price, coalesce(old.made_at, new.made_at) AS made_at FROM old FULL JOIN new ON old.k = new.k")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones; when a row was first made stays."""
    return merge(*snapshots(spark, sf_dir), ["k"], kept=("made_at",))


@query("partial_upsert", f"WITH {_OLD}, {_NEW}, n AS (SELECT k, CASE WHEN k % 3 <> 0 THEN price END AS price, made_at FROM new) SELECT coalesce(n.k, old.k) AS k, coalesce(n.price, old.price) AS price, CASE WHEN n.k IS NOT NULL THEN n.made_at ELSE old.made_at END AS made_at FROM old FULL JOIN n ON old.k = n.k")
def partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones; a price that is missing doesn't overwrite."""
    old, new = snapshots(spark, sf_dir)
    return merge(old, new.withColumn("price", F.when(F.col("k") % 3 != 0, F.col("price"))), ["k"], filled=("price",))


@query("replace_partition", "SELECT l_orderkey AS parent, l_linenumber AS chunk, l_linestatus AS origin FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderstatus = 'P'")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of some parents replaced as a whole."""
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("parent"), F.lit(1).alias("chunk"), F.lit("new").alias("origin"))
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("chunk"), F.col("l_linestatus").alias("origin"))
    return old.join(new.select("parent"), "parent", "left_anti").union(new)


_LAST = "last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS made_at FROM events GROUP BY user_id)"


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, state, made_at): the newest event of each."""
    best = F.max(F.struct("ts", "event_id", "event_type")).alias("b")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(best).select("user_id", F.col("b.event_type").alias("state"), F.col("b.ts").alias("made_at"))


@query(
    "lease_claim",
    f"WITH {_LAST}, m AS (SELECT max(made_at) AS now FROM last) SELECT user_id, CASE WHEN state IN ('signup', 'view') THEN 'claimed' WHEN state = 'click' AND made_at <= now - INTERVAL 1 HOUR THEN 'taken_over' ELSE 'held' END AS claim FROM last, m",
)
def lease_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs can be claimed: free ones, and those whose lease has run out. The present is the newest event of all."""
    now = table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    claim = F.when(F.col("state").isin("signup", "view"), "claimed").when((F.col("state") == "click") & (F.col("made_at") <= now - F.expr("INTERVAL 1 HOUR")), "taken_over").otherwise("held")
    return last_events(spark, sf_dir).select("user_id", claim.alias("claim"))


@query("interrupted_recovery", f"WITH {_LAST} SELECT user_id, CASE WHEN state = 'click' THEN 'failed' ELSE state END AS state, CASE WHEN state = 'click' THEN 'retry is safe' END AS note FROM last")
def interrupted_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that were running when their owner went are failed, to be tried again."""
    lost = F.col("state") == "click"
    return last_events(spark, sf_dir).select("user_id", F.when(lost, "failed").otherwise(F.col("state")).alias("state"), F.when(lost, "retry is safe").alias("note"))


@query("progress_latest", "SELECT user_id, event_type AS stage, arg_max(value, (ts, event_id)) AS latest, max(value) AS most FROM events GROUP BY user_id, event_type")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest counter of each stage and the largest."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.col("event_type").alias("stage")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.max("value").alias("most"))


@query("event_dedupe", "SELECT user_id, event_type, date_trunc('hour', ts) AS hour, min(event_id) AS event_id, count(*) AS deliveries FROM events GROUP BY user_id, event_type, date_trunc('hour', ts)")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of those that say the same, and how often it came."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", hour.alias("hour")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("deliveries"))


@query(
    "reconcile_case",
    """SELECT o.o_orderkey AS key, CASE WHEN l.n IS NULL THEN 'missing_evidence' WHEN o_orderpriority LIKE '5%' THEN 'unsupported_contract' WHEN l.n <> l.top THEN 'page_count_drift' WHEN l.late > 0 THEN 'invalid_coverage' ELSE 'accepted' END AS verdict
    FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS top, count(*) FILTER (WHERE l_discount > 0.08) AS late FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
)
def reconcile_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that is wrong with the evidence of each source, else accepted."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"), F.max("l_linenumber").alias("top"), F.count_if(F.col("l_discount") > 0.08).alias("late"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    verdict = F.when(F.col("n").isNull(), "missing_evidence").when(F.col("o_orderpriority").startswith("5"), "unsupported_contract").when(F.col("n") != F.col("top"), "page_count_drift").when(F.col("late") > 0, "invalid_coverage").otherwise("accepted")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select(F.col("o_orderkey").alias("key"), verdict.alias("verdict"))


@query(
    "phase_fold",
    """SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 12 THEN 'error' WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 'todo' WHEN count(*) FILTER (WHERE event_type <> 'purchase') = 0 THEN 'done' ELSE 'current' END AS phase,
    round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / count(*), 6) AS fraction FROM events GROUP BY user_id""",
)
def phase_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a phase by those of its members, and the closed share."""
    n = lambda c: F.count_if(c)
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), n(F.col("event_type") == "error").alias("bad"), n(F.col("event_type") == "purchase").alias("closed"))
    phase = F.when(F.col("bad") > 12, "error").when(F.col("closed") == 0, "todo").when(F.col("closed") == F.col("n"), "done").otherwise("current")
    return e.select("user_id", phase.alias("phase"), F.round(F.col("closed") / F.col("n"), 6).alias("fraction"))


@query(
    "status_rollup",
    "SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS jobs, round(sum(value), 4) AS total, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY event_type",
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by status."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("jobs"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(
    "paired_engines",
    """SELECT d.lang, count(*) AS files, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END)::BIGINT AS ok, round(avg(CASE WHEN l.quality = 1 THEN 0.0 ELSE 1.0 END), 4) AS failure_rate, sum(l.toxic)::BIGINT AS flagged
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""",
)
def paired_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that both sides know, by class, with how many failed."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    ok = F.col("quality") == 1
    return d.join(l, "doc_id").groupBy("lang").agg(F.count("*").alias("files"), F.count_if(ok).alias("ok"), F.round(F.avg(F.when(ok, 0.0).otherwise(1.0)), 4).alias("failure_rate"), F.sum("toxic").cast("bigint").alias("flagged"))


@query(
    "approval_verdict",
    "SELECT d.doc_id AS key, CASE WHEN e.vec_id IS NULL THEN 'no_state' WHEN l.doc_id IS NULL THEN 'no_approval' WHEN l.quality = 0 THEN 'hash_mismatch' ELSE 'approved' END AS verdict FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def approval_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in order of what is missing first."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("state"))
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left").join(l, "doc_id", "left")
    return out.select(F.col("doc_id").alias("key"), F.when(F.col("state").isNull(), "no_state").when(F.col("quality").isNull(), "no_approval").when(F.col("quality") == 0, "hash_mismatch").otherwise("approved").alias("verdict"))


@query(
    "inventory_rollup",
    "SELECT o_orderstatus AS status, o_orderpriority AS class, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
)
def inventory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by status and class, by status, and in all."""
    r = table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("class"))
    return r.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("progress_sum", "SELECT user_id, least(sum(most), 500.0) AS completed FROM (SELECT user_id, event_type, max(value) AS most FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def progress_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the largest counter of each item, clamped."""
    most = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("most"))
    return most.groupBy("user_id").agg(F.least(F.sum("most"), F.lit(500.0)).alias("completed"))
