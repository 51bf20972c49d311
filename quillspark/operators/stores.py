"""Stores that follow their sources: index rows and their scopes, evidence, approvals, claims, checkpoints, batches.

Index rows are line items: an order is a parent, a line a chunk, and how it was indexed
follows from its flags. Conversions are orders with their lines as pages. Each rule is a
function of data frames; the queries seat it on those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

# --- the index ---------------------------------------------------------------

_INDEX = """ix AS (SELECT l_orderkey AS parent, l_orderkey || '#c' || l_linenumber AS key, l_linenumber AS chunk_idx, 'chunk ' || l_partkey AS chunk_text, CASE l_returnflag WHEN 'A' THEN 'item_scoped' WHEN 'R' THEN 'sync' END AS index_source,
  CASE WHEN l_linestatus = 'O' THEN md5(l_orderkey::VARCHAR) END AS sha, CASE WHEN l_tax > 0.02 THEN 'c1' ELSE '' END AS contract, CASE WHEN l_discount > 0.03 THEN 'p1' END AS profile, l_shipdate AS made_at FROM lineitem),
scoped AS (SELECT *, coalesce(index_source = 'item_scoped', FALSE) OR (index_source IS NULL AND coalesce(sha, '') <> '' AND coalesce(contract, '') <> '' AND coalesce(profile, '') <> '') AS item_scoped FROM ix)"""


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, c = table(spark, sf_dir, "lineitem"), F.col
    source = F.when(c("l_returnflag") == "A", "item_scoped").when(c("l_returnflag") == "R", "sync")
    return l.select(
        c("l_orderkey").alias("parent"), F.concat(c("l_orderkey"), F.lit("#c"), c("l_linenumber")).alias("key"), c("l_linenumber").alias("chunk_idx"), F.concat(F.lit("chunk "), c("l_partkey")).alias("chunk_text"), source.alias("index_source"),
        F.when(c("l_linestatus") == "O", F.md5(c("l_orderkey").cast("string"))).alias("sha"), F.when(c("l_tax") > 0.02, "c1").otherwise("").alias("contract"), F.when(c("l_discount") > 0.03, "p1").alias("profile"), c("l_shipdate").alias("made_at"),
    )


def item_scoped() -> Column:
    """Whether a row was indexed for its item alone: it says so, or says nothing and carries its text's hash, contract and profile."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.coalesce(F.col("index_source") == "item_scoped", F.lit(False)) | (F.col("index_source").isNull() & given("sha") & given("contract") & given("profile"))


@query("index_scopes", f"WITH {_INDEX} SELECT parent, bool_or(item_scoped) AS any_item_scoped, count(*) FILTER (WHERE NOT item_scoped) AS sync_managed, count(*) AS chunks, max(made_at) AS newest FROM scoped GROUP BY parent")
def index_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each parent whether any of its chunks is item-scoped, how many the sync manages, and its newest date."""
    r = index_rows(spark, sf_dir).withColumn("item_scoped", item_scoped())
    return r.groupBy("parent").agg(F.bool_or("item_scoped").alias("any_item_scoped"), F.count_if(~F.col("item_scoped")).alias("sync_managed"), F.count("*").alias("chunks"), F.max("made_at").alias("newest"))


@query("full_sync_clear", f"WITH {_INDEX} SELECT key, parent FROM scoped WHERE item_scoped")
def full_sync_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full sync leaves of the index before it fills it again."""
    return index_rows(spark, sf_dir).where(item_scoped()).select("key", "parent")


@query("drop_sync_chunks", f"WITH {_INDEX} SELECT key FROM scoped WHERE item_scoped OR parent NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def drop_sync_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without the chunks that the sync manages of parents whose text is gone."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("parent"))
    return drop_managed(index_rows(spark, sf_dir), gone).select("key")


def drop_managed(index: DataFrame, parents: DataFrame) -> DataFrame:
    """index without the rows of parents that aren't item-scoped."""
    marked = index.join(parents.select("parent").distinct().withColumn("_gone", F.lit(True)), "parent", "left")
    return marked.where(item_scoped() | F.col("_gone").isNull()).drop("_gone")


@query(
    "item_index_plan",
    f"""WITH {_INDEX}, old AS (SELECT parent, list(chunk_text ORDER BY chunk_idx, chunk_text) AS t, list(chunk_idx ORDER BY chunk_idx) AS i, max(sha) AS sha FROM scoped WHERE item_scoped GROUP BY parent),
    new AS (SELECT l_orderkey AS parent, list(c ORDER BY l_linenumber, c) AS t, list(l_linenumber ORDER BY l_linenumber) AS i FROM (SELECT *, 'chunk ' || (l_partkey + CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_quantity::INT % 2 END) AS c FROM lineitem) GROUP BY l_orderkey)
    SELECT new.parent, len(new.t) AS chunks, coalesce(old.t = new.t AND old.i = new.i, FALSE) AS reused, CASE WHEN old.t IS NULL THEN 'index' WHEN old.t = new.t AND old.i = new.i THEN 'keep' ELSE 'replace' END AS action, sha256(array_to_string(new.t, chr(10))) AS text_sha256 FROM new LEFT JOIN old USING (parent)""",
)
def item_index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item what indexing it alone does: keep what is identical in every chunk and place, else replace all of it at once; with its evidence."""
    changed = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_quantity").cast("int") % 2)
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("chunk_idx"), F.concat(F.lit("chunk "), F.col("l_partkey") + changed).alias("chunk_text"))
    return index_plan(index_rows(spark, sf_dir).where(item_scoped()), new)


def index_plan(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(parent, chunks, reused, action, text_sha256) of fresh (parent, chunk_idx, chunk_text) against what is stored."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_text"))).alias(name))

    both = whole(fresh, "new").join(whole(stored, "old"), "parent", "left")
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    action = F.when(F.col("old").isNull(), "index").when(same, "keep").otherwise("replace")
    return both.select("parent", F.size("new").cast("bigint").alias("chunks"), same.alias("reused"), action.alias("action"), F.sha2(F.array_join(F.transform("new", lambda x: x["chunk_text"]), "\n"), 256).alias("text_sha256"))


@query("sidecar_backfill", f"WITH {_INDEX}, s AS (SELECT parent, count(*) AS n FROM scoped WHERE index_source IS NOT NULL GROUP BY parent) SELECT i.parent, i.n AS stored, coalesce(s.n, 0) AS in_sidecar, coalesce(s.n, 0) <> i.n AS rebuild FROM (SELECT parent, count(*) AS n FROM ix GROUP BY parent) i LEFT JOIN s USING (parent)")
def sidecar_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the side table of keywords holds other rows than the index, and is built anew."""
    n = index_rows(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("stored"), F.count("index_source").alias("in_sidecar"))
    return n.withColumn("rebuild", F.col("stored") != F.col("in_sidecar"))


# --- evidence ----------------------------------------------------------------


def coverage(pages: Column, total: Column, uploaded: Column) -> Column:
    """Status of pages that must rise strictly within 1 to total; null where they don't."""
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(pages) - 1, F.lit(1))), lambda i: (F.size(pages) < 2) | (F.get(pages, i - 1) < F.get(pages, i)))
    valid = (total >= 1) & (F.size(pages) > 0) & ~F.exists(pages, lambda p: p.isNull() | (p < 1) | (p > total)) & rising
    done = F.size(pages) == total
    return F.when(valid & uploaded, F.when(done, "completed").otherwise("uploaded_partial")).when(valid, F.when(done, "local_complete").otherwise("local_partial"))


REQUIRED_KINDS = ("markdown", "route-sidecar", "publication-evidence")
ROUTES = ("pdf-text", "mineru", "paddle")


def evidence_verdict() -> Column:
    """The first thing that is wrong with evidence, or the coverage of what is accepted.

    Columns: evidence (null, or a struct schema, contract, route, source_key, parent_key, md5,
    sha256, page_count, pages, artifacts array<struct<kind, sha256, found_sha256>>) and
    contract, source_key, parent_key, md5, sha256, page_count of what is there now.
    """
    e, c = F.col("evidence"), F.col
    kinds = F.transform(e["artifacts"], lambda a: a["kind"])
    need = F.array(*map(F.lit, REQUIRED_KINDS))
    status = coverage(e["pages"], c("page_count"), F.lit(False))
    missing, drift = F.exists(e["artifacts"], lambda a: a["found_sha256"].isNull()), F.exists(e["artifacts"], lambda a: a["found_sha256"] != a["sha256"])
    return (
        F.when(e.isNull(), "missing_evidence")
        .when(e["schema"].isNull(), "unsupported_evidence")
        .when((e["schema"] != "v2") | ~e["contract"].eqNullSafe(c("contract")), "unsupported_contract")
        .when(~e["route"].isin(*ROUTES), "unsupported_route")
        .when(~e["source_key"].eqNullSafe(c("source_key")) | ~e["parent_key"].eqNullSafe(F.coalesce(c("parent_key"), F.lit(""))), "source_identity_mismatch")
        .when(~e["md5"].eqNullSafe(c("md5")) | ~e["sha256"].eqNullSafe(c("sha256")), "source_drift")
        .when(~e["page_count"].eqNullSafe(c("page_count")), "page_count_drift")
        .when(status.isNull(), "invalid_coverage")
        .when((F.size(F.array_except(need, kinds)) > 0) | (F.size(kinds) != F.size(F.array_distinct(kinds))), "missing_artifact_reference")
        .when(missing, "missing_artifact")
        .when(drift, "artifact_drift")
        .otherwise(status)
    )


_CONV = """lines AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS pages, max(l_linenumber) AS top, count(*) AS n FROM lineitem GROUP BY l_orderkey),
conv AS (SELECT o.*, l.pages, coalesce(l.top, 1) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS page_count, l.n FROM orders o LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey)"""


@query(
    "evidence_verdicts",
    f"""WITH {_CONV} SELECT o_orderkey AS key, CASE WHEN pages IS NULL THEN 'missing_evidence' WHEN o_orderkey % 29 = 1 THEN 'unsupported_evidence' WHEN o_orderkey % 31 = 2 OR o_orderkey % 37 = 3 THEN 'unsupported_contract' WHEN o_orderkey % 23 = 4 THEN 'unsupported_route'
      WHEN o_orderkey % 19 = 5 THEN 'source_identity_mismatch' WHEN o_orderkey % 17 = 6 THEN 'source_drift' WHEN o_orderkey % 13 = 7 THEN 'page_count_drift' WHEN len(list_distinct(pages)) <> len(pages) THEN 'invalid_coverage' WHEN o_orderkey % 7 = 1 THEN 'missing_artifact_reference'
      WHEN o_orderkey % 5 = 2 THEN 'missing_artifact' WHEN o_orderkey % 5 = 3 THEN 'artifact_drift' WHEN len(pages) = page_count THEN 'local_complete' ELSE 'local_partial' END AS verdict FROM conv""",
)
def evidence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the evidence of every conversion: eleven codes in order, else how much of the source it covers."""
    return conversions(spark, sf_dir).select("key", evidence_verdict().alias("verdict"))


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversions, their lines as pages, with what can be wrong by their number."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("pages"), F.max("l_linenumber").alias("top"))
    o = table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    when = lambda n, r, a, b: F.when(k % n == r, a).otherwise(b)
    md5 = F.md5(k.cast("string"))
    count = (F.coalesce("top", F.lit(1)) + when(11, 0, F.lit(1), F.lit(0))).cast("bigint")
    artifact = lambda kind, kept: F.struct(F.lit(kind).alias("kind"), md5.alias("sha256"), kept.alias("found_sha256"))
    found = F.when(k % 5 == 2, None).when(k % 5 == 3, F.lit("other")).otherwise(md5)
    artifacts = F.concat(F.array(artifact("markdown", md5), artifact("route-sidecar", found)), F.when(k % 7 == 1, F.array().cast("array<struct<kind: string, sha256: string, found_sha256: string>>")).otherwise(F.array(artifact("publication-evidence", md5))))
    evidence = F.struct(
        when(29, 1, F.lit(None).cast("string"), when(31, 2, F.lit("v1"), F.lit("v2"))).alias("schema"), when(37, 3, F.lit("old"), F.lit("now")).alias("contract"), when(23, 4, F.lit("fax"), F.lit("paddle")).alias("route"), k.cast("string").alias("source_key"),
        when(19, 5, F.lit("?"), F.col("o_custkey").cast("string")).alias("parent_key"), when(17, 6, F.lit("x"), md5).alias("md5"), md5.alias("sha256"), when(13, 7, count + 1, count).alias("page_count"), F.col("pages"), artifacts.alias("artifacts"),
    )
    return o.select(k.alias("key"), F.when(F.col("pages").isNotNull(), evidence).alias("evidence"), F.lit("now").alias("contract"), k.cast("string").alias("source_key"), F.col("o_custkey").cast("string").alias("parent_key"), md5.alias("md5"), md5.alias("sha256"), count.alias("page_count"), F.col("o_orderdate").alias("made_at"), F.col("o_orderstatus").alias("status"))


@query(
    "exact_else_newest",
    """WITH e AS (SELECT l_partkey AS key, l_suppkey % 3 AS md5, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS made_at FROM lineitem),
    r AS (SELECT p.p_partkey AS key, p.p_size % 3 AS want, e.id, row_number() OVER (PARTITION BY p.p_partkey ORDER BY (e.md5 = p.p_size % 3) DESC, e.made_at DESC, e.id DESC) AS k, e.md5 FROM part p JOIN e ON e.key = p.p_partkey) SELECT key, id, md5 = want AS exact FROM r WHERE k = 1""",
)
def exact_else_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the evidence of its own bytes, the newest of several, else the newest of all for its key."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_suppkey") % 3).alias("md5"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("made_at"))
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 3).alias("want"))
    best = F.max(F.struct((F.col("md5") == F.col("want")).alias("exact"), "made_at", "id"))
    return wanted.join(e, "key").groupBy("key").agg(best.alias("b")).select("key", "b.id", "b.exact")


@query(
    "delivery_gate",
    f"""WITH {_CONV}, v AS (SELECT o_orderkey AS key, CASE WHEN pages IS NULL THEN 'missing_evidence' WHEN o_orderpriority LIKE '1%' THEN 'not_bound' WHEN o_orderpriority LIKE '2%' THEN 'remote_missing' WHEN len(list_distinct(pages)) <> len(pages) THEN 'invalid_coverage' WHEN len(pages) = page_count THEN 'completed' ELSE 'uploaded_partial' END AS status FROM conv) SELECT * FROM v""",
)
def delivery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may count as delivered: accepted evidence, bound to an attachment, whose remote copy is the same; then by its coverage."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    c = conversions(spark, sf_dir).join(p, "key")
    pages = F.col("evidence")["pages"]
    status = F.when(F.col("evidence").isNull(), "missing_evidence").when(F.col("o_orderpriority").startswith("1"), "not_bound").when(F.col("o_orderpriority").startswith("2"), "remote_missing")
    return c.select("key", F.coalesce(status, coverage(pages, F.col("page_count"), F.lit(True)), F.lit("invalid_coverage")).alias("status"))


@query(
    "approvals",
    """WITH a AS (SELECT l_orderkey AS key, array_to_string(list_sort(list(l_linenumber || ':' || CASE WHEN l_discount > 0.09 THEN 'x' ELSE l_partkey::VARCHAR END)), ',') AS bound, array_to_string(list_sort(list(l_linenumber || ':' || l_partkey)), ',') AS current FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 'no launcher state' WHEN a.key IS NULL THEN 'no job' WHEN o_orderpriority LIKE '4%' THEN 'no approval' WHEN o_orderpriority LIKE '5%' THEN 'binds no artifacts' WHEN bound <> current THEN 'artifacts changed' ELSE 'approved' END AS verdict FROM orders LEFT JOIN a ON a.key = o_orderkey""",
)
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on approvals, in order; an approval holds while the hashes that it is bound to are those of now."""
    l = table(spark, sf_dir, "lineitem")
    pair = lambda v: F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "l_linenumber", v))), ",")
    a = l.groupBy(F.col("l_orderkey").alias("key")).agg(pair(F.when(F.col("l_discount") > 0.09, "x").otherwise(F.col("l_partkey").cast("string"))).alias("bound"), pair(F.col("l_partkey").cast("string")).alias("current"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority").join(a, "key", "left")
    p = F.col("o_orderpriority")
    return o.select("key", F.when(F.col("o_orderstatus") == "P", "no launcher state").when(F.col("bound").isNull(), "no job").when(p.startswith("4"), "no approval").when(p.startswith("5"), "binds no artifacts").when(F.col("bound") != F.col("current"), "artifacts changed").otherwise("approved").alias("verdict"))


# --- claims and recovery -----------------------------------------------------

_JOBS = "jobs AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS at_ts, count(*) AS n FROM events GROUP BY user_id), j AS (SELECT user_id, n, at_ts, CASE last WHEN 'signup' THEN 'local' WHEN 'view' THEN 'retryable' WHEN 'click' THEN 'uploading' WHEN 'purchase' THEN 'replaced' ELSE 'blocked_dirty' END AS state, (SELECT max(ts) FROM events) AS now FROM jobs)"


def jobs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, at_ts, state, now): users as jobs, their newest event as state; the present is the newest event of all."""
    e = table(spark, sf_dir, "events")
    last = F.max(F.struct("ts", "event_id", "event_type"))
    state = F.create_map(*(F.lit(x) for p in (("signup", "local"), ("view", "retryable"), ("click", "uploading"), ("purchase", "replaced"), ("error", "blocked_dirty")) for x in p))
    g = e.groupBy("user_id").agg(last.alias("b"), F.count("*").alias("n"))
    now = e.agg(F.max("ts")).scalar()  # a subquery of the plan, no action
    return g.select("user_id", "n", F.col("b.ts").alias("at_ts"), F.try_element_at(state, F.col("b.event_type")).alias("state"), now.alias("now"))


@query(
    "upload_claims",
    f"""WITH {_JOBS} SELECT user_id, state, CASE WHEN state IN ('local', 'retryable') OR (state = 'uploading' AND at_ts + INTERVAL 30 MINUTE <= now) THEN 'uploading' ELSE state END AS new_state, CASE WHEN state IN ('local', 'retryable') OR (state = 'uploading' AND at_ts + INTERVAL 30 MINUTE <= now) THEN 'worker' END AS owner,
      state NOT LIKE 'replaced%' AND state NOT LIKE 'blocked%' AND (state <> 'uploading' OR at_ts < now - INTERVAL 60 MINUTE) AS job_claimable, CASE WHEN state = 'uploading' AND n % 2 = 0 THEN 'retryable' ELSE state END AS after_error FROM j""",
)
def upload_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a claim makes of each job: free ones and those whose lease has run out go to the claimer; what an error of delivery makes of it."""
    j, state = jobs_of(spark, sf_dir), F.col("state")
    free = state.isin("local", "retryable") | ((state == "uploading") & (F.col("at_ts") + F.expr("INTERVAL 30 MINUTES") <= F.col("now")))
    claimable = ~F.startswith(state, F.lit("replaced")) & ~F.startswith(state, F.lit("blocked")) & ((state != "uploading") | (F.col("at_ts") < F.col("now") - F.expr("INTERVAL 60 MINUTES")))
    error = F.when((state == "uploading") & (F.col("n") % 2 == 0), "retryable").otherwise(state)
    return j.select("user_id", "state", F.when(free, "uploading").otherwise(state).alias("new_state"), F.when(free, "worker").alias("owner"), claimable.alias("job_claimable"), error.alias("after_error"))


@query("seed_candidates", f"WITH {_JOBS} SELECT coalesce(c.c_custkey, j.user_id) AS key, CASE WHEN j.user_id IS NULL THEN 'pending' WHEN c.c_custkey IS NULL THEN state WHEN state LIKE 'replaced%' OR state LIKE 'blocked%' OR state = 'in_progress' THEN state ELSE 'pending' END AS status, c.c_name AS title FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN j ON j.user_id = c.c_custkey")
def seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates written over what is known: states that are final, or being worked on, stay."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"))
    j = jobs_of(spark, sf_dir).select(F.col("user_id").alias("key"), "state")
    kept = F.startswith("state", F.lit("replaced")) | F.startswith("state", F.lit("blocked")) | (F.col("state") == "in_progress")
    status = F.when(F.col("state").isNull(), "pending").when(F.col("title").isNull() | kept, F.col("state")).otherwise("pending")
    return c.join(j, "key", "full").select("key", status.alias("status"), "title")


@query("evidence_commit", f"WITH {_JOBS} SELECT o_orderkey AS key, CASE WHEN state = 'uploading' AND at_ts + INTERVAL 30 MINUTE > now THEN 'refused' ELSE 'committed' END AS outcome, CASE WHEN state = 'uploading' AND at_ts + INTERVAL 30 MINUTE > now THEN 'uploading' ELSE 'local' END AS upload_state FROM orders LEFT JOIN j ON j.user_id = o_custkey")
def evidence_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New evidence of each conversion: refused while somebody's upload has not run out, else written, its upload beginning anew."""
    j = jobs_of(spark, sf_dir).select(F.col("user_id").alias("o_custkey"), ((F.col("state") == "uploading") & (F.col("at_ts") + F.expr("INTERVAL 30 MINUTES") > F.col("now"))).alias("busy"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey").join(j, "o_custkey", "left")
    busy = F.coalesce("busy", F.lit(False))
    return o.select("key", F.when(busy, "refused").otherwise("committed").alias("outcome"), F.when(busy, "uploading").otherwise("local").alias("upload_state"))


@query(
    "stage_migration",
    """WITH s AS (SELECT user_id, event_type AS stage, count(*) AS n, max(ts) AS at_ts FROM events GROUP BY user_id, event_type), st AS (SELECT user_id, stage, n, CASE WHEN n % 4 = 0 THEN 'completed' WHEN n % 4 = 1 THEN 'running' WHEN n % 4 = 2 THEN 'failed' ELSE 'skipped' END AS status, n % 8 = 1 AS has_owner, CASE stage WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS rank FROM s)
    SELECT user_id, string_agg(CASE WHEN status = 'running' AND NOT has_owner THEN stage END, ',' ORDER BY rank) AS interrupted, coalesce(arg_min(stage, rank) FILTER (WHERE status NOT IN ('completed', 'skipped')), arg_max(stage, rank)) AS current_stage, count(*) FILTER (WHERE status IN ('completed', 'skipped')) / count(*)::DOUBLE AS closed,
      CASE WHEN bool_or(stage = 'view' AND status = 'completed') AND NOT bool_or(stage = 'purchase' AND status = 'completed') THEN 'ready' WHEN bool_or(stage = 'purchase' AND status = 'completed') THEN 'skipped' ELSE 'waiting' END AS index_stage, sum(CASE WHEN status = 'failed' THEN least(n, 3) ELSE 0 END)::BIGINT AS attempts FROM st GROUP BY user_id""",
)
def stage_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old states brought to the new form: running stages without an owner are interrupted; the first open stage; the share that is closed; the state of a stage that is put in; attempts so far."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.count("*").alias("n"))
    n = F.col("n")
    order = F.create_map(*(F.lit(x) for p in (("signup", 1), ("view", 2), ("click", 3), ("purchase", 4)) for x in p))
    st = s.withColumns({"status": F.when(n % 4 == 0, "completed").when(n % 4 == 1, "running").when(n % 4 == 2, "failed").otherwise("skipped"), "rank": F.coalesce(F.try_element_at(order, F.col("stage")), F.lit(5))})
    closed, done = F.col("status").isin("completed", "skipped"), lambda stage: F.bool_or((F.col("stage") == stage) & (F.col("status") == "completed"))
    lost = F.array_sort(F.collect_list(F.when((F.col("status") == "running") & (n % 8 != 1), F.struct("rank", "stage"))))
    g = st.groupBy("user_id").agg(
        lost.alias("lost"), F.min(F.when(~closed, F.struct("rank", "stage"))).alias("open"), F.max(F.struct("rank", "stage")).alias("last"), (F.count_if(closed) / F.count("*")).alias("closed"), done("view").alias("viewed"), done("purchase").alias("bought"),
        F.sum(F.when(F.col("status") == "failed", F.least(n, F.lit(3))).otherwise(0)).cast("bigint").alias("attempts"),
    )
    index = F.when(F.col("viewed") & ~F.col("bought"), "ready").when(F.col("bought"), "skipped").otherwise("waiting")
    return g.select("user_id", F.nullif(F.array_join(F.transform("lost", lambda x: x["stage"]), ","), F.lit("")).alias("interrupted"), F.coalesce("open.stage", "last.stage").alias("current_stage"), "closed", index.alias("index_stage"), "attempts")


@query(
    "checkpoint_reuse",
    """WITH c AS (SELECT conv_id, count(*) AS units, min(turn) AS lo, max(turn) AS hi, count(DISTINCT turn) AS d, sum(length(text)) AS chars, md5(string_agg(text, '' ORDER BY turn)) AS artifact FROM conversations GROUP BY conv_id)
    SELECT conv_id, sha256(conv_id || '|fake|' || units || '|v1+' || left(artifact, 16)) AS idempotency_key, lo = 0 AND hi = units - 1 AND d = units AS contiguous, CASE WHEN NOT (lo = 0 AND hi = units - 1 AND d = units) THEN 'discard' WHEN conv_id % 4 = 0 THEN 'reuse' WHEN conv_id % 4 = 1 THEN 'changed' ELSE 'resume' END AS decision,
      CASE WHEN (lo = 0 AND hi = units - 1 AND d = units) AND conv_id % 4 >= 2 THEN units // 2 WHEN (lo = 0 AND hi = units - 1 AND d = units) AND conv_id % 4 = 0 THEN units ELSE 0 END AS next_unit FROM c""",
)
def checkpoint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job's checkpoint is good for: one with gaps is thrown away, a complete one whose artifact is the same is reused, of others the prefix."""
    t = table(spark, sf_dir, "conversations")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    c = t.groupBy("conv_id").agg(F.count("*").alias("units"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("d"), F.md5(whole).alias("artifact"))
    good, k = (F.col("lo") == 0) & (F.col("hi") == F.col("units") - 1) & (F.col("d") == F.col("units")), F.col("conv_id") % 4
    key = F.sha2(F.concat(F.col("conv_id"), F.lit("|fake|"), F.col("units"), F.lit("|v1+"), F.left("artifact", F.lit(16))), 256)
    decision = F.when(~good, "discard").when(k == 0, "reuse").when(k == 1, "changed").otherwise("resume")
    following = F.when(good & (k >= 2), F.floor(F.col("units") / 2)).when(good & (k == 0), F.col("units")).otherwise(0)
    return c.select("conv_id", key.alias("idempotency_key"), good.alias("contiguous"), decision.alias("decision"), following.cast("bigint").alias("next_unit"))


# --- matching, batches, classes ---------------------------------------------


@query(
    "result_matching",
    """WITH items AS (SELECT l_orderkey AS batch, l_linenumber AS item, 'id' || l_partkey AS data_id, 'f' || l_suppkey AS name FROM lineitem), results AS (SELECT l_orderkey AS batch, l_linenumber AS result, CASE WHEN l_returnflag <> 'N' THEN 'id' || l_partkey END AS data_id, 'f' || l_suppkey AS name FROM lineitem WHERE l_quantity > 3),
    by_id AS (SELECT batch, data_id, max(result) AS result FROM results WHERE data_id IS NOT NULL GROUP BY batch, data_id), by_name AS (SELECT batch, name, max(result) AS result FROM results GROUP BY batch, name HAVING count(*) = 1),
    m AS (SELECT i.batch, i.item, coalesce(a.result, b.result) AS result FROM items i LEFT JOIN by_id a USING (batch, data_id) LEFT JOIN by_name b USING (batch, name)) SELECT batch, count(*) AS items, count(result) = count(*) AS matched FROM m GROUP BY batch""",
)
def result_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a batch by their ids, else by a file name that is there once; with any item missing the batch has no match at all."""
    l = table(spark, sf_dir, "lineitem")
    row = lambda df, n: df.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias(n), F.concat(F.lit("id"), "l_partkey").alias("data_id"), F.concat(F.lit("f"), "l_suppkey").alias("name"), F.col("l_returnflag").alias("flag"))
    results = row(l.where("l_quantity > 3"), "result").withColumn("data_id", F.when(F.col("flag") != "N", F.col("data_id")))
    return match_results(row(l, "item").drop("flag"), results.drop("flag")).groupBy("batch").agg(F.count("*").alias("items"), (F.count("result") == F.count("*")).alias("matched"))


def match_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """items (batch, item, data_id, name) with the result of each, null where there is none."""
    by_id = results.where("data_id IS NOT NULL").groupBy("batch", "data_id").agg(F.max("result").alias("a"))
    by_name = results.groupBy("batch", "name").agg(F.max("result").alias("b"), F.count("*").alias("n")).where("n = 1").drop("n")
    return items.join(by_id, ["batch", "data_id"], "left").join(by_name, ["batch", "name"], "left").withColumn("result", F.coalesce("a", "b")).drop("a", "b")


@query(
    "model_batches",
    """WITH i AS (SELECT p_partkey AS k, CASE WHEN p_type = 'PROMO' THEN 'html' ELSE 'vlm' END AS model, p_size * 20 AS pages FROM part), parts AS (SELECT k, model, unnest(range(0, greatest(1, (pages + 199) // 200))) AS part, pages FROM i),
    r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY k, part) - 1 AS n FROM parts) SELECT k, model, part::BIGINT AS part, least(200, pages - part * 200)::BIGINT AS pages, n // 50 AS batch FROM r""",
)
def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items cut into parts of at most 200 pages, in batches of fifty for each model."""
    model = F.when(F.col("p_type") == "PROMO", "html").otherwise("vlm")
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), model.alias("model"), (F.col("p_size") * 20).alias("pages"))
    return parts_in_batches(i).select("k", "model", "part", F.col("pages").cast("bigint").alias("pages"), "batch")


def parts_in_batches(items: DataFrame, most_pages: int = 200, size: int = 50) -> DataFrame:
    """items (k, model, pages) with part, its pages, and the number of its batch.

    Ranks of a model are found by ranges of the key: each task numbers its own run, and runs
    are put together by their sums, so a model that has nearly all items is not one task.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("pages") / most_pages)).cast("bigint")
    p = items.withColumn("whole", F.col("pages")).select("k", "model", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("part"), "whole")
    p = p.withColumn("pages", F.least(F.lit(most_pages), F.col("whole") - F.col("part") * most_pages)).withColumn("_run", F.floor(F.col("k") / 65_536))
    within = F.row_number().over(Window.partitionBy("model", "_run").orderBy("k", "part")) - 1
    sums = p.groupBy("model", "_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("model").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = p.withColumn("_at", within).join(sums.withColumn("_before", before).drop("_n"), ["model", "_run"])
    return out.withColumn("batch", F.floor((F.col("_at") + F.col("_before")) / size).cast("bigint")).drop("_run", "_at", "_before", "whole")


@query("source_parts", "WITH p AS (SELECT l_orderkey AS source, count(*) AS parts, max(l_linenumber) AS expected, count(*) FILTER (WHERE l_linestatus = 'F') AS done FROM lineitem GROUP BY l_orderkey) SELECT source, parts, CASE WHEN parts < expected THEN 'incomplete' WHEN done = parts THEN 'merge' ELSE 'waiting' END AS state FROM p")
def source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each source: put together only once all are there and done."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(F.count("*").alias("parts"), F.max("l_linenumber").alias("expected"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    return p.select("source", "parts", F.when(F.col("parts") < F.col("expected"), "incomplete").when(F.col("done") == F.col("parts"), "merge").otherwise("waiting").alias("state"))


#: Keywords of the seat below; any not ASCII, or listed as a phrase, is matched as a part of the text.
LAW, ADJACENT, PHRASES = ("license", "copyright", "trade dress", "ñ"), ("token", "work", "ß"), ("trade dress",)


def keyword_matches(text: Column, keywords: tuple[str, ...], phrases: tuple[str, ...] = PHRASES) -> Column:
    """array<string> of the keywords in a text: ASCII words stand apart, with a plural s if they are one word; others are parts of it."""
    low = F.lower(text)

    def hit(k: str) -> Column:
        if any(ord(c) > 127 for c in k) or k in phrases:
            return F.contains(low, F.lit(k.lower()))
        plural = "" if " " in k or "-" in k else "s?"
        return low.rlike(rf"(?<![a-z0-9])\Q{k.lower()}\E{plural}(?![a-z0-9])")

    return F.array_compact(F.array(*(F.when(hit(k), F.lit(k)) for k in keywords)))


_KW = lambda words: "list_filter([" + ", ".join(f"CASE WHEN {('contains(lower(text), ' + repr(w) + ')') if any(ord(c) > 127 for c in w) or w in PHRASES else 'regexp_matches(lower(text), ' + repr('(^|[^a-z0-9])' + w + 's?($|[^a-z0-9])') + ')'} THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


@query(
    "classified_sources",
    f"""WITH k AS (SELECT doc_id, source, {_KW(LAW)} AS law, {_KW(ADJACENT)} AS adj FROM documents), c AS (SELECT *, CASE WHEN doc_id % 50 = 7 THEN 'clear-law' WHEN doc_id % 50 = 8 THEN 'adjacent-delete' WHEN len(law) > 0 THEN 'clear-law' WHEN len(adj) > 0 THEN 'adjacent-delete' ELSE 'nonlaw-delete' END AS class,
      CASE WHEN doc_id % 50 = 7 OR doc_id % 50 = 8 THEN 'listed' WHEN len(law) > 0 THEN 'law keyword: ' || array_to_string(law[1:5], ', ') WHEN len(adj) > 0 THEN 'adjacent keyword: ' || array_to_string(adj[1:5], ', ') ELSE 'no law keyword matched' END AS basis FROM k)
    SELECT doc_id, class, basis, CASE WHEN class = 'clear-law' THEN 'keep' ELSE 'delete' END AS policy, CASE WHEN e.vec_id IS NOT NULL THEN CASE WHEN class = 'clear-law' THEN 'skip-existing-keep-source' ELSE 'delete-source-existing' END ELSE CASE WHEN class = 'clear-law' THEN 'ocr-keep-source' ELSE 'ocr-delete-source' END END AS action,
      CASE WHEN source = 'src1' THEN CASE WHEN len(adj) > 0 THEN 0 ELSE 1 END WHEN len(law) > 0 THEN CASE WHEN len(adj) > 0 THEN 0 ELSE 1 END WHEN len(adj) > 0 THEN 0 ELSE 99 END AS priority FROM c LEFT JOIN embeddings e ON e.vec_id = c.doc_id""",
)
def classified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of sources by listed keys, then by keywords, with their basis; what may be deleted, what is to be done, and in which order."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 50
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("md"))
    m = d.select("doc_id", "source", keyword_matches(F.col("text"), LAW).alias("law"), keyword_matches(F.col("text"), ADJACENT).alias("adj")).join(e, "doc_id", "left")
    law, adj = F.size("law") > 0, F.size("adj") > 0
    kind = F.when(k == 7, "clear-law").when(k == 8, "adjacent-delete").when(law, "clear-law").when(adj, "adjacent-delete").otherwise("nonlaw-delete")
    said = lambda name, c: F.concat(F.lit(f"{name} keyword: "), F.array_join(F.slice(c, 1, 5), ", "))
    basis = F.when(k.isin(7, 8), "listed").when(law, said("law", "law")).when(adj, said("adjacent", "adj")).otherwise("no law keyword matched")
    keep, there = kind == "clear-law", F.coalesce("md", F.lit(False))
    action = F.when(there, F.when(keep, "skip-existing-keep-source").otherwise("delete-source-existing")).otherwise(F.when(keep, "ocr-keep-source").otherwise("ocr-delete-source"))
    priority = F.when((F.col("source") == "src1") | law, F.when(adj, 0).otherwise(1)).when(adj, 0).otherwise(99)
    return m.select("doc_id", kind.alias("class"), basis.alias("basis"), F.when(keep, "keep").otherwise("delete").alias("policy"), action.alias("action"), priority.alias("priority"))


@query(
    "revision_diff",
    """WITH a AS (SELECT o_custkey AS pack, o_orderpriority AS stage, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS template FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL), b AS (SELECT o_custkey AS pack, o_orderpriority AS stage, md5(string_agg((o_orderkey - o_orderkey % 2)::VARCHAR, ',' ORDER BY o_orderkey)) AS template FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' GROUP BY ALL)
    SELECT coalesce(a.pack, b.pack) AS pack, coalesce(a.stage, b.stage) AS stage, CASE WHEN a.template IS NULL THEN 'added' WHEN b.template IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.pack = b.pack AND a.stage = b.stage WHERE a.template IS DISTINCT FROM b.template""",
)
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a pack whose template differs between two revisions, those that came or went too."""
    o = table(spark, sf_dir, "orders")

    def revision(until: str, key: Column, name: str) -> DataFrame:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", key.cast("string").alias("v")))), lambda x: x["v"]), ",")
        return o.where(f"o_orderdate < timestamp_ntz'{until}'").groupBy(F.col("o_custkey").alias("pack"), F.col("o_orderpriority").alias("stage")).agg(F.md5(text).alias(name))

    k = F.col("o_orderkey")
    both = revision("1996-01-01", k, "a").join(revision("1996-06-01", k - k % 2, "b"), ["pack", "stage"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("pack", "stage", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


@query(
    "receipt_checks",
    """SELECT l_orderkey AS receipt, count(DISTINCT l_returnflag) = 3 AS all_evidence, bool_and(l_linestatus = 'F') AS all_passed, count(*) FILTER (WHERE l_discount >= 0.1) = 0 AS none_open, bool_and(l_suppkey <> l_partkey % 10) AS reviewers_differ,
      count(DISTINCT l_returnflag) = 3 AND bool_and(l_linestatus = 'F') AND count(*) FILTER (WHERE l_discount >= 0.1) = 0 AND bool_and(l_suppkey <> l_partkey % 10) AS valid FROM lineitem GROUP BY l_orderkey""",
)
def receipt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a receipt holds: all kinds of evidence, all passed, nothing open, nobody reviewing their own work."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("receipt")).agg(
        (F.countDistinct("l_returnflag") == 3).alias("all_evidence"), F.bool_and(F.col("l_linestatus") == "F").alias("all_passed"), (F.count_if(F.col("l_discount") >= 0.1) == 0).alias("none_open"), F.bool_and(F.col("l_suppkey") != F.col("l_partkey") % 10).alias("reviewers_differ")
    )
    return g.withColumn("valid", F.col("all_evidence") & F.col("all_passed") & F.col("none_open") & F.col("reviewers_differ"))


@query(
    "conversion_inventory",
    f"""WITH {_CONV} SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'blocked_dirty_text_layer' END AS status, count(*) AS files, sum(CASE WHEN pages IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_markdown, sum(coalesce(page_count, 0))::BIGINT AS known_pages, round(sum(o_totalprice) / 1048576, 1) AS size_mb,
      count(*) FILTER (WHERE o_totalprice > 400000) AS giant, count(*) FILTER (WHERE o_orderpriority LIKE '1%' AND o_totalprice > 100000 AND o_totalprice <= 400000) AS banded FROM conv GROUP BY 1""",
)
def conversion_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all conversions by status: files, those without a result, pages, sizes, giants and those in a band of sizes."""
    c = conversions(spark, sf_dir).select("key", "page_count", F.col("evidence").isNull().alias("bare"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_totalprice", "o_orderpriority").join(c, "key")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("blocked_dirty_text_layer")
    size = F.col("o_totalprice")
    return o.groupBy(status.alias("status")).agg(
        F.count("*").alias("files"), F.count_if("bare").alias("without_markdown"), F.sum("page_count").cast("bigint").alias("known_pages"), F.round(F.sum(size) / 1048576, 1).alias("size_mb"), F.count_if(size > 400000).alias("giant"),
        F.count_if(F.col("o_orderpriority").startswith("1") & (size > 100000) & (size <= 400000)).alias("banded"),
    )


@query("report_rows", r"SELECT p_partkey AS k, '| ' || p_partkey || ' | ' || replace(replace(p_name || '|' || p_brand || chr(10), '|', '\|'), chr(10), ' ') || ' |' AS row FROM part")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report as a table of Markdown, bars and line ends escaped."""
    cell = F.concat(F.col("p_name"), F.lit("|"), F.col("p_brand"), F.lit("\n"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("| "), F.col("p_partkey"), F.lit(" | "), table_cell(cell), F.lit(" |")).alias("row"))


def table_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


@query(
    "fill_missing",
    r"""SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN regexp_replace(p.html, '<[^>]*>', '', 'g') ELSE 'own' END = 'own' AS own, CASE WHEN d.doc_id % 3 = 0 THEN md5(regexp_replace(p.html, '<[^>]*>', '', 'g')) END AS proposed_md5 FROM documents d JOIN pages p ON p.page_id = d.doc_id""",
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second source can add to an item: only to fields that are empty, without markup."""
    own = F.when(F.col("doc_id") % 3 == 0, "").otherwise("own")
    d = table(spark, sf_dir, "documents").select("doc_id", own.alias("abstract"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "").alias("found"))
    return d.join(p, "doc_id").select("doc_id", (F.col("abstract") != "").alias("own"), F.when(F.col("abstract") == "", F.md5("found")).alias("proposed_md5"))
