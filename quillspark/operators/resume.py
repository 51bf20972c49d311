"""What of a former run is still good: completions whose artifacts stand, checkpoints whose prefix can be gone on from.

Both are bound to a key of all that a result depends on. A completion is reused if its key
is that of now, its counts are right and every artifact is the file that it names. Else a
checkpoint is resumed if it can be read, has the key and as many results as it says. Else
the unit begins anew. Units meet their records by equi-joins; nothing is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

SCHEMA = "checkpoint-v1"
CHECKPOINT = "schema string, unit bigint, key string, next_index int, texts array<string>"


def idempotency_key(task_sha: Column, provider: Column, config: Column, policy: Column, passes: Column) -> Column:
    """One hash of a task, the provider and its configuration, the policy and what makes up a pass; a null is not an empty part."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat_ws("|", *(part(c) for c in (task_sha, provider, config, policy, passes))), 256)


def read_checkpoints(records: DataFrame) -> DataFrame:
    """(unit, c, held) of stored records (unit, json): c is null where the record is cut off or not of this schema; held is whether its results are all there."""
    c = F.from_json("json", CHECKPOINT, {"mode": "PERMISSIVE"})
    whole = (F.col("c.schema") == SCHEMA) & (F.col("c.unit") == F.col("unit")) & F.col("c.key").isNotNull()
    read = records.withColumn("c", c).withColumn("c", F.when(whole, F.col("c")))
    return read.select("unit", "c", F.coalesce((F.size("c.texts") == F.col("c.next_index")) & ~F.exists("c.texts", lambda t: t.isNull()), F.lit(False)).alias("held"))


def plan(units: DataFrame, completions: DataFrame, checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, decision, next_index, reason) of units (unit, key, chunks).

    completions (unit, key, chunks, artifacts array<struct<path, sha>>), checkpoints
    (unit, json) and files (unit, path, sha) are what is stored; a unit has one record of
    each at most, the files any number. decision is reuse, resume or start; reason says what
    a record lacked.
    """
    there = files.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("path", "sha"))).alias("files"))
    done = completions.select("unit", F.struct("key", "chunks", "artifacts").alias("d"))
    u = units.join(done, "unit", "left").join(read_checkpoints(checkpoints).withColumn("stored", F.lit(True)), "unit", "left").join(there, "unit", "left")
    same = F.coalesce((F.size("d.artifacts") > 0) & F.forall("d.artifacts", lambda a: F.coalesce(F.try_element_at("files", a["path"]) == a["sha"], F.lit(False))), F.lit(False))
    wrong = F.when(F.col("d").isNull(), None).when(F.col("d.key") != F.col("key"), "other_key").when(F.col("d.chunks") != F.col("chunks"), "other_counts").when(~same, "artifact_changed")
    bad = F.when(F.col("stored").isNull(), None).when(F.col("c").isNull(), "unreadable").when(F.col("c.key") != F.col("key"), "other_key").when(~F.col("held") | (F.col("c.next_index") > F.col("chunks")), "incomplete")
    u = u.withColumns({"wrong": wrong, "bad": bad})
    reuse, resume = F.col("d").isNotNull() & F.col("wrong").isNull(), F.col("stored").isNotNull() & F.col("bad").isNull()
    decision = F.when(reuse, "reuse").when(resume, "resume").otherwise("start")
    at = F.when(reuse, F.col("chunks")).when(resume, F.col("c.next_index")).otherwise(0).cast("bigint")
    return u.select("unit", decision.alias("decision"), at.alias("next_index"), F.when(reuse, None).otherwise(F.coalesce("wrong", "bad")).alias("reason"))


# --- the seat: conversations are units, a run before this one left records of them ----

_JOINED = "string_agg(text, chr(10) ORDER BY turn)"


@query(
    "resume_plan",
    f"""WITH u AS (SELECT conv_id AS unit, count(*) AS chunks, {_JOINED} AS text, arg_min(role, turn) AS provider, min(CASE WHEN length(text) > 900 THEN turn END) AS stopped FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id AS unit, count(*) AS n, sum(length(c.text)) AS size FROM conversations c JOIN u ON u.unit = c.conv_id WHERE c.turn < stopped GROUP BY c.conv_id)
    SELECT unit, CASE WHEN provider <> 'user' THEN 'start' WHEN stopped IS NULL THEN CASE WHEN regexp_matches(text, '[0-9]') THEN 'start' ELSE 'reuse' END WHEN coalesce(size, 0) > 900 OR coalesce(n, 0) <> stopped THEN 'start' ELSE 'resume' END AS decision,
      CASE WHEN provider <> 'user' THEN 0 WHEN stopped IS NULL THEN CASE WHEN regexp_matches(text, '[0-9]') THEN 0 ELSE chunks END WHEN coalesce(size, 0) > 900 OR coalesce(n, 0) <> stopped THEN 0 ELSE stopped END AS next_index,
      CASE WHEN stopped IS NULL THEN CASE WHEN provider <> 'user' THEN 'other_key' WHEN regexp_matches(text, '[0-9]') THEN 'artifact_changed' END WHEN coalesce(size, 0) > 900 THEN 'unreadable' WHEN provider <> 'user' THEN 'other_key' WHEN coalesce(n, 0) <> stopped THEN 'incomplete' END AS reason
    FROM u LEFT JOIN p USING (unit)""",
)
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do of each conversation after a run that stopped at turns of over 900 characters, ran under the name of whoever began, lost the end of long records, and whose files lost their numbers since."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), "turn", "role", "text")
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    u = t.groupBy("unit").agg(rows.alias("r")).withColumn("text", F.array_join(F.transform("r", lambda x: x["text"]), "\n"))
    u = u.withColumns({"stopped": F.get(F.filter("r", lambda x: F.length(x["text"]) > 900), F.lit(0))["turn"], "provider": F.get("r", F.lit(0))["role"]})
    key = lambda provider: idempotency_key(F.sha2("text", 256), provider, F.lit("model"), F.lit("v1"), F.lit("draft"))
    out = F.upper("text")
    units = u.select("unit", key(F.lit("user")).alias("key"), F.size("r").cast("bigint").alias("chunks"))
    completions = u.where("stopped IS NULL").select("unit", key(F.col("provider")).alias("key"), F.size("r").cast("bigint").alias("chunks"), F.array(F.struct(F.lit("out.md").alias("path"), F.sha2(out, 256).alias("sha"))).alias("artifacts"))
    files = u.where("stopped IS NULL").select("unit", F.lit("out.md").alias("path"), F.sha2(F.regexp_replace(out, "[0-9]+", "#"), 256).alias("sha"))
    done = F.filter("r", lambda x: x["turn"] < F.col("stopped"))
    texts = F.transform(done, lambda x: F.upper(x["text"]))
    size = F.aggregate(done, F.lit(0), lambda a, x: a + F.length(x["text"]))
    record = F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), "unit", key(F.col("provider")).alias("key"), F.col("stopped").cast("int").alias("next_index"), texts.alias("texts")))
    checkpoints = u.where("stopped IS NOT NULL").select("unit", F.when(size > 900, F.left(record, F.lit(600))).otherwise(record).alias("json"))
    return plan(units, completions, checkpoints, files)
