"""Extensions over streams: event-time windows, sessions, deduplication and latest states of events.

Each runs what is there through readStream with the trigger availableNow and a watermark,
writes to a folder that the cluster shares, and reads the result back. Fed by new files,
the same queries go on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import shared_dir
from ..sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str, some: Column | bool = True) -> DataFrame:
    """Events, all or some, as a stream of files, event time in `ts`, late by ten minutes at most."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return e.where(F.lit(some) if some is True else some).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


def run_to_end(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a stream gives over all that is there.

    In `append` mode rows are final: a window is written once the watermark has passed it.
    In `update` mode each batch writes the rows that it changed, in a folder of its own, so
    that a batch that runs again replaces what it wrote; of the rows of a key the newest
    batch's counts. In both the watermark lets go of state.
    """
    spark, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch bigint").parquet(f"{at}/out")
    values = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.col("batch")).alias("_v")
    return rows.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))


@query(
    "stream_tumbling",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of events by hour and type."""
    g = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return run_to_end(g, "update", ("w", "event_type")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding",
    "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 3 HOUR) + INTERVAL 3 HOUR]) AS s FROM events) GROUP BY s",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events in windows of six hours that start each three."""
    g = event_stream(spark, sf_dir).groupBy(F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count("*").alias("n"))
    return run_to_end(g, "update", ("w",)).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "stream_sessions",
    """WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM b)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, which end after four hours without an event; those that the watermark, ten minutes behind the newest event, has passed."""
    g = event_stream(spark, sf_dir).groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return run_to_end(g, "append").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedupe", "SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, however often it was delivered within the watermark."""
    return run_to_end(event_stream(spark, sf_dir).dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "append")


@query("stream_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY user_id")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of each job, kept up to date."""
    g = event_stream(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))
    return run_to_end(g, "update", ("user_id",))


@query("approximate_counts")
def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different users and quantiles of values by type from sketches of bounded size."""
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", [0.5, 0.9], 10000).alias("quantiles"))
