"""Leases on jobs as state of a stream: claims race, one owner holds a job at a time, a timer ends what has run out.

Each job has one state: who holds it until when. Events wait until the watermark has
passed them, so that they count in the order in which they happened, however they arrive;
timers wake a job for that and at the end of its lease. A job whose lease has run out is
free for the next claim even if its owner never comes back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..registry import query
from ..sources.shared import prepare
from .windows import event_stream, run_to_end

MINUTE = 60_000
#: Events that wait go into state so many at a time: each entry is a message of its own to the store.
HELD = 1_000
OUT = "job long, event_id long, at_ms long, outcome string, owner string, until_ms long"


def step(lease: tuple[str, str | None, int], at: int, kind: str, owner: str | None, length: int) -> tuple[tuple[str, str | None, int], str]:
    """The lease (state, owner, until) after an event, and what came of the event.

    A claim is granted on a job that is free, and on one whose lease has run out; owners
    alone can deliver or give back; new evidence is refused while a lease holds.
    """
    state, holder, until = lease
    if kind == "claim":
        if state in ("local", "retryable", "expired"):
            return ("uploading", owner, at + length), "taken_over" if state == "expired" else "granted"
        return lease, "refused"
    if kind == "commit":
        return (lease, "refused") if state == "uploading" else (("local", None, 0), "committed")
    if state != "uploading":
        return lease, "no_lease"
    if holder != owner:
        return lease, "not_owner"
    return (("replaced", None, 0), "delivered") if kind == "deliver" else (("retryable", None, 0), "given_back")


class Leases(StatefulProcessor):
    """One lease for each job; `length` in milliseconds."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "state string, owner string, until long, event_id long")
        self.waiting = handle.getListState("waiting", "events string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        while some := [r["event"] for r in islice(rows, HELD)]:
            held = f"[{','.join(some)}]"
            self.waiting.appendValue((held,))
            least = min(e["at"] for e in json.loads(held))
            first = least if first is None else min(first, least)
        self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [(e["at"], e["event_id"], e["kind"], e["owner"]) for (events,) in self.waiting.get() for e in json.loads(events)]
        due, later = sorted(w for w in held if w[0] <= now), [w for w in held if w[0] > now]
        *lease, granted = tuple(self.lease.get()) if self.lease.exists() else ("local", None, 0, None)
        lease, out = tuple(lease), []

        def end(at: int) -> None:
            nonlocal lease
            if lease[0] == "uploading" and lease[2] <= at:
                out.append((*key, granted, lease[2], "expired", lease[1], lease[2]))
                lease = ("expired", None, 0)

        for at, event_id, kind, owner in due:
            end(at)
            lease, outcome = step(lease, at, kind, owner, self.length)
            if outcome in ("granted", "taken_over"):
                granted = event_id
            out.append((*key, event_id, at, outcome, owner, lease[2] if lease[0] == "uploading" else None))
        end(now)
        self.lease.update((*lease, granted))
        if len(due) and later:
            kept = [dict(zip(("at", "event_id", "kind", "owner"), w, strict=True)) for w in later]
            self.waiting.put([(json.dumps(kept[at : at + HELD]),) for at in range(0, len(kept), HELD)])
        elif len(due):
            self.waiting.clear()
        if later:
            self.handle.registerTimer(min(w[0] for w in later))
        if lease[0] == "uploading":
            self.handle.registerTimer(lease[2])
        for o in out:
            yield Row(job=o[0], event_id=o[1], at_ms=o[2], outcome=o[3], owner=o[4], until_ms=o[5])

    def close(self) -> None:
        pass


def leases(events: DataFrame, minutes: int = 30) -> DataFrame:
    """What comes of each event of a stream (job, event_id, ts, kind, owner), and a row for each lease that ran out.

    Kinds are claim, commit, deliver and fail; ts needs a watermark, below which events
    that are late are lost, as in any stream. Of equal times the smaller event_id counts first.
    """
    # an event is one value on its way to Python, into state and back, as each value costs there; ts is what the watermark looks at
    event = F.to_json(F.struct(F.unix_millis("ts").alias("at"), "event_id", "kind", "owner"), {"ignoreNullFields": "false"})
    rows = events.select("job", "ts", event.alias("event"))
    return rows.groupBy("job").transformWithState(statefulProcessor=Leases(minutes * MINUTE), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


@query(
    "lease_race",
    """WITH RECURSIVE x AS (SELECT user_id AS job, event_id, epoch_us(ts) // 1000 AS at_ms, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'claim' WHEN 'signup' THEN 'commit' WHEN 'purchase' THEN 'deliver' ELSE 'fail' END AS kind,
      CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'signup' THEN NULL ELSE CASE WHEN (props::JSON->>'k')::INT % 2 = 0 THEN 'a' ELSE 'b' END END AS owner FROM events),
    w AS (SELECT least(max(epoch_us(ts)) FILTER (WHERE event_type = 'click'), max(epoch_us(ts)) FILTER (WHERE event_type <> 'click')) // 1000 - 600000 AS now FROM events),
    e AS (SELECT x.*, row_number() OVER (PARTITION BY job ORDER BY at_ms, event_id) AS rn FROM x, w WHERE at_ms <= now),
    r AS (SELECT DISTINCT job, 0::BIGINT AS rn, 'local' AS state, NULL::VARCHAR AS holder, 0::BIGINT AS until, NULL::BIGINT AS granted, NULL::BIGINT AS event_id, NULL::BIGINT AS at_ms, NULL::VARCHAR AS outcome, NULL::VARCHAR AS owner, NULL::BIGINT AS ran_out, NULL::BIGINT AS ran_out_at, NULL::VARCHAR AS ran_out_of FROM e
      UNION ALL
      SELECT job, rn, CASE WHEN outcome IN ('granted', 'taken_over') THEN 'uploading' WHEN outcome = 'committed' THEN 'local' WHEN outcome = 'delivered' THEN 'replaced' WHEN outcome = 'given_back' THEN 'retryable' ELSE s END,
        CASE WHEN outcome IN ('granted', 'taken_over') THEN owner WHEN s = 'uploading' AND outcome IN ('refused', 'not_owner') THEN holder END, CASE WHEN outcome IN ('granted', 'taken_over') THEN at_ms + 1800000 WHEN s = 'uploading' AND outcome IN ('refused', 'not_owner') THEN until ELSE 0 END,
        CASE WHEN outcome IN ('granted', 'taken_over') THEN event_id ELSE granted END, event_id, at_ms, outcome, owner, CASE WHEN over THEN granted END, CASE WHEN over THEN until END, CASE WHEN over THEN holder END
      FROM (SELECT *, CASE kind WHEN 'claim' THEN CASE s WHEN 'expired' THEN 'taken_over' WHEN 'local' THEN 'granted' WHEN 'retryable' THEN 'granted' ELSE 'refused' END WHEN 'commit' THEN CASE WHEN s = 'uploading' THEN 'refused' ELSE 'committed' END
          ELSE CASE WHEN s <> 'uploading' THEN 'no_lease' WHEN holder IS DISTINCT FROM owner THEN 'not_owner' WHEN kind = 'deliver' THEN 'delivered' ELSE 'given_back' END END AS outcome
        FROM (SELECT e.*, r.holder, r.until, r.granted, r.state = 'uploading' AND r.until <= e.at_ms AS over, CASE WHEN r.state = 'uploading' AND r.until <= e.at_ms THEN 'expired' ELSE r.state END AS s FROM r JOIN e ON e.job = r.job AND e.rn = r.rn + 1))),
    last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY job ORDER BY rn DESC) = 1)
    SELECT job, event_id, at_ms, outcome, owner, CASE WHEN state = 'uploading' THEN until END AS until_ms FROM r WHERE rn > 0
    UNION ALL SELECT job, ran_out, ran_out_at, 'expired', ran_out_of, ran_out_at FROM r WHERE ran_out_at IS NOT NULL
    UNION ALL SELECT job, granted, until, 'expired', holder, until FROM last, w WHERE state = 'uploading' AND until <= now""",
)
def lease_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, one of the claims of worker a, the other of those of b and of what owners report, race for the same jobs; all that the watermark, that of the slower stream, has passed."""
    prepare(spark)
    token = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "a").otherwise("b")
    kind = F.when(F.col("event_type").isin("click", "view"), "claim").when(F.col("event_type") == "signup", "commit").when(F.col("event_type") == "purchase", "deliver").otherwise("fail")
    owner = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").when(F.col("event_type") != "signup", token)
    one, other = (event_stream(spark, sf_dir, F.col("event_type") == "click"), event_stream(spark, sf_dir, F.col("event_type") != "click"))
    stream = one.unionByName(other).select(F.col("user_id").alias("job"), "event_id", "ts", kind.alias("kind"), owner.alias("owner"))
    setting, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, provider)
    try:
        return run_to_end(leases(stream), "append")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
