"""Leases: the table of outcomes, races, takeovers by a timer; against the SQL over the event log in test_queries."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources.shared import prepare
from quillspark.streaming.leases import HELD, MINUTE, Leases, leases, step
from quillspark.streaming.windows import run_to_end


@pytest.mark.parametrize(
    ("lease", "kind", "owner", "after", "outcome"),
    [
        (("local", None, 0), "claim", "a", ("uploading", "a", 107), "granted"),
        (("retryable", None, 0), "claim", "a", ("uploading", "a", 107), "granted"),
        (("expired", None, 0), "claim", "b", ("uploading", "b", 107), "taken_over"),
        (("uploading", "a", 120), "claim", "b", ("uploading", "a", 120), "refused"),
        (("uploading", "a", 120), "claim", "a", ("uploading", "a", 120), "refused"),
        (("replaced", None, 0), "claim", "a", ("replaced", None, 0), "refused"),
        (("uploading", "a", 120), "commit", None, ("uploading", "a", 120), "refused"),
        (("replaced", None, 0), "commit", None, ("local", None, 0), "committed"),
        (("uploading", "a", 120), "deliver", "b", ("uploading", "a", 120), "not_owner"),
        (("uploading", "a", 120), "deliver", "a", ("replaced", None, 0), "delivered"),
        (("uploading", "a", 120), "fail", "a", ("retryable", None, 0), "given_back"),
        (("expired", None, 0), "deliver", "a", ("expired", None, 0), "no_lease"),
    ],
)
def test_what_comes_of_an_event(lease, kind, owner, after, outcome):
    assert step(lease, 100, kind, owner, 7) == (after, outcome)


def run(spark, folder, files):
    """The rows of all files, a file a batch, through the stream."""
    prepare(spark)
    schema = "job long, event_id long, ts timestamp, kind string, owner string"
    for i, rows in enumerate(files):
        (folder / f"{i}.json").write_text("".join(json.dumps(dict(zip(("job", "event_id", "ts", "kind", "owner"), r, strict=True))) + "\n" for r in rows))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in the order of their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "10 minutes")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = run_to_end(leases(stream), "append")
        return sorted(out.select("job", (F.col("at_ms") / MINUTE % 1440).cast("int"), "event_id", "outcome", "owner").collect(), key=lambda r: (r[0], r[1], r[2]))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minute):
    return f"2024-05-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def test_one_owner_and_takeover_by_a_timer(spark, tmp_path):
    """Of claims of one instant the smaller id wins; the lease of job 2 ends although nobody asks; late rows of a batch count in the order of their time."""
    first = [(1, 11, at(0), "claim", "b"), (1, 10, at(0), "claim", "a"), (2, 20, at(1), "claim", "a"), (1, 12, at(5), "claim", "c")]
    second = [(1, 14, at(31), "claim", "b"), (1, 13, at(29), "claim", "c"), (3, 30, at(50), "claim", "a")]
    third = [(3, 31, at(55), "deliver", "a"), (1, 15, at(40), "deliver", "a"), (9, 90, at(200), "commit", None)]
    out = [tuple(r) for r in run(spark, tmp_path, [first, second, third])]
    assert out == [
        (1, 0, 10, "granted", "a"), (1, 0, 11, "refused", "b"), (1, 5, 12, "refused", "c"), (1, 29, 13, "refused", "c"), (1, 30, 10, "expired", "a"), (1, 31, 14, "taken_over", "b"), (1, 40, 15, "not_owner", "a"), (1, 61, 14, "expired", "b"),
        (2, 1, 20, "granted", "a"), (2, 31, 20, "expired", "a"),
        (3, 50, 30, "granted", "a"), (3, 55, 31, "delivered", "a"),
    ]
    held = [r for r in out if r[3] in ("granted", "taken_over")]
    assert len(held) == 4 and [r[2] for r in held if r[0] == 1] == [10, 14]


class Handle:
    """State that counts what is sent to it."""

    def __init__(self):
        self.sent, self.timers = [], []

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def appendValue(self, value):
        self.sent.append(value)

    def appendList(self, values):
        self.sent.extend(values)

    def registerTimer(self, at):
        self.timers.append(at)


def test_events_wait_together():
    """A value in state for each thousand events of a batch, not one for each."""
    n, held = 2 * HELD + 1, Leases(MINUTE)
    held.init(handle := Handle())
    rows = ({"at_ms": n - i, "event_id": i, "kind": "claim", "owner": "a", "event": json.dumps({"at": n - i, "event_id": i, "kind": "claim", "owner": "a"})} for i in range(n))
    assert list(held.handleInputRows((1,), rows, None)) == [] and handle.timers == [1]
    assert len(handle.sent) == 3 and sum(len(json.loads(v[0])) for v in handle.sent) == n


def test_many_events_of_one_job(spark, tmp_path):
    """More than go into one value of state; owners as they are written."""
    owners = ["a", 'b "x"', "é\\n,]", None]
    events = [(7, i, at(i % 1380), "claim" if i % 3 else "fail", owners[i % 4]) for i in range(2 * HELD + 300)]
    lease, granted, want = ("local", None, 0), None, []
    for _, i, _, kind, owner in sorted(events, key=lambda e: (e[1] % 1380, e[1])):
        minute = i % 1380
        if lease[0] == "uploading" and lease[2] <= minute:
            want.append((7, lease[2], granted, "expired", lease[1]))
            lease = ("expired", None, 0)
        lease, outcome = step(lease, minute, kind, owner, 30)
        granted = i if outcome in ("granted", "taken_over") else granted
        want.append((7, minute, i, outcome, owner))
    if lease[0] == "uploading":
        want.append((7, lease[2], granted, "expired", lease[1]))
    got = [tuple(r) for r in run(spark, tmp_path, [[*events, (9, 90_000, at(1430), "commit", None)]])]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
