"""What of a former run is reused, gone on from, or thrown away."""

import json

from pyspark.sql import functions as F

from quillspark.operators import resume as R


def test_decisions(spark):
    ok = {"schema": R.SCHEMA, "unit": 0, "key": "k", "next_index": 2, "texts": ["a", "b"]}
    cases = {  # unit: (completion, checkpoint, files, expected)
        1: (None, None, {}, ("start", 0, None)),
        2: (("k", 3, [("o", "s")]), None, {"o": "s"}, ("reuse", 3, None)),
        3: (("old", 3, [("o", "s")]), None, {"o": "s"}, ("start", 0, "other_key")),
        4: (("k", 2, [("o", "s")]), None, {"o": "s"}, ("start", 0, "other_counts")),
        5: (("k", 3, [("o", "s")]), None, {"o": "t"}, ("start", 0, "artifact_changed")),
        6: (("k", 3, [("o", "s"), ("p", "s")]), None, {"o": "s"}, ("start", 0, "artifact_changed")),
        7: (("k", 3, []), None, {"o": "s"}, ("start", 0, "artifact_changed")),
        8: (None, ok, {}, ("resume", 2, None)),
        9: (("old", 3, [("o", "s")]), ok, {}, ("resume", 2, "other_key")),
        10: (None, ok | {"key": "old"}, {}, ("start", 0, "other_key")),
        11: (None, ok | {"texts": ["a"]}, {}, ("start", 0, "incomplete")),
        12: (None, ok | {"texts": ["a", None]}, {}, ("start", 0, "incomplete")),
        13: (None, ok | {"schema": "v0"}, {}, ("start", 0, "unreadable")),
        14: (None, '{"schema": "checkpo', {}, ("start", 0, "unreadable")),
        15: (None, ok | {"next_index": 9, "texts": ["x"] * 9}, {}, ("start", 0, "incomplete")),
        16: (None, ok | {"unit": 3}, {}, ("start", 0, "unreadable")),
    }
    units = spark.createDataFrame([(u, "k", 3) for u in cases], "unit long, key string, chunks long")
    done = spark.createDataFrame([(u, *c[0]) for u, c in cases.items() if c[0]], "unit long, key string, chunks long, artifacts array<struct<path string, sha string>>")
    stored = [(u, c[1] if isinstance(c[1], str) else json.dumps(c[1] | {"unit": c[1]["unit"] or u})) for u, c in cases.items() if c[1]]
    files = [(u, p, s) for u, c in cases.items() for p, s in c[2].items()]
    out = R.plan(units, done, spark.createDataFrame(stored, "unit long, json string"), spark.createDataFrame(files, "unit long, path string, sha string"))
    assert {r["unit"]: tuple(r)[1:] for r in out.collect()} == {u: c[3] for u, c in cases.items()}


def test_keys_tell_their_parts_apart(spark):
    rows = [("a", "b", "c", "d", "e"), ("ab", "", "c", "d", "e"), ("a", "bc", "", "d", "e"), ("a", "b", "c", "d", None), ("a", "b", "c", "d", ""), ("a", "b", "c", "d", "-")]
    keys = spark.createDataFrame(rows, "t string, p string, c string, y string, q string").select(R.idempotency_key(*map(F.col, "tpcyq"))).collect()
    assert len({k[0] for k in keys}) == len(rows)
