"""Versioned tables: a version is whole or not there; incremental sync on top of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.operators.index_sync import INDEX, sync_index
from quillspark.sources.versions import Conflict, VersionedTable

ROWS = "parent long, value string"


@pytest.fixture
def store(spark, tmp_path):
    out = VersionedTable(spark, f"file://{tmp_path}/t", "parent", ROWS, buckets=4)
    out.overwrite(rows(spark, [(k, f"v{k}") for k in range(40)] + [(None, "no key")]))
    return out


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def held(store, version=None):
    return sorted((tuple(r) for r in store.read(version).collect()), key=repr)


def test_replace_writes_touched_buckets_alone(spark, store):
    before, folders = held(store), store.folders()
    assert store.replace(rows(spark, [(3, "")]).select("parent"), rows(spark, [(3, "new"), (3, "newer")])) == 2
    assert held(store) == sorted([r for r in before if r[0] != 3] + [(3, "new"), (3, "newer")], key=repr) and held(store, 1) == before
    assert sum(store.folders()[b] != folders[b] for b in folders) == 1
    assert store.replace(rows(spark, [(3, "")]).select("parent"), rows(spark, [])) == 3 and held(store) == [r for r in before if r[0] != 3]
    assert store.replace(rows(spark, []).select("parent"), rows(spark, [])) == 3


def test_a_write_that_fails_half_way_keeps_the_old_rows(spark, store):
    before = held(store)

    @F.udf("string")
    def broken(k):
        if k == 17:
            raise ValueError("lost")
        return "new"

    new = spark.range(40).select(F.col("id").alias("parent"), broken("id").alias("value"))
    with pytest.raises(Exception, match="lost"):
        store.replace(new.select("parent"), new)
    with pytest.raises(Exception, match="lost"):
        store.overwrite(new)
    assert store.version() == 1 and held(store) == before
    left = store._names(f"{store.path}/data")
    store.clear_unused()
    assert held(store) == before and len(left) >= len(store._names(f"{store.path}/data")) == 1


def test_of_two_writers_one_wins(spark, store):
    base = store.version()
    one, other = rows(spark, [(1, "one")]), rows(spark, [(1, "other")])
    assert store.replace(one.select("parent"), one, base) == 2
    with pytest.raises(Conflict):
        store.replace(other.select("parent"), other, base)
    assert (1, "one") in held(store) and (1, "other") not in held(store) and store.version() == 2


def test_an_empty_table(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/e", "parent", ROWS)
    assert store.version() == 0 and store.read().count() == 0
    assert store.replace(rows(spark, [(1, "a")]).select("parent"), rows(spark, [(1, "a")])) == 1 and held(store) == [(1, "a")]
    store.overwrite(rows(spark, []))
    assert held(store) == [] and held(store, 1) == [(1, "a")]


DAY = [dt.datetime(2024, 1, d) for d in range(1, 10)]


def sync(store, spark, items, chunks, contract="c1", full=False):
    i = spark.createDataFrame([(k, DAY[d], b) for k, d, b in items], "parent long, date_modified timestamp_ntz, body string")
    c = spark.createDataFrame(chunks, "parent long, chunk_idx int, body string, sha string")
    return sync_index(store, i, c, contract, "p1", full)


def chunks_of(store, parent):
    return [(r["chunk_idx"], r["body"], r["source"], r["written"]) for r in store.read().where(F.col("parent") == parent).where("chunk_idx IS NOT NULL").orderBy("chunk_idx").collect()]


def test_sync(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/i", "parent", INDEX, buckets=3)
    items = [(1, 0, "one"), (2, 0, "two"), (3, 0, "three")]
    assert sync(store, spark, items, [(1, 0, "a", "s1"), (1, 1, "b", "s1"), (2, 0, "c", "s2"), (3, 0, "  ", "s3")]) == {"total": 3, "embedded": 3, "replace": 2, "remove": 0, "keep": 0}
    again = sync(store, spark, items, [(1, 0, "a", "s1"), (1, 1, "b", "s1"), (2, 0, "c", "s2")])
    assert again == {"total": 3, "embedded": 0, "replace": 0, "remove": 0, "keep": 2} and store.version() == 1
    # a chunk less is another identity; a text that is gone takes its chunks along; an item that is gone stays; a new date is a new row
    assert sync(store, spark, [(1, 1, "one"), (2, 0, "two")], [(1, 0, "a", "s1")]) == {"total": 2, "embedded": 1, "replace": 1, "remove": 1, "keep": 0}
    assert chunks_of(store, 1) == [(0, "a", "sync", 2)] and chunks_of(store, 2) == [] and store.read().where("parent = 3").count() == 1
    assert store.read().where("chunk_idx IS NULL").orderBy("parent").select("written").collect() == [(2,), (1,), (1,)]
    # another contract makes chunks anew although the text is the same
    assert sync(store, spark, [(1, 1, "one")], [(1, 0, "a", "s1")], contract="c2")["replace"] == 1


def test_full_sync_keeps_item_scoped_chunks(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/i", "parent", INDEX, buckets=3)
    sync(store, spark, [(1, 0, "one"), (2, 0, "two"), (3, 0, "gone")], [(1, 0, "a", "s"), (2, 0, "b", "s"), (3, 0, "c", "s")])
    own = store.read().where("parent = 1").withColumn("source", F.when(F.col("chunk_idx").isNotNull(), "item_scoped"))
    store.replace(own.select("parent"), own)
    sync(store, spark, [(1, 0, "one"), (2, 0, "two")], [(1, 0, "new", "s"), (2, 0, "b", "s")], full=True)
    assert chunks_of(store, 1) == [(0, "a", "item_scoped", 1)] and chunks_of(store, 2) == [(0, "b", "sync", 3)] and chunks_of(store, 3) == []
    # item-scoped chunks are replaced by a plain sync once their text has changed
    sync(store, spark, [(1, 0, "one")], [(1, 0, "new", "s")])
    assert chunks_of(store, 1) == [(0, "new", "sync", 4)]
