"""Stored tables: inserts, changes and deletes by key, each whole or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meritlake.operators import intake
from meritlake.session import work_folder
from meritlake.sources.keyed_store import KeyedStore

SCHEMA = "k string, n int, tags array<string>, day date"


@pytest.fixture
def store(spark):
    return KeyedStore(spark, work_folder(spark, "store"), "k", SCHEMA, buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(table):
    return sorted((r.k, r.n, r.tags, r.day) for r in table.collect())


DAY = dt.date(2024, 1, 1)


def test_nothing_stored(spark, store):
    assert store.read().collect() == [] and store.snapshots() == []
    assert store.matching(spark.createDataFrame([("a",)], "k string")).count() == 0
    assert store.delete(spark.createDataFrame([("a",)], "k string")) == 0
    assert store.insert_new(frame(spark, [])).count() == 0 and store.snapshots() == []
    assert store.upsert(frame(spark, [(None, 1, None, None)])).count() == 0 and store.snapshots() == []


def test_inserts_happen_once(spark, store):
    given = [("a", 1, ["x"], DAY), ("b", None, None, None), ("", 2, [], DAY), (None, 3, [], DAY)]
    assert store.insert_new(frame(spark, given)).count() == 3
    assert store.insert_new(frame(spark, given + [("a", 9, [], DAY)])).count() == 0
    assert store.insert_new(frame(spark, [("c", 1, ["y"], DAY)] * 3 + [("c", 2, ["y"], DAY)])).count() == 1
    assert len(store.snapshots()) == 2
    assert [r[:2] for r in rows(store.read())][:3] == [("", 2), ("a", 1), ("b", None)]
    assert store.read(snapshot=1).count() == 3 and store.read().count() == 4


def test_updates_write_their_buckets_only(spark, store):
    store.insert_new(frame(spark, [(f"key{i}", i, ["t"], DAY) for i in range(200)]))
    before = {(p.bucket, p.part) for p in store.parts()}
    assert store.upsert(frame(spark, [("key5", 5, ["t"], DAY), ("key6", 6, ["t"], DAY)])).count() == 0
    assert len(store.snapshots()) == 1
    changed = frame(spark, [("key5", None, ["u"], DAY), ("key6", 6, ["t"], DAY), ("key7", 7, ["t"], None)])
    assert rows(store.upsert(changed)) == [("key5", None, ["u"], DAY), ("key7", 7, ["t"], None)]
    touched = {r[0] for r in frame(spark, [("key5", 0, [], DAY), ("key7", 0, [], DAY)]).select(store.bucket_of(F.col("k"))).collect()}
    assert {p.bucket for p in store.parts() if (p.bucket, p.part) not in before} == touched
    assert store.upsert(changed).count() == 0 and store.read().count() == 200
    assert {r.k: r.n for r in store.read().collect()} == {f"key{i}": None if i == 5 else i for i in range(200)}


def test_deletes_write_their_buckets_only(spark, store):
    store.insert_new(frame(spark, [(f"key{i}", i, None, None) for i in range(200)]))
    before = {(p.bucket, p.part) for p in store.parts()}
    gone = spark.createDataFrame([("key5",), ("key5",), ("other",), (None,)], "k string")
    assert store.delete(gone) == 1 and store.delete(gone) == 0
    assert len({p.bucket for p in store.parts() if (p.bucket, p.part) not in before}) == 1
    assert store.read().count() == 199 and len(store.snapshots()) == 2
    assert store.delete(store.read()) == 199 and store.read().count() == 0
    assert store.insert_new(frame(spark, [("key5", 1, None, None)])).count() == 1 and store.read().count() == 1


def test_a_change_that_fails_half_way_shows_nothing(spark, store, monkeypatch):
    store.insert_new(frame(spark, [(f"key{i}", i, None, None) for i in range(20)]))
    monkeypatch.setattr(KeyedStore, "_commit", lambda self, parts: (_ for _ in ()).throw(RuntimeError("lost")))
    for change in (lambda: store.insert_new(frame(spark, [("new", 1, None, None)])), lambda: store.upsert(frame(spark, [("key1", 0, None, None)])),
                   lambda: store.delete(frame(spark, [("key1", 0, None, None)]))):
        with pytest.raises(RuntimeError, match="lost"):
            change()
        assert sorted(r.n for r in store.read().collect()) == list(range(20))
    monkeypatch.undo()
    assert store.insert_new(frame(spark, [("new", 1, None, None)])).count() == 1 and store.read().count() == 21


def test_content_ids_are_distinct(spark):
    table = spark.createDataFrame([(None, "v"), ("v", None), ("a|b", None), ("a", "b"), ("a", "b|"), ("a|", "b"), ("", None), (None, "")],
                                  "x string, y string")
    ids = [r.i for r in intake.with_content_id(table, "i", ["x", "y"]).collect()]
    assert len(set(ids)) == 8 and len(set(map(len, ids))) == 1
