"""Chunk tables and objects: what is committed is there, what is not is not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.chunk_table import ChunkTable
from corpusmill.sources.commits import Commit, Commits
from corpusmill.sources.objects import ObjectStore, object_key

def _at(hours=0):
    return F.lit("2026-03-05 12:00:00").cast("timestamp") + F.make_interval(hours=F.lit(hours))


def _chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id long, version int, chunk_index int, content string")


def _seen(frame):
    return sorted((r["document_id"], r["version"], r["content"]) for r in frame.collect())


@pytest.fixture
def table(spark, tmp_path):
    return ChunkTable(spark, f"file://{tmp_path}/chunks")


def test_versions_of_one_number_keep_each_others_documents(spark, table):
    assert table.live() is None and table.served() is None and table.live_counts() is None
    table.append(_chunks(spark, (1, 1, 0, "a"), (2, 1, 0, "b")))
    table.append(_chunks(spark, (3, 1, 0, "c")))
    assert _seen(table.live()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]
    table.append(_chunks(spark, (2, 1, 0, "B"), (2, 1, 1, "B2")))  # written again: replaces its own rows alone
    assert _seen(table.live()) == [(1, 1, "a"), (2, 1, "B"), (2, 1, "B2"), (3, 1, "c")]
    assert sorted(map(tuple, table.live_counts().collect())) == [(1, 1), (2, 2), (3, 1)]


def test_newest_version_is_served_while_older_ones_are_retired_and_purged(spark, table):
    table.append(_chunks(spark, (1, 1, 0, "old"), (2, 1, 0, "two")))
    table.append(_chunks(spark, (1, 2, 0, "new")))
    assert _seen(table.served()) == [(1, 2, "new"), (2, 1, "two")]
    table.retire_others(spark.createDataFrame([(1, 2)], "document_id long, version int"), _at())
    assert _seen(table.live()) == [(1, 2, "new"), (2, 1, "two")]
    assert table.states().count() == 3
    table.purge(_at(23), 24)
    assert table.states().count() == 3  # retired less than a day ago
    table.purge(_at(25), 24)
    assert table.states().count() == 2 and _seen(table.live()) == [(1, 2, "new"), (2, 1, "two")]
    assert table.commits.vacuum() > 0 and _seen(table.live()) == [(1, 2, "new"), (2, 1, "two")]
    table.append(_chunks(spark, (1, 1, 0, "back")))  # retired once, written anew: live again
    assert _seen(table.live()) == [(1, 1, "back"), (1, 2, "new"), (2, 1, "two")]
    table.retire_documents(spark.createDataFrame([(1,), (1,), (9,)], "document_id long"), _at())
    assert _seen(table.live()) == [(2, 1, "two")]


def test_discarded_versions_and_broken_writes_are_invisible(spark, table):
    table.append(_chunks(spark, (1, 1, 0, "good")))
    table.append(_chunks(spark, (1, 2, 0, "half")))
    table.discard(spark.createDataFrame([(1, 2)], "document_id long, version int"))
    assert _seen(table.served()) == [(1, 1, "good")]
    broken = _chunks(spark, (5, 1, 0, "x")).withColumn("content", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of it
        table.append(broken)
    assert _seen(table.live()) == [(1, 1, "good")] and len(table.commits.entries()) == 3
    # rows written, their commit not
    _chunks(spark, (6, 1, 0, "y")).write.parquet(f"{table.commits.path}/chunks/commit=unfinished")
    assert _seen(table.live()) == [(1, 1, "good")]


def test_a_transaction_counts_once(spark, table):
    assert table.append(_chunks(spark, (1, 1, 0, "a")), transaction="stream-7") == 1
    assert table.append(_chunks(spark, (1, 1, 0, "a")), transaction="stream-7") is None
    assert _seen(table.live()) == [(1, 1, "a")]


def test_two_writers_never_share_a_number(spark, tmp_path):
    a, b = (Commits(spark, f"file://{tmp_path}/log") for _ in range(2))
    assert a._enter(Commit(0, "first", "put", ())) == 1
    known, stale = b.history, [[]]
    b.history = lambda: stale.pop() if stale else known()  # b had listed the log before a's commit
    assert b._enter(Commit(0, "second", "put", ())) == 2
    assert [(c.number, c.name) for c in a.entries()] == [(1, "first"), (2, "second")]


def test_a_purge_gives_way_to_a_writer(spark, table):
    table.append(_chunks(spark, (1, 1, 0, "a")))
    rows = table._rows

    def meanwhile(states):
        ChunkTable(spark, table.commits.path).append(_chunks(spark, (2, 1, 0, "b")))
        return rows(states)

    table._rows = meanwhile
    assert table.purge(_at(), 24) is None
    assert _seen(rows(table.states())) == [(1, 1, "a"), (2, 1, "b")]


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/objects")
    keys = spark.createDataFrame([("tenant/a/kb/1/v1/original",), ("tenant/b/kb/1/v1/original",), ("nowhere",)], "key string")
    assert store.listed() is None and store.get(keys) is None and not any(r["exists"] for r in store.exists(keys).collect())
    made = spark.createDataFrame([("a", "1", "x"), ("a", "2", "yy"), ("b", "1", "zzz")], "org string, doc string, text string")
    objects = made.select(object_key(F.col("org"), F.lit("kb"), F.col("doc"), F.lit(1)).alias("key"), F.col("text").alias("content"), F.lit("text/plain").alias("content_type"))
    store.put(objects)
    store.put(objects.where("content = 'x'").withColumn("content", F.lit("newer")))
    assert {r["key"]: bytes(r["content"]) for r in store.get(keys).collect()} == {"tenant/a/kb/1/v1/original": b"newer", "tenant/b/kb/1/v1/original": b"zzz"}
    store.delete(keys.where("key LIKE 'tenant/b%'"))
    assert {r["key"]: r["size"] for r in store.listed().collect()} == {"tenant/a/kb/1/v1/original": 5, "tenant/a/kb/2/v1/original": 2}
    store.delete_prefix("tenant/a/")
    assert store.listed().count() == 0
    store.put(objects)
    assert store.listed().count() == 3  # put after the deletions
    assert {r["key"]: r["exists"] for r in store.exists(keys).collect()} == {"tenant/a/kb/1/v1/original": True, "tenant/b/kb/1/v1/original": True, "nowhere": False}
    with pytest.raises(ValueError):
        store.delete_prefix("")
    with pytest.raises(Exception):  # noqa: B017
        store.put(objects.withColumn("key", F.lit(None).cast("string")))
