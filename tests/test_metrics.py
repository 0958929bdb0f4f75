"""Metrics taken while plans and streams run equal counts taken after."""

from __future__ import annotations

import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusmill.operators import metrics
from corpusmill.plans import answer
from corpusmill.queries import Tables
from corpusmill.streaming import run

SF = "/root/testdata/sf0.001"


def test_ingestion_tells_what_it_wrote(spark):
    seen = Observation()
    chunks = answer.ingest(Tables(spark, SF).documents.select("doc_id", "text"), seen=seen)
    after = chunks.agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest")).first()
    assert seen.get == after.asDict() and after.chunks > 0


def test_a_stream_is_measured_batch_by_batch(spark, tmp_path):
    for k in range(3):
        spark.range(100 * k, 100 * k + 100).select((F.col("id") / 10).alias("seconds")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    heard = metrics.StreamMetrics()
    spark.streams.addListener(heard)
    try:
        rows = spark.readStream.schema("seconds double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert run.drain(rows.observe("waits", *metrics.histogram("seconds", [1.0, 20.0]))).count() == 300
        for _ in range(100):  # progress is told from another thread
            if heard.total("waits").get("n") == 300:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert {k: round(v, 6) for k, v in heard.total("waits").items()} == {"n": 300, "total": 4485.0, "le_0": 11, "le_1": 201} and heard.total("none") == {}


def test_an_exposition_is_cumulative_and_nulls_do_not_count(spark):
    rows, seen = metrics.measured(spark.createDataFrame([(0.1,), (2.0,), (None,)], "s double"), "s", bounds=[0.5, 1.0])
    assert rows.count() == 3
    assert metrics.exposition("wait_seconds", seen.get, [0.5, 1.0]) == '# TYPE wait_seconds histogram\nwait_seconds_bucket{le="0.5"} 1\nwait_seconds_bucket{le="1"} 1\nwait_seconds_bucket{le="+Inf"} 2\nwait_seconds_sum 2.1\nwait_seconds_count 2\n'
    empty, none = metrics.measured(rows.limit(0), "s")
    empty.collect()
    assert none.get["n"] == 0
