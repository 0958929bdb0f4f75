"""Plans are the ones wanted: filters reach the scan, few columns are read, few shuffles are made."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import connectors, filters, fusion, keyword_index, usage
from corpusmill.plans import answer
from corpusmill.queries import streams
from corpusmill.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = _plan(filters.optional(docs, lang="en", source=["src1", "src2"]).select("doc_id"))
    assert "EqualTo(lang,en)" in plan and "In(source, [src1,src2])" in plan
    assert "text:string" not in plan.split("ReadSchema")[1].split("\n")[0]
    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = _plan(filters.between(events, "ts", "2024-01-05", "2024-01-12").select("event_id"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_daily_usage_is_one_shuffle_with_partial_sums(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    facts = events.select(F.col("user_id").alias("tenant"), "ts", F.col("event_type").alias("kind"), F.lit(1).alias("tokens"), F.lit(1).alias("cost_micro"))
    plan = _plan(usage.daily(facts))
    assert plan.count("Exchange\n") + plan.count("Exchange (") >= 1 and "partial_sum" in plan and "Python" not in plan


def test_top_k_per_question_is_cut_before_the_shuffle(spark):
    hits = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.element_at("embedding", 1).alias("score"))
    assert "WindowGroupLimit" in _plan(fusion.ranked(hits, most=5))


def test_ingest_parses_and_chunks_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = _plan(answer.ingest(docs))
    assert "MapInArrow" not in plan and "documents.parquet" not in plan  # chunks are read back, not made again
    assert _plan(answer._dealt(docs)).count("RoundRobinPartitioning") == 1
    blocks = spark.createDataFrame([(1, [("paragraph", None, "a text", 3, "k")])], "doc_id long, blocks array<struct<kind:string,level:int,text:string,page:int,key:string>>")
    assert answer.ingest(blocks).select("page").first()[0] == 3


def test_second_ingestion_calls_no_client(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    calls = str(tmp_path)

    def client(texts):
        with tempfile.NamedTemporaryFile("w", dir=calls, delete=False) as note:
            note.write(str(len(texts)))
        return connectors.hashing_client(texts)

    first = tables.written(answer.ingest(docs, embedder=client))
    sizes = sorted(int(f.read_text()) for f in tmp_path.iterdir())
    distinct = first.select("content_hash").distinct().count()
    assert sum(sizes) == distinct and sizes.count(64) == distinct // 64 and len(sizes) == -(-distinct // 64)
    columns = ["chunk_id", "embedding"]
    cache = first.select("content_hash", "embedding")
    second = answer.ingest(docs, embedder=client, cache=cache)
    assert sorted(map(tuple, second.select(columns).collect())) == sorted(map(tuple, first.select(columns).collect()))
    assert len(list(tmp_path.iterdir())) == len(sizes)  # not once more
    broken = cache.withColumn("embedding", F.slice("embedding", 1, 9))  # of another width: absent
    assert answer.ingest(docs, embedder=client, cache=broken).count() == first.count()
    assert len(list(tmp_path.iterdir())) == 2 * len(sizes)


def test_embedding_refuses_an_answer_that_does_not_fit(spark):
    chunks = spark.createDataFrame([("h1", "a", 1), ("h2", "b", 1), ("h1", "a", 1)], "content_hash string, content string, token_count int")
    assert connectors.embed_new(chunks.where("false"), connectors.hashing_client, 64).count() == 0
    for bad in (lambda texts: [], lambda texts: [(i, [0.0]) for i in range(len(texts))]):
        with pytest.raises(Exception, match="does not fit"):
            connectors.embed_new(chunks, bad, 64).collect()


def test_versions_of_many_batches_keep_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = sorted(map(tuple, streams.st_version_swap(spark, SF).collect()))
    assert sorted(map(tuple, streams.st_version_swap(spark, str(tmp_path)).collect())) == wanted


def test_retrieval_with_an_index_kept_for_it(spark):
    chunks = tables.written(answer.ingest(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    words = keyword_index.index_words(chunks.select("chunk_id", F.col("content").alias("text")))
    plain, kept = (sorted(map(str, answer.retrieve(asked, chunks, words=w).collect())) for w in (None, words))
    assert plain == kept and plain
