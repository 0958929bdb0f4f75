"""The graph index of vectors and the positional index of words against plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import keyword_index, search, vector_index

SF = "/root/testdata/sf0.1"


def _questions(spark):
    held = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return held.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), held


@pytest.mark.parametrize("shard", [256, 16_384])
def test_recall_at_30(spark, shard):
    asked, held = _questions(spark)
    index = vector_index.index_vectors(held, shard)
    assert index.selectExpr("sum(size(ids))").first()[0] == held.count()  # every row is indexed
    found = vector_index.search_index(asked, index, 30)
    total = vector_index.recall(found, search.vector_topk(asked, held, 30)).agg(F.sum("wanted"), F.sum("found")).first()
    assert total[1] >= 0.95 * total[0], total
    # what is found has its exact score
    exact = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.vector_topk(asked, held, 2000).collect()}
    assert all(r["score"] == pytest.approx(exact[r["query_id"], r["chunk_id"]], abs=1e-9) for r in found.collect())


def test_walks_visit_few_vectors_of_a_large_shard():
    chance = np.random.RandomState(0)
    middles = chance.normal(size=(40, 24))
    vectors = vector_index._unit((middles[chance.randint(0, 40, 6000)] + 0.4 * chance.normal(size=(6000, 24))).astype("f4"))
    links = vector_index.links_of(vectors)
    asked = vector_index._unit((middles[chance.randint(0, 40, 50)] + 0.4 * chance.normal(size=(50, 24))).astype("f4"))
    found = vector_index.walk(asked, vectors, links, vector_index.entries_of(vectors))[:, :30]
    wanted = np.argsort(-(asked @ vectors.T), axis=1)[:, :30]
    hits = np.mean([len(set(a) & set(b)) / 30 for a, b in zip(found.tolist(), wanted.tolist(), strict=True)])
    assert hits >= 0.95
    assert ((links >= -1) & (links < 6000)).all() and (links != np.arange(6000)[:, None]).all()


def test_vectors_of_several_widths_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, 0.1]), (8, [1.0, 0.0])]
    held = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0] * 9)], "query_id string, embedding array<float>")
    found = {}
    for r in sorted(search.vector_topk(asked, held, 3, ann=True).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert found == {"a": [1, 8, 7], "b": [3]}
    assert search.vector_topk(asked, held.where("false"), 3, ann=True).count() == 0


def _plain_search(questions, corpus, most):
    """Words by definition, positions one by one."""
    words = lambda text: [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    out = set()
    for q, text in questions:
        wanted = sorted(set(words(text)))
        scored = []
        for doc, body in corpus:
            own = words(body)
            if not wanted or not set(wanted) <= set(own):
                continue
            last, low, score = {}, -1, 0.0
            for at, w in enumerate(own):
                if w in wanted:
                    last[w] = at
                    if len(last) == len(wanted) and min(last.values()) > low:
                        low = min(last.values())
                        score += 0.1 / (1.0 + (at - low + 1 - len(wanted)))
            scored.append((-round(score, 9), doc))
        out |= {(q, doc, score, rank) for rank, (score, doc) in enumerate(sorted(scored)[:most], 1)}
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_words_are_found_like_a_plain_search_finds_them(spark, block):
    chance = random.Random(block)
    corpus = [(i, " ".join(chance.choice(["the", "of", "cat", "Dog", "sun", "ünder", "x1", "a-b"]) for _ in range(chance.randint(0, 25)))) for i in range(120)]
    corpus += [(500, None), (501, ""), (502, "!!! --- ..."), (503, "the " * 2000 + "end")]
    questions = [(1, "the cat"), (2, "DOG, dog & sun"), (3, ""), (4, None), (5, "nowhere cat"), (6, "the"), (7, "the"), (8, "end the"), (9, "ünder x1 a b of"), (None, "sun")]
    asked = spark.createDataFrame(questions, "query_id long, text string")
    index = keyword_index.index_words(spark.createDataFrame(corpus, "chunk_id long, text string").repartition(3), block)
    found = {(r["query_id"], r["chunk_id"], -r["score"], r["rank"]) for r in keyword_index.search_words(asked, index, 10).collect()}
    assert found == _plain_search(questions, corpus, 10)
    assert keyword_index.search_words(asked.where("false"), index, 10).count() == 0


def test_no_text_is_read_by_a_search(spark):
    corpus = spark.createDataFrame([(1, "one two three")], "chunk_id long, text string")
    index = keyword_index.index_words(corpus)
    assert set(index.postings.columns) == {"word", "block", "chunks", "counts", "deltas"} and set(index.blocks.columns) == {"block", "ids"}
    assert {r["word"]: (r["chunks"], r["counts"], r["deltas"]) for r in index.postings.collect()} == {"one": ([0], [1], [0]), "two": ([0], [1], [1]), "three": ([0], [1], [2])}
    empty = keyword_index.index_words(corpus.where("false"))
    assert keyword_index.search_words(spark.createDataFrame([(1, "one")], "query_id long, text string"), empty, 5).count() == 0
