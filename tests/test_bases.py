"""Retrieval from bases of several models: refusals, and hits as a plain search finds them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import connectors, search
from corpusmill.plans import answer, bases

EMBEDDERS, WIDTHS = {"wide": connectors.hashing_client, "narrow": connectors.narrow_client}, {"wide": 64, "narrow": 32}
BASES = [("a", "wide", None), ("b", "narrow", None), ("c", "wide", None), ("d", "lost", None), ("e", "wide", "2024-01-01")]


def _bases(spark):
    return spark.createDataFrame(BASES, "base_id string, model string, deleted_at string")


def test_a_question_is_refused_as_a_whole(spark):
    asked = [(1, "one two", ["a"]), (2, "one two", ["a", "b", "c"]), (3, "x", ["a", "e"]), (4, "x", ["a", "zz"]), (5, "x", ["a", "d"]), (6, "x", ["d", "zz"]), (7, " \n", ["zz"]), (8, None, ["a"]), (9, "x", []), (10, "x", None), (11, "x", ["a", "a"]), (12, "x", ["a", None]), (13, "abcdefghijklmnop", ["b"])]
    questions = spark.createDataFrame(asked, "query_id long, text string, base_ids array<string>")
    told = {r.query_id: (r.refused, r.models, r.embedding_tokens) for r in bases.routes(questions, _bases(spark), list(EMBEDDERS)).collect()}
    nothing = (None, [], 0)
    lost, conflict = ("knowledge_base", [], 0), ("knowledge_base_needs_reembedding", [], 0)
    assert told == {1: (None, ["wide"], 2), 2: (None, ["narrow", "wide"], 4), 3: lost, 4: lost, 5: conflict, 6: lost, 7: nothing, 8: nothing, 9: nothing, 10: nothing, 11: lost, 12: lost, 13: (None, ["narrow"], 4)}
    assert bases.routes(questions.limit(0), _bases(spark), list(EMBEDDERS)).count() == 0


def test_hits_come_from_the_bases_asked(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARE", 16)  # several blocks a base
    words = "red green blue north south river stone field cloud music paper wheel".split()
    texts = [" ".join(words[(i * k + k * k) % 12] for k in range(1, 6)) for i in range(240)]
    chunks = []
    for i, text in enumerate(texts):
        base = "aaaabc"[i % 6]  # one base holds most
        model = dict((b, m) for b, m, _ in BASES)[base]
        vector = dict(EMBEDDERS[model]([text]))[0]
        chunks.append((f"c{i:03}", i, base, text, f"T{i}", 3, [float(x) for x in vector]))
    held = spark.createDataFrame(chunks, "chunk_id string, doc_id long, base_id string, content string, title string, token_count int, embedding array<float>")
    held = held.withColumn("page", F.lit(None).cast("int")).withColumn("heading_path", F.array().cast("array<string>"))
    asked = [(1, "red river stone", ["a"]), (2, "blue music", ["a", "b"]), (3, "north", ["c", "b"]), (4, "cloud wheel", ["b"]), (5, "paper", ["a", "c"]), (6, "paper", ["a", "d"])]
    questions = spark.createDataFrame(asked, "query_id long, text string, base_ids array<string>")
    policy = answer.Policy(per_list=12, least_relevance=0.2)
    routed = bases.routes(questions, _bases(spark), list(EMBEDDERS))
    found = {(r.query_id, r.chunk_id): round(r.score, 9) for r in bases.candidates(routed, held, _bases(spark), EMBEDDERS, WIDTHS, policy).collect()}

    wanted: dict = {}
    words_of = {(r.query_id, r.chunk_id): r.score for r in search.keyword_topk(questions, held.select("chunk_id", F.col("content").alias("text")), 2**31 - 1).collect()}
    for query, text, ids in asked[:5]:
        models = sorted({m for b, m, _ in BASES if b in ids})
        near, plain = [], []
        for model in models:
            mine = [c for c in chunks if c[2] in ids and dict((b, m) for b, m, _ in BASES)[c[2]] == model]
            q = np.array(dict(EMBEDDERS[model]([text]))[0])
            cosine = lambda v: float(q @ np.array(v) / (np.linalg.norm(q) * np.linalg.norm(v)))
            near += sorted(((-round(cosine(np.float32(c[6]).astype(float)), 9), c[0]) for c in mine))[:12]
            plain += sorted((-words_of[query, c[0]], c[0]) for c in mine if (query, c[0]) in words_of)[:12]
        for hits, keep in ((near, lambda s: s >= 0.2), (plain, lambda s: True)):
            for rank, (score, chunk) in enumerate(hits, 1):
                if keep(-score):
                    wanted[query, chunk] = wanted.get((query, chunk), 0.0) + 1 / (60 + rank)
    assert found == {k: round(v, 9) for k, v in wanted.items()} and {q for q, _ in found} == {1, 2, 3, 4, 5}

    passages, told = bases.retrieve(questions, held, _bases(spark), EMBEDDERS, WIDTHS, policy, where=F.col("doc_id") % 2 == 0)
    rows = passages.collect()
    assert rows and all(r.doc_id % 2 == 0 for r in rows) and {r.query_id for r in rows} <= {1, 2, 3, 4, 5}
    assert {r.query_id for r in rows} & {2, 3} and told.where("refused IS NOT NULL").count() == 1
