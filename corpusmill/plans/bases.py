"""Retrieval from knowledge bases that were embedded with different models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import connectors, fusion, keyword_index, search
from corpusmill.plans.answer import Embedder, Policy, passages
from corpusmill.sources import tables

# fixed values: why a question is not searched
NOT_FOUND, CONFLICT = "knowledge_base", "knowledge_base_needs_reembedding"


def routes(questions: DataFrame, bases: DataFrame, models: list[str]) -> DataFrame:
    """query_id, refused, models, embedding_tokens, base_ids: where each question (query_id, text, base_ids) is searched.

    ``bases`` has base_id, model and deleted_at.  A question is refused as a whole: as
    not found if any of its bases is absent or deleted (a base named twice, or null,
    counts as absent), as a conflict if any has a model outside ``models``, for an
    answer from half of the knowledge would look whole.  ``models`` are those it is
    embedded with, once each, in order; their tokens are estimated.  A blank or null
    text, or no bases, is neither refused nor searched.  A base_id that ``bases`` has
    twice counts once, with its smaller model.
    """
    live = bases.where("deleted_at IS NULL").groupBy("base_id").agg(F.min("model").alias("model"))
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.lit(" ")) == ""
    asked = questions.select("query_id", "text", F.when(blank | F.col("base_ids").isNull(), F.array().cast(questions.schema["base_ids"].dataType)).otherwise(F.col("base_ids")).alias("base_ids"))
    each = asked.select("query_id", F.explode("base_ids").alias("base_id")).join(live, "base_id", "left")
    known = F.col("model").isNotNull()
    per = each.groupBy("query_id").agg(
        F.count_if(~known).alias("lost"), F.count("*").alias("n"), F.count_distinct("base_id").alias("distinct"),
        F.count_if(known & ~F.col("model").isin(models)).alias("unread"), F.array_sort(F.collect_set("model")).alias("models"),
    )
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    tokens = F.greatest(words, F.floor(F.char_length("text") / 4), F.lit(1)).cast("long")
    refused = F.when((F.col("lost") > 0) | (F.col("distinct") < F.col("n")), NOT_FOUND).when(F.col("unread") > 0, CONFLICT)
    told = asked.join(per, "query_id", "left").withColumn("refused", refused)
    searched = F.col("refused").isNull() & F.col("n").isNotNull()
    none = F.array().cast("array<string>")
    return told.select(
        "query_id", "text", "refused", F.when(searched, F.col("models")).otherwise(none).alias("models"),
        F.when(searched, F.size("models") * tokens).otherwise(0).cast("long").alias("embedding_tokens"),
        F.when(searched, F.col("base_ids")).otherwise(F.slice("base_ids", 1, 0)).alias("base_ids"),
    )


def candidates(routed: DataFrame, chunks: DataFrame, bases: DataFrame, embedders: dict[str, Embedder], widths: dict[str, int], policy: Policy = Policy()) -> DataFrame:
    """query_id, chunk_id, score: hits within each question's bases, fused by reciprocal rank.

    Vectors and words are searched model by model; each model gives its best
    ``per_list``, and the lists of a question's models follow one another in the order
    of their names.
    """
    live = bases.where("deleted_at IS NULL").groupBy("base_id").agg(F.min("model").alias("model"))
    asked = tables.written(routed.select("query_id", "text", F.explode("base_ids").alias("base_id")).join(live, "base_id"))
    once = asked.select("query_id", "text", "model").distinct()
    vectors = None
    for model in sorted(embedders):  # a few, each with its own client
        some = connectors.embed(once.where(F.col("model") == model), "query_id", "text", embedders[model], widths[model]).withColumn("model", F.lit(model))
        vectors = some if vectors is None else vectors.unionByName(some)
    if vectors is None:
        return asked.select("query_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    wanted = asked.select("query_id", "base_id", "model").join(tables.written(vectors), ["query_id", "model"])
    of_base = chunks.select("chunk_id", "base_id").join(live, "base_id")

    def first(hits: DataFrame) -> DataFrame:
        """The best of each model, one model's after another's."""
        best = hits.withColumn("_in", F.row_number().over(Window.partitionBy("query_id", "model").orderBy(F.desc("score"), "chunk_id"))).where(F.col("_in") <= policy.per_list)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("model", "_in")))

    # a question's bases of one model are searched one by one; the best of all are among each one's best
    near = search.within_topk(wanted.withColumn("query_id", F.struct("query_id", "model")), chunks.select("chunk_id", "base_id", "embedding"), "base_id", policy.per_list, digits=9)
    near = first(near.select("query_id.*", "chunk_id", "score")).where(F.col("score") >= policy.least_relevance)
    lists = [near.select("query_id", "chunk_id", "rank")]
    if policy.hybrid:
        # the cut comes after the bases are known, so every match is scored
        texts = asked.select("query_id", "text").distinct()
        every = keyword_index.search_words(texts, keyword_index.index_words(chunks.select("chunk_id", F.col("content").alias("text")), only=keyword_index.words_of(texts)), 2**31 - 1)
        told = every.select("query_id", "chunk_id", "score").join(of_base, "chunk_id").join(asked.select("query_id", "base_id"), ["query_id", "base_id"])
        lists.append(first(told).select("query_id", "chunk_id", "rank"))
    return fusion.reciprocal_rank(lists)


def retrieve(questions: DataFrame, chunks: DataFrame, bases: DataFrame, embedders: dict[str, Embedder], widths: dict[str, int], policy: Policy = Policy(), where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Each question's passages as ``answer.retrieve`` returns them, and ``routes`` with what was refused.

    ``chunks`` are those of ``answer.ingest`` with their base_id, embedded by their
    base's model; chunk_id is unique over all bases.  ``where`` is a condition on the
    chunks' columns, such as their documents, and is applied under both searches.
    """
    routed = tables.written(routes(questions, bases, list(embedders)))
    searched = chunks if where is None else chunks.where(where)
    found = candidates(routed, searched, bases, embedders, widths, policy)
    return passages(found, searched, policy), routed
