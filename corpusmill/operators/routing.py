"""Plans, permissions and model routing as small dimensions joined to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MB, GB, UNLIMITED = 1 << 20, 1 << 30, (1 << 63) - 1
# Limits of the plans.
PLANS = [
    ("free", 0, 100 * MB, 50, 10 * MB, 1, 1_000, 20),
    ("starter", 1, GB, 500, 25 * MB, 3, 10_000, 60),
    ("business", 2, 10 * GB, 5_000, 50 * MB, 10, 100_000, 300),
    ("enterprise", 3, UNLIMITED, UNLIMITED, 200 * MB, UNLIMITED, UNLIMITED, 3_000),
]
# Least level of a feature; enterprise is the only one with its own chains of models.
FEATURES = [("provider_choice", 2), ("custom_model_policy", 3), ("reveal_provider", 2), ("webhooks", 1)]
# What each role may do.
ROLES = {
    "owner": ("read", "chat", "write", "publish", "members", "billing"),
    "admin": ("read", "chat", "write", "publish", "members"),
    "editor": ("read", "chat", "write", "publish"),
    "viewer": ("read", "chat"),
}
TIERS = ("small", "medium", "large")
TIER_OF = {"fast": 0, "balanced": 1, "deep": 2}


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, level int, storage_bytes long, documents_per_base long, file_bytes long, agents long, messages_per_month long, requests_per_minute int")


def features(spark: SparkSession) -> DataFrame:
    """plan, feature, allowed for every pair."""
    known = spark.createDataFrame(FEATURES, "feature string, least int")
    return plans(spark).select("plan", "level", F.explode(F.lit([f for f, _ in FEATURES])).alias("feature")).join(F.broadcast(known), "feature").select("plan", "feature", (F.col("level") >= F.col("least")).alias("allowed"))


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string")


def may(requests: DataFrame, spark: SparkSession) -> DataFrame:
    """``requests`` (role, permission) with ``allowed``."""
    known = permissions(spark).withColumn("allowed", F.lit(True))
    return requests.join(F.broadcast(known), ["role", "permission"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def plan_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """request_id, model, place: the models to try for each request, in order.

    ``requests``: request_id, policy (auto, provider or custom), reasoning, provider,
    chain (array), context_tokens, streaming.  ``models``: model, provider, tier,
    priority, max_context, enabled, streams, open (circuit).  auto climbs from the
    tier of the reasoning level; provider does so within one; custom follows its
    chain, where a switched-off model has no place.
    """
    tier = F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)])
    start = F.create_map(*[F.lit(x) for kv in TIER_OF.items() for x in kv])
    usable = models.where("enabled and not open").select("model", F.col("provider").alias("m_provider"), tier[F.col("tier")].alias("step"), "priority", "max_context", "streams")
    fits = (F.col("max_context") >= F.col("context_tokens")) & (~F.col("streaming") | F.col("streams"))
    # equi joins: a request meets the models of its tiers, or those of its chain; Spark broadcasts models if they are small
    climbing = requests.where("policy <> 'custom'").withColumn("step", F.explode(F.sequence(start[F.col("reasoning")], F.lit(len(TIERS) - 1))))
    climbed = climbing.join(usable, "step").where(fits & ((F.col("policy") == "auto") | (F.col("m_provider") == F.col("provider"))))
    named = requests.where("policy = 'custom'").select("request_id", "context_tokens", "streaming", F.posexplode(F.array_distinct("chain")).alias("step", "model"))
    chained = named.join(usable.drop("step"), "model").where(fits).withColumn("priority", F.lit(0))
    pairs = climbed.select("request_id", "model", "step", "priority").unionByName(chained.select("request_id", "model", "step", "priority"))
    order = Window.partitionBy("request_id").orderBy("step", "priority", "model")
    return pairs.select("request_id", "model", F.row_number().over(order).alias("place"))


def error_class(kind: Column, status: Column) -> tuple[Column, Column]:
    """Whether an error is worth another try, and whether it speaks against the provider."""
    retryable = F.when(kind.isin("rate_limited", "timeout", "transport"), True).when(kind == "upstream", status >= 500).otherwise(False)
    return retryable, ~kind.isin("bad_request", "auth")


def ocr_error(status: Column) -> tuple[Column, Column]:
    """What an answer of the text recognition service means, and whether it is worth another try; no answer counts as unreachable."""
    error = F.when(status.isNull() | (status >= 500), "unreachable").when(status >= 400, "rejected")
    return error, F.coalesce(error == "unreachable", F.lit(False))


def upload_refusal(size: Column, source_type: Column, documents: Column, stored: Column, plan: dict[str, Column], can_ocr: bool = False) -> Column:
    """Why an upload is refused before a byte is read; null if it is not."""
    return (
        F.when(source_type.isNull(), "unsupported_type")
        .when((source_type == "image") & F.lit(not can_ocr), "needs_ocr")
        .when(size > plan["file_bytes"], "too_large")
        .when(documents >= plan["documents_per_base"], "too_many_documents")
        .when(stored + size > plan["storage_bytes"], "storage_full")
    )


# Kinds of jobs and their priorities, stages of a document and their progress.
JOB_PRIORITY = {"chat": 1, "ingest_document": 5, "delete_document": 7, "reembed": 9}
PROGRESS = {"uploading": 5, "queued": 10, "processing": 30, "chunking": 50, "embedding": 70, "indexing": 90, "ready": 100, "failed": 0, "deleted": 0}


def lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
