"""Metering: daily and monthly usage, quotas, percentiles and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources import tables


def _sums() -> list[Column]:
    return [F.count_if(F.col("kind") == "chat").alias("messages"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("cost_micro")]


def daily(facts: DataFrame) -> DataFrame:
    """tenant, day, messages (chat only), tokens, cost_micro of facts (tenant, ts, kind, tokens, cost_micro)."""
    return facts.groupBy("tenant", F.to_date("ts").alias("day")).agg(*_sums())


def monthly(facts: DataFrame) -> DataFrame:
    return facts.groupBy("tenant", F.trunc("ts", "month").alias("period")).agg(*_sums())


def depth(df: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    """Counts of each status in one pass."""
    return df.agg(*[F.count_if(F.col(status) == value).alias(name) for name, value in names.items()])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """keys and p50, p95, p99: nearest-rank percentiles, each a value of its group.

    Exact without holding a group's values anywhere: equal values are counted before the
    shuffle, the counts are dealt by ranges of (keys, value), the ranges' sums say in
    which of them a rank lies, and only those ranges are read again and added up.  A
    group of all rows is spread over all ranges, a frequent value is one row.  Null
    values do not count; a group of nulls only has null percentiles; NaN is the largest
    value; null keys are a group.  An empty table gives an empty one.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    plain = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("_v"))
    counts = plain.groupBy(*names, "_v").agg(F.count("*").alias("_n"))
    dealt = tables.written(counts.repartitionByRange(*names, "_v").withColumn("_range", F.spark_partition_id()))
    kinds = dealt.select(F.struct(*names).alias("_key"), "_v", "_n", "_range")
    ranges = kinds.groupBy("_key", "_range").agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_n"))  # at most groups + ranges rows
    upto = Window.partitionBy("_key").orderBy("_range")
    sums = ranges.withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy("_key")))
    ranks = F.array(*[F.struct(F.lit(p).alias("share"), F.expr(f"greatest(1, (_all * {p} + 99) div 100)").alias("rank")) for p in shares])
    asked = sums.withColumn("_r", F.explode(ranks)).where("_r.rank > _before AND _r.rank <= _before + _n").groupBy("_key", "_range", "_before").agg(F.collect_list("_r").alias("_ranks"))
    running = F.sum("_n").over(Window.partitionBy("_key", "_range").orderBy("_v"))
    asked = asked.withColumnsRenamed({"_key": "_asked", "_range": "_where"})
    hit = kinds.where("_v IS NOT NULL").join(asked, F.col("_key").eqNullSafe(F.col("_asked")) & (F.col("_range") == F.col("_where"))).drop("_asked", "_where")
    hit = hit.withColumn("_to", F.col("_before") + running).withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r["rank"] <= F.col("_to")) & (r["rank"] > F.col("_to") - F.col("_n")))))
    found = sums.select("_key", F.lit(None).cast("int").alias("_share"), F.lit(None).cast(df.schema[value].dataType).alias("_v")).unionByName(hit.select("_key", F.col("_r.share").alias("_share"), "_v"))
    each = [F.max(F.when(F.col("_share") == p, F.col("_v"))).alias(f"p{p}") for p in shares]
    return found.groupBy("_key").agg(*each).select(*[F.col(f"_key.{n}").alias(k) for n, k in zip(names, keys, strict=True)], *[f"p{p}" for p in shares])


# fixed values: upper bounds of the latency histogram, in seconds
LATENCY = [0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.4, 0.8, 1.5, 3.0, 6.0, 15.0, 30.0, 60.0]


def buckets(df: DataFrame, value: str, bounds: list[float], rest: float | None = None) -> DataFrame:
    """le, n: how many values fall in each bucket; those beyond the last bound are under ``rest``."""
    ladder = F.when(F.col(value) <= bounds[0], bounds[0])
    for b in bounds[1:]:
        ladder = ladder.when(F.col(value) <= b, b)
    return df.groupBy(ladder.otherwise(rest).alias("le")).agg(F.count("*").alias("n"))


def fraction(used: Column, limit: Column) -> Column:
    """Share of a limit that is used; 0 without a limit."""
    return F.when(limit.isNull() | (limit <= 0), 0.0).otherwise(used / limit)


def over(used: Column, limit: Column) -> Column:
    return F.coalesce(used >= limit, F.lit(False))


def billable(texts: DataFrame, batch: str, digest: str, order: str, tokens: str) -> DataFrame:
    """Per batch: texts, embedded (each content once) and the tokens of those, first occurrence counting."""
    once = texts.groupBy(batch, digest).agg(F.min_by(tokens, order).alias("n"), F.count("*").alias("k"))
    return once.groupBy(batch).agg(F.sum("k").alias("texts"), F.count("*").alias("embedded"), F.sum(F.col("n").cast("long")).alias("billable"))


def readiness(usable: Column, enabled: Column, dead: Column) -> tuple[Column, Column, Column]:
    """Health of the models, of the queue, and of the whole: a queue with dead jobs is degraded, but only the lack of any usable model takes the whole down."""
    models = F.when(usable == 0, "failing").when(usable < enabled, "degraded").otherwise("ok")
    return models, F.when(dead > 0, "degraded").otherwise("ok"), F.when(models == "failing", "failing").otherwise("ok")


def health(df: DataFrame, key: str, failed: Column) -> DataFrame:
    """ok without failures, failing if more than half failed, degraded between."""
    counts = df.groupBy(key).agg(F.count_if(failed).alias("bad"), F.count("*").alias("n"))
    return counts.select(key, F.when(F.col("bad") * 2 > F.col("n"), "failing").when(F.col("bad") > 0, "degraded").otherwise("ok").alias("health"))
