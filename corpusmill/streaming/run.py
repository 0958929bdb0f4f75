"""Running a stream over files to its end and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.tables import shared, written


def read_table(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, at most ``files`` a batch if given; its schema comes from a batch read."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, processed by ``availableNow`` into Parquet, and read back."""
    spark = stream.sparkSession
    folder = shared(spark, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """For updating aggregates: the last row of every key that the stream emitted.

    Each micro-batch appends its updated rows under its number; a repeated batch
    overwrites itself, so a retry changes nothing.
    """
    spark = stream.sparkSession
    folder = shared(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out/batch=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("r")).select(*keys, "r.*")


#: State variables with timers are held in this store, which writes a batch's changes and not itself at every commit.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_PARTITIONS = "spark.sql.shuffle.partitions"

#: Rows of a stretch that a part of the state takes at most, unless the session allows fewer parts.
PART_ROWS = 250_000


def _state_parts(spark: SparkSession, rows: int) -> int:
    """Parts of the state for a stretch of ``rows``: two a core or as many as the rows need, no more than the session's.

    A stream's shuffles are not joined to larger ones as a batch's are, and every part
    costs a store, a commit and a call of Python a micro-batch, however few its rows.
    """
    return min(int(spark.conf.get(_PARTITIONS)), max(2 * spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def replay(rows: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], parts: int = 3) -> tuple[DataFrame, list[dict]]:
    """What the stream ``build`` makes of ``rows`` that arrive in ``parts`` stretches of ``time``, and the progress of each.

    Every stretch is written beside the earlier ones and the stream started again from
    its checkpoint, so its state outlives the query each time.  Rows without a time come first.
    """
    spark = rows.sparkSession
    folder = shared(spark, "replay")
    held = written(rows)
    cuts = sorted(set(held.approxQuantile(time, [k / parts for k in range(1, parts)], 0.01)))
    edges = [None, *cuts, None]
    settings = _STORE | {_PARTITIONS: str(_state_parts(spark, -(-held.count() // parts)))}
    before = {name: spark.conf.get(name, None) for name in settings}
    progress = []
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for low, high in zip(edges, edges[1:], strict=False):
            some = held if low is None else held.where(F.col(time) >= low)
            some = some if high is None else some.where((F.col(time) < high) | F.col(time).isNull() if low is None else F.col(time) < high)
            some.write.mode("append").parquet(f"{folder}/in")
            stream = build(spark.readStream.schema(held.schema).parquet(f"{folder}/in"))
            query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
            query.awaitTermination()
            progress += query.recentProgress
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), progress
