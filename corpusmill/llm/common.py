"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python task handles at once, whatever Spark hands over.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: A key with more than one of so many parts of all rows is dealt over several tasks.
HOT = 256
#: The words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def require(df: DataFrame, *names: str) -> None:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that neither rows nor (roughly) bytes exceed the bounds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.get_total_buffer_size()))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: What this Python worker keeps from task to task: one operator's table.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, remembered by this worker until another operator keeps something or asks for room."""
    if key not in _KEPT:
        make_room()
        _KEPT[key] = make()
    return _KEPT[key]


def make_room() -> None:
    """Forget what an earlier operator kept in this worker, and give unused Arrow memory back."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python tasks and back in Arrow batches of at most ``BATCH_BYTES``, unless the session names another bound.

    Spark's own bound of 64 MB is held once in the executor's JVM, rounded up to a power
    of two, and once in each Python worker; tasks here cut batches to ``BATCH_BYTES`` anyway.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset and all runs
    on one machine, as in tests, a temporary folder is made.  On a cluster without
    that setting a ValueError says so.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            found = found.get()
        elif context.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="corpusmill-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder and are read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(counts: DataFrame, key: str, rows: str = "rows", total: int | None = None) -> DataFrame:
    """key, shares: the keys that hold more than a ``HOT``-th of all rows; fewer than ``HOT`` of them.

    ``counts`` has one row a key.  A key's shares follow its part of the rows.
    """
    if total is None:
        total = counts.agg(F.sum(rows)).first()[0] or 0
    one = max(1, -(-total // HOT))
    return counts.where(F.col(rows) > one).select(key, F.ceil(F.col(rows) / F.lit(one)).cast("int").alias("shares"))


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key``, hot keys dealt over several tasks.

    The rows of a hot key go to one of its shares each, by a hash of the column
    ``by``; the table's row is copied to every share.  Only ``hot``, of fewer than
    ``HOT`` rows, is broadcast.
    """
    told = F.broadcast(hot.select(key, F.col("shares").alias("_shares")))
    dealt = rows.join(told, key, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(by), F.col("_shares")), F.lit(0))).drop("_shares")
    copied = table.join(told, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_shares", F.lit(1)).cast("long") - 1))).drop("_shares")
    return dealt.withColumn("_share", F.col("_share").cast("long")).join(copied, [key, "_share"], how).drop("_share")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
