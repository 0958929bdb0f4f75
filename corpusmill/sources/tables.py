"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch on its way to a Python task.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python tasks in Arrow batches of at most ``BATCH_BYTES``, unless the session names another bound.

    Spark's own bound lets each Python worker hold several times 64 MB as soon as tables are large enough to fill it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def shared(spark: SparkSession, what: str = "table") -> str:
    """A new folder that driver and executors share.

    The cluster names where in spark.checkpoint.dir.  Unset, it is a temporary folder
    on one machine, as in tests; on a cluster a ValueError says what is missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="corpusmill-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, its lineage cut, safe from lost executors."""
    path = shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
