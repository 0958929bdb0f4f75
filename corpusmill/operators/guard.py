"""Guards on messages and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as fn


def check_messages(df: DataFrame, text_col: str, most: int = fn.MAX_MESSAGE) -> DataFrame:
    """``df`` with ok, reason, suspected and pattern.

    Empty and overlong messages are refused; a suspicious phrase is reported only.
    """
    text = fn.strip(F.coalesce(F.col(text_col), F.lit("")))
    reason = F.when(text == "", "empty").when(F.char_length(text) > most, "too_long")
    pattern = F.when(reason.isNull(), fn.suspicious_phrase(text))
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).withColumn("pattern", pattern).withColumn("suspected", F.col("pattern").isNotNull())


def verbatim_runs(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str, run: int = fn.RUN) -> DataFrame:
    """text_id, passage_id, shared_runs: how many runs of words both have.

    Runs meet by their 128-bit digest in an equi join; a text has each run once already.
    """
    digests = lambda df, key: df.select(key, F.explode(fn.word_windows("text", run)).alias("r")).select(key, F.md5("r").alias("run"))
    return digests(texts, text_id).join(digests(passages, passage_id), "run").groupBy(text_id, passage_id).agg(F.count("*").alias("shared_runs"))


def replace_leaks(answers: DataFrame, instructions: DataFrame, key: str, fallback: str) -> DataFrame:
    """Answers that repeat a run of their instructions give way to the fallback message."""
    both = answers.join(instructions, key, "left")
    leaked = F.arrays_overlap(fn.word_windows("answer"), fn.word_windows(F.coalesce("instructions", F.lit(""))))
    return both.withColumn("leaked", F.coalesce(leaked, F.lit(False))).withColumn("answer", F.when(F.col("leaked"), F.lit(fallback)).otherwise(F.col("answer")))
