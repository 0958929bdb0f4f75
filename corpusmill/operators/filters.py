"""Filters that reach the scan: tenant scope, optional and time predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TenantScope:
    """The way to a tenant's rows: every table it hands out is filtered by its key.

    Tables laid out by the key make this partition pruning.
    """

    def __init__(self, tenant: object, column: str = "tenant_id"):
        self.tenant, self.column = tenant, column

    def of(self, table: DataFrame) -> DataFrame:
        return table.where(F.col(self.column) == self.tenant)


def any_of(df: DataFrame, column: str, values: list, most: int = 1000) -> DataFrame:
    """Rows whose column is one of the values: pushed to the scan if few, a semi join if many."""
    if len(values) <= most:
        return df.where(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(wanted, column, "left_semi")


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """Filter by the columns whose value is given; lists mean any of them."""
    for column, value in wanted.items():
        if isinstance(value, list | tuple | set):
            df = any_of(df, column, list(value))
        elif value is not None:
            df = df.where(F.col(column) == value)
    return df


def unless(df: DataFrame, switch: bool, condition: Column) -> DataFrame:
    return df if switch else df.where(condition)


def between(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(end).cast(kind)))


def older_than(df: DataFrame, column: str, now: Column, hours: int) -> DataFrame:
    return df.where(F.col(column) < now - F.expr(f"INTERVAL '{int(hours)}' HOUR"))


def relevant(df: DataFrame, score: str, least: float) -> DataFrame:
    """Rows that score enough; rows without a score pass."""
    return df.where(F.col(score).isNull() | (F.col(score) >= least))
