"""Counters and histograms taken while a plan or a stream runs, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from corpusmill.operators.usage import LATENCY


def histogram(value: str, bounds: list[float] = LATENCY) -> list[Column]:
    """Metrics for ``DataFrame.observe``: n and total of the values that are not null, and le_0, le_1, ...: how many are within each bound."""
    c = F.col(value).cast("double")
    return [F.count(c).alias("n"), F.coalesce(F.sum(c), F.lit(0.0)).alias("total"), *[F.count_if(c <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]]


def measured(df: DataFrame, value: str, name: str | None = None, bounds: list[float] = LATENCY) -> tuple[DataFrame, Observation]:
    """``df`` and the histogram of ``value`` that its first action fills; ``Observation.get`` waits for that action."""
    seen = Observation(name) if name else Observation()
    return df.observe(seen, *histogram(value, bounds)), seen


def exposition(name: str, found: dict, bounds: list[float] = LATENCY) -> str:
    """A histogram's metrics as monitoring systems read them: cumulative buckets, sum and count."""
    rows = [f'{name}_bucket{{le="{b:g}"}} {found[f"le_{i}"]}' for i, b in enumerate(bounds)]
    rows += [f'{name}_bucket{{le="+Inf"}} {found["n"]}', f"{name}_sum {found['total']:g}", f"{name}_count {found['n']}"]
    return "\n".join([f"# TYPE {name} histogram", *rows]) + "\n"


class StreamMetrics(StreamingQueryListener):
    """Adds up what the micro-batches of running streams observe, by the observation's name.

    A batch that is repeated after a restart replaces its earlier figures.  It holds one
    row of numbers a batch until ``total`` is read with ``forget``.
    """

    def __init__(self) -> None:
        self._seen: dict[str, dict[tuple[str, int], dict]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        for name, row in event.progress.observedMetrics.items():
            self._seen.setdefault(name, {})[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        pass

    def total(self, name: str) -> dict:
        """The sum of every metric over all batches; empty if nothing was observed under the name."""
        out: dict = {}
        for row in self._seen.get(name, {}).values():
            for key, number in row.items():
                out[key] = out.get(key, 0) + (number or 0)
        return out
