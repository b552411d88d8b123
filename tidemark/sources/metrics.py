"""Counters and cumulative histograms of a run, observed while it runs: no pass of their own reads the rows again.

A metric is a named aggregate of the rows that a plan passes on. Spark sums them in its tasks; a batch gives them when
its action ends, a stream with each of its batches through a listener, which adds them up.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

ROWS = "metric string, label string, value long"


class Metrics:
    """What to count. counters: name to conditions by label; histograms: name to a value and the edges of its buckets."""

    def __init__(self, counters: dict[str, dict[str, Column]], histograms: dict[str, tuple[Column, list[int]]]):
        self.expressions = [F.count_if(c).alias(f"{name}|{label}") for name, by in counters.items() for label, c in by.items()]
        for name, (value, edges) in histograms.items():
            # A bucket holds all values up to its edge, so the last one holds all.
            self.expressions += [F.count_if(value <= e).alias(f"{name}_bucket|{e}") for e in edges]
            self.expressions += [F.count(value).alias(f"{name}_bucket|+Inf"), F.sum(value).cast("long").alias(f"{name}_sum|")]


class Registry:
    """Totals by metric and label; runs add to them."""

    def __init__(self):
        self.totals: dict[tuple[str, str], int] = {}

    def add(self, observed: dict[str, int | None]) -> None:
        for key, value in observed.items():
            name, _, label = key.partition("|")
            self.totals[name, label] = self.totals.get((name, label), 0) + (value or 0)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, label, v) for (n, label), v in sorted(self.totals.items())], ROWS)


def batch(rows: DataFrame, metrics: Metrics, registry: Registry, action: Callable[[DataFrame], object]) -> None:
    """Run an action over rows and add what it let pass by."""
    seen = Observation()
    action(rows.observe(seen, *metrics.expressions))
    registry.add(seen.get)


class _Listener(StreamingQueryListener):
    def __init__(self, name: str, registry: Registry):
        self.name, self.registry, self.ended = name, registry, threading.Event()
        self.run = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.registry.add(seen.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.run is None or str(event.runId) == self.run:
            self.ended.set()


def stream(rows: DataFrame, metrics: Metrics, registry: Registry, name: str, start: Callable[[DataFrame], StreamingQuery], wait: float = 60) -> None:
    """Run a streaming query over rows to its end and add what its batches let pass by."""
    spark, listener = rows.sparkSession, _Listener(name, registry)
    spark.streams.addListener(listener)
    try:
        query = start(rows.observe(name, *metrics.expressions))
        listener.run = str(query.runId)
        query.awaitTermination()
        listener.ended.wait(wait)  # progress comes before the end, both behind the query
    finally:
        spark.streams.removeListener(listener)
