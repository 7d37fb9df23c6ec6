"""Counters of what a job has seen, rejected and kept, taken while it runs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT = "stage string, counter string, value long"


class Counters:
    """Counts at points of a plan, without jobs of their own.

    Each watched frame is counted by the first action that runs it; report() is for after that. Counts are of all rows that
    went by, as Spark takes each task's only once, however often it was tried.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.watched: list[tuple[str, Observation, list[str]]] = []
        self.took: list[tuple[str, str, int]] = []

    def watch(self, df: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """df, with its rows counted, and each of counters: an aggregate that gives a whole number."""
        seen = Observation()
        cols = [F.count(F.lit(1)).alias("rows"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in counters.items()]]
        self.watched.append((stage, seen, ["rows", *counters]))
        return df.observe(seen, *cols)

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        """Milliseconds that a part of the driver's program takes, its jobs included, and that it was called."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.took += [(stage, "calls", 1), (stage, "ms", round(1000 * (time.perf_counter() - began)))]

    def report(self) -> DataFrame:
        """stage, counter, value: in the order of the stages; stages of one name are added up."""
        rows, order = {}, {}
        for stage, seen, names in self.watched:
            got = seen.get
            for n in names:
                rows[stage, n] = rows.get((stage, n), 0) + got[n]
        for stage, n, v in self.took:
            rows[stage, n] = rows.get((stage, n), 0) + v
        for stage, _ in rows:
            order.setdefault(stage, len(order))
        return self.spark.createDataFrame([(s, n, v) for (s, n), v in sorted(rows.items(), key=lambda x: order[x[0][0]])], REPORT)
