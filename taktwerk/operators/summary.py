"""Summaries of queries: how many rows they read and gave, and how long they took, beside their result."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Summary(NamedTuple):
    """What a run of a query cost."""

    read_rows: int
    result_rows: int
    elapsed_ns: int

    @property
    def rows_a_second(self) -> float:
        return self.read_rows / (self.elapsed_ns / 1e9)


class Measured:
    """Counts the rows that pass a point of a plan while it runs; no pass of its own."""

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def counted(self, df: DataFrame) -> DataFrame:
        """The same rows, counted where they are read."""
        self.seen.append(Observation(f"rows-{uuid.uuid4().hex}"))
        return df.observe(self.seen[-1], F.count(F.lit(1)).alias("rows"))

    def run(self, df: DataFrame, act: Callable[[DataFrame], object]) -> tuple[object, Summary]:
        """Does ``act`` (a write, a collect) with ``df`` once; what it gives, and the summary of that run."""
        given = Observation(f"result-{uuid.uuid4().hex}")
        watched = df.observe(given, F.count(F.lit(1)).alias("rows"))
        began = time.perf_counter_ns()
        result = act(watched)
        elapsed = time.perf_counter_ns() - began
        return result, Summary(sum(o.get["rows"] for o in self.seen), given.get["rows"], elapsed)


class StreamSummaries(StreamingQueryListener):
    """Keeps (query, batch, rows, milliseconds) of every batch of every query of a session, the newest ``most`` of them."""

    def __init__(self, most: int = 1000) -> None:
        self.most, self.batches, self.ended = most, [], {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches = [*self.batches, (str(p.id), p.batchId, p.numInputRows, p.batchDuration)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
