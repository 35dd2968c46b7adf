"""Runs, their events and their metrics, as append-only tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.operators.evaluate import run_metrics
from tieout.sources.store import shared_dir

_SCHEMAS = {
    "run": "run_id string, at_ms bigint, state string, detail string",
    "event": "run_id string, seq bigint, kind string, payload string",
    "metric": "run_id string, model string, tokens bigint, cost_micros bigint, latency_ms bigint",
}


def sequenced(events: DataFrame, run: str, order: str) -> DataFrame:
    """Events with ``seq`` 1, 2, ... within each run."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(order)).cast("bigint"))


def replay(events: DataFrame, cursor: int) -> DataFrame:
    """A run's events after a cursor, in order."""
    return events.where(F.col("seq") > cursor).orderBy("seq")


class RunLog:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/tieout-runs-{uuid.uuid4().hex}"
        self._seq: dict[str, int] = {}
        self._files: dict[str, list[str]] = {k: [] for k in _SCHEMAS}

    def _append(self, table: str, row: tuple) -> None:
        file = f"{self.path}/{table}/{len(self._files[table]):06d}"
        self.spark.createDataFrame([row], _SCHEMAS[table]).coalesce(1).write.parquet(file)
        self._files[table].append(file)

    def table(self, name: str) -> DataFrame:
        files = self._files[name]
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*files) if files else self.spark.createDataFrame([], _SCHEMAS[name])

    def start(self, detail: str = "") -> str:
        run_id = uuid.uuid4().hex
        self._append("run", (run_id, int(time.time() * 1000), "running", detail))
        return run_id

    def finish(self, run_id: str, state: str = "done", detail: str = "") -> None:
        self._append("run", (run_id, int(time.time() * 1000), state, detail))

    def event(self, run_id: str, kind: str, payload: str = "{}") -> int:
        self._seq[run_id] = self._seq.get(run_id, 0) + 1
        self._append("event", (run_id, self._seq[run_id], kind, payload))
        return self._seq[run_id]

    def metric(self, run_id: str, model: str, tokens: int, cost_micros: int, latency_ms: int) -> None:
        self._append("metric", (run_id, model, tokens, cost_micros, latency_ms))

    def events_after(self, run_id: str, cursor: int = 0) -> DataFrame:
        return replay(self.table("event").where(F.col("run_id") == run_id), cursor)

    def totals(self) -> DataFrame:
        """(model, calls, tokens, cost_micros, latency_ms), the dearest first."""
        return run_metrics(self.table("metric")).orderBy(F.desc("cost_micros"))
