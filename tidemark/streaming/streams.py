"""Structured Streaming forms of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.align import window_bars
from ..session import importable
from ..sources.views import scratch

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, some files per batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is into a table in the shared folder, exactly once by its checkpoint, and reads it."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path, "parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_bars(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Bars by tumbling windows; a window comes out once events are later than its end plus ``late``."""
    return window_bars(events, every, late)


def stream_averages(events: DataFrame, span: float = 12) -> DataFrame:
    """(event_type, ts, value, ema): exponential averages per type, the state carried over batches; events of a batch are taken in order of ts."""
    importable(events.sparkSession)
    a = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for v in rows["value"].tolist():
            y = v if y is None else (1 - a) * y + a * v
            out.append(y)
        if y is not None:
            state.update((y,))
        yield pd.DataFrame({"event_type": key[0], "ts": rows["ts"], "value": rows["value"], "ema": out})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, ts timestamp, value double, ema double", "y double", "append", GroupStateTimeout.NoTimeout)


def staged(events: DataFrame, files: int = 4) -> str:
    """The events as files of a folder, one after the other by stretches of time, so that a stream reads them in order, a file a trigger."""
    path = scratch(events.sparkSession, "events")
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    at = F.unix_micros("ts")
    edges = rows.agg(F.percentile_approx(at, [i / files for i in range(1, files)], 1000)).first()[0] or []
    for low, high in zip([None, *edges], [*edges, None]):
        part = rows.where(F.lit(True) if low is None else at >= low).where(F.lit(True) if high is None else at < high)
        part.coalesce(1).write.mode("append").parquet(path)
    return path
