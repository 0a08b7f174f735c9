"""Structured Streaming: a counter of calls for each API, kept as state."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def number_calls(stream: DataFrame, key: str = "api_id", sequence: str = "seq") -> DataFrame:
    """Adds call_index, from 0 for each key across micro-batches. Within a batch calls count in order of `sequence`."""

    def count(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (begun,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(sequence)
        state.update((begun + len(rows),))
        yield rows.assign(call_index=range(begun, begun + len(rows)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(key).applyInPandasWithState(count, f"{fields}, call_index long", "n long", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, frame: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Writes what a stream has now to Parquet at `path`, exactly once by its checkpoint, and reads it back."""
    query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint or f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """Below the folder the cluster shares; a temporary one in local mode without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="skein-stream-") + "/out"
