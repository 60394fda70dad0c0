"""Resampling of streams of pixels onto a fixed grid.

Each micro-batch holds whole scenes (all pixels of one leading value, such as a time) and is
resampled by the same plan as a table; results are appended under the batch's number, so
a batch that is run again after a failure replaces its own output only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.resample import resample_in_space
from ..plans.grid import GridMapping
from ..sources.frame import GridFrame


def resample_stream(stream: DataFrame, source_gm: GridMapping, target_gm: GridMapping, path: str, checkpoint: str, *, leading: tuple[str, ...] = (), trigger: dict[str, Any] | None = None, on_batch: Callable[[int], None] | None = None, **options: Any) -> StreamingQuery:
    """Starts a query that resamples a stream of (leading..., j, i, variables) and writes parquet under path."""

    def write(batch: DataFrame, number: int) -> None:
        frame = GridFrame.from_dataframe(batch, source_gm, leading=leading)
        out = resample_in_space(frame, target_gm, **options)
        out.df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
