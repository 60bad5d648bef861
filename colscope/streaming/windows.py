"""Quality of a stream: windowed counts with a watermark, and the profile of every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import col, families, value
from ..operators import sections
from ..plans.kernel import column_stats


def windowed_quality(stream: DataFrame, time: str, window: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Per event-time window (and key): rows, and per column the missing count; for numbers also mean, min and max.

    Works alike on streams and tables. Rows later than ``late`` are dropped by a stream; state is one row per open window.
    """
    fams = families(stream)
    src = stream.withWatermark(time, late) if stream.isStreaming and late else stream
    cells: list[Column] = [F.count("*").alias("n_rows")]
    for f in stream.schema.fields:
        if f.name == time or f.name in (by or []):
            continue
        c = value(f.name, fams[f.name], f)
        cells.append(F.count_if(c.isNull()).alias(f"{f.name}_missing"))
        if fams[f.name] == "numeric":
            cells += [F.avg(c).alias(f"{f.name}_mean"), F.min(c).alias(f"{f.name}_min"), F.max(c).alias(f"{f.name}_max")]
    w = F.window(col(time), window, slide) if slide else F.window(col(time), window)
    keys = [w.alias("w"), *(col(k) for k in by or [])]
    out = src.groupBy(*keys).agg(*cells)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def profile_batches(section: str, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands the section's report on each micro-batch to ``sink(report, epoch)``."""
    make = sections.SECTIONS[section.lower()]

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            sink(make(batch, column_stats(batch)), epoch)
        finally:
            batch.unpersist()

    return run
