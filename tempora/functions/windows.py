"""Windows over a source's words in time order."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec


def by_time(*more: str) -> WindowSpec:
    return Window.partitionBy("source_id", *more).orderBy("start_ms", "word_idx")


def so_far(*more: str) -> WindowSpec:
    return by_time(*more).rowsBetween(Window.unboundedPreceding, 0)
