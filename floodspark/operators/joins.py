"""Joins whose sides Spark cannot size before they have run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_merge(side: DataFrame) -> DataFrame:
    """A side that grows with the input and is joined by shuffle and merge, never sent through the driver.

    Before anything has run, Spark sizes a side by the bytes of the file below it. Nested arrays and derived text can be a
    hundred times that, so a side that looks small enough to broadcast may not fit the driver. Adaptive execution still
    splits such a join where a key is hot.
    """
    return side.hint("merge")
