"""First-wins and last-wins rules.

``max_by``/``min_by`` aggregate on the map side, so a key that holds a large share of the rows
arrives at its task as one row per map task; a ranking window would ship and sort them all. All columns
of a key compare the same orders in the same sequence of rows, so rows of equal order never mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """Per key, the values of the row that comes last."""
    return rows.groupBy(*key).agg(*[F.max_by(v, order).alias(v) for v in values])


def keep_first(rows: DataFrame, key: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """Per key, the values of the row that comes first."""
    return rows.groupBy(*key).agg(*[F.min_by(v, order).alias(v) for v in values])
