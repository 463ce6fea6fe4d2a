"""Points with whatever columns they bring.

The grid builds need a place and a severity. The forecast fields that a point has stay columns; everything else
travels in one VARIANT, ``payload``, so that neither plans nor stored tables depend on what a source sends along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from floodspark.functions.fixed_values import FORECAST_FIELDS
from floodspark.functions.parsing import float_text
from floodspark.operators.forecasts import has_coordinate

#: Columns that give rows of a list their order.
ORDER_FIELDS = ("list_rank", "list_seq")
PAYLOAD = "payload"
_TYPES = {"returnPeriodYr": "bigint", "peakDischargeCms": "double"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def open_points(rows: DataFrame) -> DataFrame:
    """Points of any columns, ``lat``, ``lon`` and ``severity`` among them, in the form of the grid builds.

    Coordinates become DOUBLE, NULL where they are no numbers. A forecast field keeps its name, numbers that are none
    become NULL; ``model`` is empty where there is none. All further columns go to ``payload``, which is there only if
    there are any; a column named ``payload`` is one of them.
    """
    missing = [n for n in ("lat", "lon", "severity") if n not in rows.columns]
    if missing:
        raise ValueError(f"points have no column {', '.join(missing)}")

    def field(name: str):
        column = F.col(_quoted(name))
        if name in ("lat", "lon"):
            is_number = isinstance(rows.schema[name].dataType, NumericType)
            return column.cast("double") if is_number else float_text(column.cast("string"))
        return column.try_cast(_TYPES[name]) if name in _TYPES else column.cast("string")

    known = [n for n in FORECAST_FIELDS if n in rows.columns]
    order = [n for n in ORDER_FIELDS if n in rows.columns]
    further = [n for n in rows.columns if n not in known and n not in order]
    columns = [field(n).alias(n) for n in known]
    if "model" not in known:
        columns.insert(0, F.lit("").alias("model"))
    if further:
        packed = F.struct(*[F.col(_quoted(n)).alias(n) for n in further])
        columns.append(F.to_variant_object(packed).alias(PAYLOAD))
    return rows.select(*columns, *order)


def usable(points: DataFrame) -> DataFrame:
    """Opened points whose coordinates are numbers."""
    return points.where(has_coordinate("lat", "lon"))


def with_payload_text(rows: DataFrame) -> DataFrame:
    """``payload`` as JSON text, which can be hashed and sorted; a VARIANT cannot."""
    return rows.withColumn(PAYLOAD, F.to_json(PAYLOAD)) if PAYLOAD in rows.columns else rows
