"""Basin polygons: one-off ingest of WKB into native arrays, and the level-12 code lookup."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType

from floodspark.functions.parsing import strict_int
from floodspark.functions.planar import PARTS_TYPE, extent_of
from floodspark.sources.file_order import with_file_rank

_POLYGON, _MULTI_POLYGON = 3, 6
_POINTS = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def _decode_polygons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the WKB column of each batch by coordinate arrays. Z and M values are left out."""
    for batch in batches:
        parts_at, rings_at, points_at, chunks, multi = [0], [0], [0], [], []
        for wkb in batch.column("geometry"):
            data = wkb.as_buffer()
            at, pending, is_multi = 0, 1, False
            while pending:
                order = "<" if data[at] == 1 else ">"
                code, = struct.unpack_from(order + "I", data, at + 1)
                at += 5 + (4 if code & 0x20000000 else 0)
                dims = 2 + (1 if code & 0x80000000 else 0) + (1 if code & 0x40000000 else 0)
                kind = code & 0x0FFFFFFF
                dims += {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
                kind %= 1000
                count, = struct.unpack_from(order + "I", data, at)
                at += 4
                pending -= 1
                if kind == _MULTI_POLYGON:
                    pending, is_multi = pending + count, True
                    continue
                if kind != _POLYGON:
                    raise ValueError(f"geometry type {kind} is not a polygon")
                for _ in range(count):
                    n, = struct.unpack_from(order + "I", data, at)
                    at += 4
                    ring = np.frombuffer(data, order + "f8", n * dims, at).reshape(n, dims)[:, :2]
                    at += n * dims * 8
                    chunks.append(ring.ravel())
                    points_at.append(points_at[-1] + n)
                rings_at.append(rings_at[-1] + count)
            parts_at.append(len(rings_at) - 1)
            multi.append(is_multi)
        flat = np.concatenate(chunks).astype("f8") if chunks else np.empty(0)
        nested = pa.array(flat)
        offsets = [np.arange(0, len(flat) + 1, 2), points_at, rings_at, parts_at]
        for level in offsets:
            nested = pa.ListArray.from_arrays(pa.array(level, pa.int32()), nested)
        yield pa.RecordBatch.from_arrays(
            [batch.column("hybas_id"), batch.column("pfaf"), batch.column("seq"),
             pa.array(multi, pa.bool_()), nested.cast(_POINTS)],
            names=["hybas_id", "pfaf", "seq", "multi", "parts"],
        )


def _whole_number(raw: DataFrame, name: str) -> Column:
    """BIGINT of an id that is held as text or as a number; what is no whole number is NULL, never an error."""
    kind = raw.schema[name].dataType
    if isinstance(kind, (FloatType, DoubleType, DecimalType)):
        return F.when(F.col(name) == F.floor(F.col(name)), F.col(name).try_cast("bigint"))
    return F.col(name).cast("bigint") if isinstance(kind, IntegralType) else strict_int(F.col(name).cast("string"))


def _code_text(raw: DataFrame, name: str) -> Column:
    """A code as text; one that is held as a floating number loses the form of such numbers."""
    kind = raw.schema[name].dataType
    return (_whole_number(raw, name) if isinstance(kind, (FloatType, DoubleType, DecimalType)) else F.col(name)).cast("string")


def polygon_drops(raw: DataFrame) -> DataFrame:
    """One row of counts: polygons, and those that the ingest drops for their id, code or geometry."""
    bad_id, no_code, no_shape = _whole_number(raw, "HYBAS_ID").isNull(), _code_text(raw, "PFAF_ID").isNull(), F.col("geometry").isNull()
    return raw.agg(
        F.count(F.lit(1)).alias("polygons"), F.count_if(bad_id).alias("without_id"), F.count_if(~bad_id & no_code).alias("without_code"),
        F.count_if(~bad_id & ~no_code & no_shape).alias("without_shape"),
    )


def ingest_polygons(raw: DataFrame, level: int) -> DataFrame:
    """(level, hybas_id, pfaf, seq, multi, parts, xmin, ymin, xmax, ymax), one row per basin id.

    Input has HYBAS_ID, PFAF_ID (text or number), geometry (WKB) and seq, a BIGINT row order. Of
    rows with the same id the first stays. Rows without a whole number as id, a code or a geometry are
    dropped; :func:`polygon_drops` counts them. The order is settled on the slim columns, so no geometry is sorted.
    """
    rows = raw.select(
        _whole_number(raw, "HYBAS_ID").alias("hybas_id"),
        _code_text(raw, "PFAF_ID").alias("pfaf"),
        F.col("seq"),
        "geometry",
    ).where(F.col("hybas_id").isNotNull() & F.col("pfaf").isNotNull() & F.col("geometry").isNotNull())
    first = rows.groupBy("hybas_id").agg(F.min("seq").alias("seq"))
    unique = rows.join(first, ["hybas_id", "seq"], "left_semi")
    decoded = unique.mapInArrow(
        _decode_polygons,
        f"hybas_id bigint, pfaf string, seq bigint, multi boolean, parts {PARTS_TYPE}",
    )
    extent = extent_of(F.col("parts"))
    return decoded.select(
        F.lit(level).alias("level"), "*", *[column.alias(name) for name, column in extent.items()]
    )


def level_file(folder: str, level: int) -> str:
    return f"{folder.rstrip('/')}/HUC{level:02d}.parquet"


def _with_row_order(raw: DataFrame, *columns) -> DataFrame:
    """The columns plus ``seq``: the row number in the file, files in path order."""
    ranked = with_file_rank(raw, *columns, F.col("_metadata.row_index").alias("_row"))
    return ranked.withColumn("seq", F.shiftleft(F.col("file_rank"), 40) + F.col("_row")).drop("file_rank", "_row")


def read_level_polygons(spark: SparkSession, folder: str, level: int) -> DataFrame:
    """Raw polygon rows of one level with a row order, ready for the ingest."""
    raw = spark.read.parquet(level_file(folder, level))
    return _with_row_order(raw, "HYBAS_ID", "PFAF_ID", "geometry")


def read_code_lookup(spark: SparkSession, folder: str, level: int = 12) -> DataFrame:
    """(hybas_id, pfaf, seq) of the finest level; no geometry is read."""
    raw = spark.read.parquet(level_file(folder, level))
    return _with_row_order(
        raw,
        _whole_number(raw, "HYBAS_ID").alias("hybas_id"),
        _code_text(raw, "PFAF_ID").alias("pfaf"),
    ).where(F.col("hybas_id").isNotNull())
