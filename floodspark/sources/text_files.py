"""CSV inputs. Cells arrive as text; each parser decides per field what a bad cell means."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.functions import parsing
from floodspark.functions.fixed_values import IMPACT_FIELDS, IMPACT_FILES, RETURN_PERIOD_TIERS
from floodspark.functions.severity import gauge_severity, return_period_severity
from floodspark.sources.file_order import with_file_rank

#: Column that orders rows for "first wins" and "last wins" rules.
SEQ = "seq"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark can reach."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def read_csv_text(
    spark: SparkSession, path, required=(), optional=(), seq_column: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header as all-text columns plus ``seq``.

    Header names are trimmed; a byte-order mark is dropped. A missing required column, or an empty
    file, is an error; a missing optional column is all NULL. ``seq``, DECIMAL(38,0) in every case, is the given column
    when the input carries its own row number, else the position in the files, in path order.
    """
    # Files of one input must agree in their header; otherwise cells would land in the wrong column.
    raw = spark.read.csv(
        path, header=True, inferSchema=False, escape='"', encoding="UTF-8", multiLine=multi_line, enforceSchema=False
    )
    present = {name.strip().lstrip("﻿"): name for name in raw.columns}
    missing = [name for name in required if name not in present]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")

    def quoted(name: str) -> Column:
        return F.col("`" + present[name].replace("`", "``") + "`")

    columns = [
        (quoted(name) if name in present else F.lit(None).cast("string")).alias(name)
        for name in dict.fromkeys([*required, *optional])
    ]
    if seq_column:
        order = parsing.strict_int(quoted(seq_column))
    else:
        # Rows count up within a block, blocks are told apart by where they start in their file, and
        # files by their path: one number of fixed width, however many files there are.
        row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
        ranked = with_file_rank(raw, *columns, F.col("_metadata.file_block_start").alias("_block"), row.alias("_row"))
        order = (
            F.col("file_rank").cast("decimal(12,0)") * F.lit(Decimal(2**83))
            + F.col("_block").cast("decimal(16,0)") * F.lit(Decimal(2**33)) + F.col("_row").cast("decimal(11,0)")
        ).cast("decimal(38,0)")
        return ranked.withColumn(SEQ, order).drop("file_rank", "_block", "_row")
    # A row without a number would have no place, and its key would match nothing.
    numbered = F.when(order.isNotNull(), order).otherwise(F.raise_error(F.lit(f"{seq_column}: not a whole number")).cast("bigint"))
    return raw.select(*columns, numbered.cast("decimal(38,0)").alias(SEQ))


def malformed_lines(spark: SparkSession, path, source: str) -> DataFrame:
    """(source, file, line, reason) of the lines that the single-line reader cannot take as written.

    ``quotes``: a quoted cell does not end on its line, as where a cell holds a line break. ``cells``: the line has
    more or fewer cells than the header. The readers keep what they can make of such lines; this table tells which.
    """
    width = len(spark.read.csv(path, header=True, inferSchema=False, escape='"', encoding="UTF-8").columns)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))

    def count(text: Column, character: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))

    # Quoted stretches, with the doubled quotes inside them, hold no separators.
    cells = count(F.regexp_replace("line", '"[^"]*"', ""), ",") + 1
    reason = F.when(count(F.col("line"), '"') % 2 == 1, "quotes").when(cells != width, "cells")
    marked = lines.where(F.trim("line") != "").select(F.lit(source).alias("source"), "file", "line", reason.alias("reason"))
    return marked.where(F.col("reason").isNotNull())


def read_crosswalk(spark: SparkSession, path, **options) -> DataFrame:
    return read_csv_text(spark, path, ("Basin_ID", "Best_Match"), **options)


def read_reaches(spark: SparkSession, path, **options) -> DataFrame:
    return read_csv_text(spark, path, ("comid", "ret_per", "mean"), ("lat", "lon"), **options)


GAUGE_COLUMNS = (
    "severity", "gaugeLocation.latitude", "gaugeLocation.longitude", "gaugeId",
    "queriedCountryName", "issuedTime", "forecastTimeRange.start", "forecastTimeRange.end",
)


def read_gauges(spark: SparkSession, path, **options) -> DataFrame:
    """Gauge alerts; a missing file is an empty input."""
    if not path_exists(spark, path):
        schema = ", ".join(f"`{name}` string" for name in GAUGE_COLUMNS)
        return spark.createDataFrame([], f"{schema}, {SEQ} decimal(38,0)")
    return read_csv_text(spark, path, (), GAUGE_COLUMNS, **options)


def read_impact_files(spark: SparkSession, folder: str, files=None, multi_line: bool = False) -> dict[str, DataFrame]:
    """The exposure files that exist, by name, as text; ``multi_line`` if cells hold line breaks."""
    found = {}
    for name, columns in (files or IMPACT_FILES).items():
        path = f"{folder.rstrip('/')}/{name}"
        if path_exists(spark, path):
            found[name] = read_csv_text(spark, path, (), ("HYBAS_ID", *columns), multi_line=multi_line).drop(SEQ)
    return found


# --- parsers: text rows -> typed rows --------------------------------------------------------------


def parse_crosswalk(raw: DataFrame) -> DataFrame:
    """(basin_id, comid, is_hole, seq). Rows without a basin id are ignored, not holes."""
    basin = parsing.stripped(F.col("Basin_ID"))
    parsed = raw.where(basin != "").select(
        parsing.strict_int(F.col("Basin_ID")).alias("basin_id"),
        parsing.truncated_int(F.col("Best_Match")).alias("comid"),
        SEQ,
    )
    return parsed.withColumn("is_hole", F.col("basin_id").isNull() | F.col("comid").isNull())


def parse_reaches(raw: DataFrame, tiers=RETURN_PERIOD_TIERS, min_mean_flow: float | None = None) -> DataFrame:
    """(comid, severity, ret_per, mean, lat, lon, seq) of the rows that raise an alert.

    ``min_mean_flow`` drops reaches with less mean flow; off by default.
    """
    parsed = raw.select(
        parsing.strict_int(F.col("comid")).alias("comid"),
        parsing.truncated_int(F.col("ret_per")).alias("ret_per"),
        F.coalesce(parsing.float_text(F.col("mean")), F.lit(0.0)).alias("mean"),
        parsing.float_text(F.col("lat")).alias("lat"),
        parsing.float_text(F.col("lon")).alias("lon"),
        SEQ,
    ).withColumn("severity", return_period_severity(F.col("ret_per"), tiers))
    flagged = parsed.where(F.col("comid").isNotNull() & F.col("severity").isNotNull())
    return flagged if min_mean_flow is None else flagged.where(F.col("mean") >= min_mean_flow)


def parse_gauges(raw: DataFrame, labels=None) -> DataFrame:
    """Alerts with a known label and two numeric coordinates; NaN counts as numeric here."""
    def cell(name: str) -> Column:
        return F.col(f"`{name}`")

    return raw.select(
        gauge_severity(cell("severity"), labels).alias("severity"),
        parsing.float_text(cell("gaugeLocation.latitude")).alias("lat"),
        parsing.float_text(cell("gaugeLocation.longitude")).alias("lon"),
        parsing.stripped(cell("gaugeId")).alias("gauge_id"),
        parsing.stripped(cell("queriedCountryName")).alias("country"),
        parsing.stripped(cell("issuedTime")).alias("issued"),
        parsing.stripped(cell("forecastTimeRange.start")).alias("starts"),
        parsing.stripped(cell("forecastTimeRange.end")).alias("ends"),
        SEQ,
    ).where(F.col("severity").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def parse_impact(raw_files: dict[str, DataFrame], files=None) -> DataFrame:
    """All files as one table: hybas_id and the five fields, NULL for fields of other files.

    Total rows and rows without an integer id are skipped; a blank or bad value counts as 0.
    Values are decimals, so that sums do not depend on how the rows are partitioned.
    """
    tables = []
    for name, raw in raw_files.items():
        fields = {field: column for column, field in (files or IMPACT_FILES)[name].items()}
        tables.append(
            raw.select(
                parsing.strict_int(F.col("HYBAS_ID")).alias("hybas_id"),
                *[
                    (
                        F.coalesce(
                            parsing.float_text(F.col(fields[f])).try_cast("decimal(38,6)"),
                            F.lit(0).cast("decimal(38,6)"),
                        )
                        if f in fields
                        else F.lit(None).cast("decimal(38,6)")
                    ).alias(f)
                    for f in IMPACT_FIELDS
                ],
            ).where(F.col("hybas_id").isNotNull())
        )
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union
