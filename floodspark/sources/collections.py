"""Stored collections: GeoJSON lines, Parquet tables, and whole GeoJSON documents made elsewhere."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.operators.documents import FEATURE_TYPE, parse_features, parse_lines
from floodspark.sources.text_files import path_exists


def _under(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


# A collection is published whole: a build writes a snapshot folder of its own, and ``current`` is replaced at the end.
# A reader that has opened a snapshot keeps reading it, and never sees new features beside old tallies.

_POINTER = "current"


def new_snapshot(folder: str) -> str:
    """Folder for the tables of one build."""
    return _under(folder, f"snapshot-{uuid.uuid4().hex}")


def publish(spark: SparkSession, folder: str, snapshot: str) -> None:
    """Makes a finished snapshot the collection, by the rename of one small file."""
    jvm, configuration = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    written, pointer = path(_under(folder, f".{_POINTER}-{uuid.uuid4().hex}")), path(_under(folder, _POINTER))
    out = written.getFileSystem(configuration).create(written, True)
    out.writeBytes(snapshot.rstrip("/").rsplit("/", 1)[-1])
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), configuration).rename(written, pointer, options)


def published(spark: SparkSession, folder: str) -> str:
    """The snapshot that a reader opens; the folder itself where its tables lie in it directly."""
    if not path_exists(spark, _under(folder, _POINTER)):
        return folder
    return _under(folder, spark.read.text(_under(folder, _POINTER)).first().value)


def write_manifest(spark: SparkSession, folder: str, kind: str, resolutions) -> None:
    """One row: what the collection is and which resolutions it declares."""
    row = spark.createDataFrame([(kind, [int(r) for r in resolutions])], "kind string, resolutions array<int>")
    row.coalesce(1).write.mode("overwrite").json(_under(folder, "manifest"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("kind string, resolutions array<int>").json(_under(published(spark, folder), "manifest"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """(res, line) as text files, one feature per line, one folder per resolution."""
    lines.write.mode("overwrite").partitionBy("res").text(_under(folder, "lines"))


def write_feature_collections(spark: SparkSession, folder: str, kind: str, resolutions) -> None:
    """The written lines as GeoJSON documents, ``documents/res=N/*.txt``, which any JSON parser reads.

    Every file is one FeatureCollection with the features of one task, streamed batch by batch; the files of a
    resolution are about as large as one split of the lines, so no task or reader has to hold a resolution.
    Nothing is shuffled. A resolution without features has no file.
    """
    for res in resolutions:
        head = json.dumps({"type": "FeatureCollection", "kind": kind, "resolutions": [int(res)]})[:-1] + ', "features": ['

        def enclosed(batches: Iterator[pa.RecordBatch], head: str = head) -> Iterator[pa.RecordBatch]:
            before = head
            for batch in batches:
                rows = []
                for line in batch.column("value").to_pylist():
                    rows.append(before + line)
                    before = ","
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
            if before != head:
                yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

        place = _under(folder, f"lines/res={int(res)}")
        if path_exists(spark, place):
            documents = spark.read.text(place).mapInArrow(enclosed, "value string")
            # A file that is cut after some number of rows would be no document.
            documents.write.mode("overwrite").option("maxRecordsPerFile", 0).text(_under(folder, f"documents/res={int(res)}"))


def read_lines(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Parsed features of written lines; files split anywhere between lines. ``payload`` keeps each forecast whole."""
    lines = spark.read.text(_under(published(spark, folder), "lines")).withColumnRenamed("value", "line")
    return parse_lines(lines, payload=payload)


def write_table(table: DataFrame, folder: str, name: str, by: str | None = None) -> None:
    """One table of a collection as Parquet, one folder per resolution, so that a view on one
    resolution prunes the others.

    ``by`` clusters the rows of a resolution: files hold ranges of that column, each in order, so a lookup skips the files and
    row groups that state another range. Ranges are drawn from a sample, so ``table`` should be cheap to compute twice.
    """
    if by is not None:
        table = table.repartitionByRange("res", by).sortWithinPartitions("res", by)
    table.write.mode("overwrite").partitionBy("res").parquet(_under(folder, name))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(_under(published(spark, folder), name))


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """(metric, value) rows of the build."""
    return spark.read.parquet(_under(published(spark, folder), "report"))


def read_documents(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(manifest, parsed features) of whole GeoJSON documents.

    A document is one JSON value, so one task parses each file; several files go in parallel, as those of
    ``write_feature_collections`` do. Use the line form for anything large.
    """
    schema = f"kind string, resolutions array<string>, features array<{FEATURE_TYPE}>"
    documents = spark.read.schema(schema).json(path, multiLine=True)
    # What is no number of this range declares nothing.
    numbers = F.transform("resolutions", lambda r: r.try_cast("double").try_cast("int"))
    manifest = documents.select("kind", F.filter(numbers, lambda r: r.isNotNull()).alias("resolutions"))
    return manifest, parse_features(documents.select(F.explode("features").alias("feature")))
