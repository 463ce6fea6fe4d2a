"""Session defaults for local runs and a statement of the settings the jobs rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans are written for. A cluster sets shuffle partitions to a few times its cores;
#: adaptive execution coalesces what is too many, splits skewed join partitions, and turns a join
#: into a broadcast only when the measured size of one side is below the threshold.
ENGINE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("floodspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in ENGINE_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_folder(spark: SparkSession, output: str) -> str:
    """Shared folder for the intermediate tables of one build.

    A fresh folder below the one the cluster names in spark.checkpoint.dir; where none is named, a
    folder below the output, which every executor can reach as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/floodspark-{uuid.uuid4().hex}"
    return f"{output.rstrip('/')}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write an intermediate table to shared storage and read it back.

    The table has a name, survives the loss of any executor, and cuts the lineage, so the steps
    that use it several times do not recompute it.
    """
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Takes away the intermediate tables of a build that has ended."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
