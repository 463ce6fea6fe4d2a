"""Order of input files, for rules such as "the last row wins"."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listing and row metadata write local paths with one slash or three.
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*:)/+"


def with_file_rank(raw: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns plus ``file_rank``, the place of the row's file in path order.

    One form for one and for many files; the ranks are as many rows as the scan lists files. A row of a
    file that is not in the listing is an error.
    """
    files = sorted(raw.inputFiles())
    ranks = raw.sparkSession.createDataFrame(
        [(re.sub(_SCHEME, r"\1/", f), i) for i, f in enumerate(files)], "_file string, file_rank bigint"
    )
    named = raw.select(*columns, F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "$1/").alias("_file"))
    unknown = F.raise_error(F.concat(F.lit("not in the listing of the input: "), F.col("_file"))).cast("bigint")
    return named.join(ranks, "_file", "left").withColumn("file_rank", F.coalesce("file_rank", unknown)).drop("_file")
