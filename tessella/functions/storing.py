"""Results that several steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names, so that what reads it twice works it out once and a
    lost executor costs nothing; without such a folder, df as it is."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return df.checkpoint() if folder else df


def packed(df: DataFrame) -> DataFrame:
    """stored(), for large results: as compressed Parquet, since a checkpoint's rows are not compressed."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/packed-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
