"""Positions of rows: in their source, in an order, and tables side by side by position. No step holds a table in one task."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.storing import stored


def _numbered(marked: DataFrame, parts: list[str], name: str) -> DataFrame:
    """marked(_place, parts): positions from 0 by parts, then _place. The sizes of all parts go through one row: an entry a split."""
    sizes = marked.groupBy(*parts).agg(F.count("*").alias("n"), F.min("_place").alias("first"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(*parts, "n", "first"))).alias("all"))
    before = lambda k: F.aggregate(F.slice("all", 1, k), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    starts = listed.select(F.posexplode("all").alias("k", "x"), "all").select(*(F.col(f"x.{p}").alias(f"_s{p}") for p in parts), F.col("x.first").alias("_first"), before(F.col("k")).alias("_before"))
    on = [F.col(p).eqNullSafe(F.col(f"_s{p}")) for p in parts]
    joined = marked.join(F.broadcast(starts), on)  # as many rows as the source has splits
    return joined.withColumn(name, F.col("_before") + F.col("_place") - F.col("_first")).drop("_place", *parts, *(f"_s{p}" for p in parts), "_first", "_before")


def row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """df with the position of each row in its source, from 0: by file and place in it where df reads files, else by partition.

    Rows stay where they are. df must be a plain scan, a projection of one, or stored, so that it is read alike twice."""
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
        parts = ["_file", "_start"]
    except AnalysisException:
        marked, parts = df.withColumn("_part", F.spark_partition_id()), ["_part"]
    return _numbered(marked.withColumn("_place", F.monotonically_increasing_id()), parts, name)


def ordered_index(df: DataFrame, *order, name: str = "row_index") -> DataFrame:
    """df with each row's position by order, from 0: ranges of the order are sorted apart, then numbered on. Equal rows of the
    order follow each other in no stated order; where many are equal, add columns that part them."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return _numbered(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), ["_part"], name)


def side_by_side(left: DataFrame, right: DataFrame, index: str = "row_index") -> DataFrame:
    """Rows of equal position, as far as the shorter table goes; both have index. right's columns come as one struct, 'other'."""
    return left.join(right.select(index, F.struct(*(c for c in right.columns if c != index)).alias("other")), index)
