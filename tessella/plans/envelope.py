"""Stages of a pipeline in an envelope: a row that fails in one goes no further, and says where and why.

A row carries its raw columns, its index and its first error. Once it has one, its working columns
are null, so no later stage can trip over it; at the end it comes back as it came in. A stage may
find errors in two ways: by its own faults(), a condition on what it is given, or by noting them
itself, as rowwise() does for functions of one row that raise. No stage splits the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = "struct<stage:string,reason:string>"
RAW, FAILED, INDEX = "_came_in", "_failed", "row_index"


@dataclass
class Stage:
    """run keeps columns that it does not know. faults: from its input, a reason or null."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    faults: Callable[[DataFrame], Column] | None = None


def _blanked(df: DataFrame) -> DataFrame:
    kept = (RAW, FAILED, INDEX)
    return df.select(*(F.col(c) if c in kept else F.when(F.col(FAILED).isNull(), F.col(c)).alias(c) for c in df.columns))


def through(rows: DataFrame, stages: list[Stage]) -> DataFrame:
    """rows(row_index, ...) after all stages, with _came_in and _failed(stage, reason) of the first stage that failed."""
    df = rows.withColumn(RAW, F.struct(*(c for c in rows.columns if c != INDEX))).withColumn(FAILED, F.lit(None).cast(ERROR))
    for stage in stages:
        if stage.faults is not None:
            why = stage.faults(df).cast("string")
            df = df.withColumn(FAILED, F.coalesce(FAILED, F.when(why.isNotNull(), F.struct(F.lit(stage.name).alias("stage"), why.alias("reason")))))
            df = _blanked(df)
        df = stage.run(df)
        df = _blanked(df)
    return df


def products(done: DataFrame) -> DataFrame:
    return done.where(F.col(FAILED).isNull()).drop(RAW, FAILED)


def quarantine(done: DataFrame) -> DataFrame:
    """(row_index, stage, reason, the raw columns) of the rows that failed."""
    return done.where(F.col(FAILED).isNotNull()).select(INDEX, f"{FAILED}.stage", f"{FAILED}.reason", f"{RAW}.*")


def rowwise(name: str, function: Callable[..., object], inputs: list[str], output: str, kind: str) -> Stage:
    """A stage that sets output to function(of the inputs), one row at a time over Arrow batches; what it raises is the row's error."""

    def run(df: DataFrame) -> DataFrame:
        schema = T.StructType([*(f for f in df.schema.fields if f.name != output), T.StructField(output, T._parse_datatype_string(kind))])
        names = [f.name for f in schema]

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made, errors = [], []
                for error, *args in zip(frame[FAILED], *(frame[i] for i in inputs), strict=True):
                    try:
                        made.append(function(*args) if error is None else None)
                    except Exception as e:  # the row's, whatever it is
                        made.append(None)
                        error = {"stage": name, "reason": f"{type(e).__name__}: {e}"}
                    errors.append(error)
                yield frame.assign(**{output: pd.Series(made, index=frame.index, dtype=object), FAILED: pd.Series(errors, index=frame.index, dtype=object)})[names]

        return df.mapInPandas(batches, schema)

    return Stage(name, run)
