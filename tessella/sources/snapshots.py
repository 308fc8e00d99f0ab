"""Snapshots: several tables that become visible together, or not at all.

Each table is written to a folder of a new version, and its rows are checked as they are written
(the counts come with the write, without another pass). When all are there and no row failed, one
rename of a small pointer file makes the version the current one. A broken row, a failed job or a
lost driver leaves the pointer, and so the old tables, as they were.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
#: Writes a frame into a folder.
Writer = Callable[[DataFrame, str], None]


class Rejected(ValueError):
    """Rows that failed checks, by table and check."""

    def __init__(self, failed: dict[str, dict[str, int]]) -> None:
        super().__init__(f"rows failed checks: {failed}")
        self.failed = failed


def parquet(df: DataFrame, folder: str) -> None:
    df.write.parquet(folder)


def csv(df: DataFrame, folder: str) -> None:
    df.write.csv(folder, header=True, emptyValue="", escape='"')


def json(df: DataFrame, folder: str) -> None:
    df.write.json(folder)


def _path(spark: SparkSession, name: str) -> object:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _delete(spark: SparkSession, folder: str) -> None:
    p = _path(spark, folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Replaces the pointer in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fresh, current = _path(spark, f"{path}/{POINTER}.{version}"), _path(spark, f"{path}/{POINTER}")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, current, overwrite)


def checked(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """df, and a function that tells, once df has been written, how many rows failed each check (null fails too)."""
    if not checks:
        return df, dict
    seen = Observation()
    named = {f"c{k}": name for k, name in enumerate(checks)}
    counted = [F.count_if(~F.coalesce(check, F.lit(False))).alias(f"c{k}") for k, check in enumerate(checks.values())]
    return df.observe(seen, *counted), lambda: {named[k]: n for k, n in seen.get.items() if n}


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], checks: dict[str, dict[str, Column]] | None = None, writers: dict[str, Writer] | None = None) -> str:
    """Writes all tables as a new version and makes it current; returns its name. checks: by table, conditions that all of its
    rows must meet; Rejected if any doesn't. Whatever goes wrong, the current version stays and the new one is deleted."""
    path, version, failed = path.rstrip("/"), uuid.uuid4().hex, {}
    if any(not re.fullmatch(r"[A-Za-z0-9-]+", name) for name in tables):
        raise ValueError("tables are named by letters, digits and hyphens")
    try:
        for name, df in tables.items():
            watched, broken = checked(df, (checks or {}).get(name, {}))
            (writers or {}).get(name, parquet)(watched, f"{path}/{version}/{name}")
            if found := broken():
                failed[name] = found
        if failed:
            raise Rejected(failed)
        _point(spark, path, version)
    except BaseException:
        _delete(spark, f"{path}/{version}")
        raise
    return version


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version; None if there is none."""
    p = _path(spark, f"{path.rstrip('/')}/{POINTER}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(f"{path.rstrip('/')}/{POINTER}").first()[0]


def folder(spark: SparkSession, path: str, table: str) -> str:
    """Where a table of the current version is."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path}: nothing was published")
    return f"{path.rstrip('/')}/{version}/{table}"


def prune(spark: SparkSession, path: str) -> None:
    """Deletes all versions but the current one; for when nobody reads an older one any more."""
    keep, base = current(spark, path), _path(spark, path)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(base):
        if status.isDirectory() and status.getPath().getName() != keep:
            files.delete(status.getPath(), True)
