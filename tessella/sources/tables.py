"""Catalogue readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.operators.catalogue import HeaderReport, find_column, normalise_columns
from tessella.operators.delivery import complete, flat_attributes
from tessella.operators.positions import row_index
from tessella.sources import excel

#: Largest upload.
UPLOAD_BYTES = 50 * 1024 * 1024
READERS = {"csv": "csv", "parquet": "parquet", "json": "json", "xlsx": "xlsx"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, Parquet, JSON or Excel table; what CSV and Excel hold are strings, so part numbers keep their digits."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"can't read .{kind}: {', '.join(READERS)} are supported")
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return excel.read_xlsx(spark, path) if kind == "xlsx" else getattr(spark.read, kind)(path)


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, HeaderReport]:
    """Canonical columns and the header report of a catalogue."""
    return normalise_columns(read_table(spark, path))


def checked_upload(name: str, size: int) -> str:
    """The kind of an uploaded file, or an error if it can't be read or is too large."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind not in READERS:
        raise ValueError(f"can't read .{kind}: {', '.join(READERS)} are supported")
    if size > UPLOAD_BYTES:
        raise ValueError(f"{name} has {size} bytes; {UPLOAD_BYTES} are allowed")
    return kind


def require_rows(df: DataFrame) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError("the file has no rows")
    return df


def checked_limit(limit: str | int | None) -> int | None:
    """A row limit from a form field: digits, or none."""
    if limit is None or limit == "":
        return None
    if not str(limit).isdigit() or int(limit) == 0:
        raise ValueError(f"not a row limit: {limit!r}")
    return int(limit)


def first_rows(df: DataFrame, index: str, n: int | None) -> DataFrame:
    """The first n rows by an explicit index, which unlike limit is stable."""
    return df if n is None else df.where(F.col(index) < n)


def read_master(df: DataFrame, kind: str) -> DataFrame:
    """(name, code, ordinal) of a master list: columns are found by the words in their headers."""
    names, index = {c: c.strip() for c in df.columns}, "_ordinal"
    df = row_index(df, index)
    df = df.withColumnsRenamed(names)
    columns = list(names.values())  # without the index
    if kind == "manufacturer":
        name = find_column(columns, ["manufacturer", "name"], columns[0])
        code = find_column(columns, ["manufacturer", "code"])
    else:
        name = find_column(columns, ["brand", "name"]) or find_column(columns, ["manufacturer", "name"], columns[0])
        code = find_column(columns, ["brand", "code"])
    out = df.select(F.trim(F.col(f"`{name}`")).alias("name"), (F.nullif(F.trim(F.col(f"`{code}`")), F.lit("")) if code else F.lit(None).cast("string")).alias("code"), F.col(index).alias("ordinal"))
    return out.where("name <> ''") if kind == "brand" else out.where("name IS NOT NULL")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Expected values, all as text; blanks are empty, not null."""
    return spark.read.csv(path, header=True, inferSchema=False).na.fill("")


def read_headers(spark: SparkSession, path: str | None) -> list[str]:
    """The layout of a header-only CSV, or the built one where there is no file to read."""
    return refdata.delivery_columns() if path is None else spark.read.csv(path, header=True).columns


def write_delivery(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV in the layout's order; columns that the layout lacks, or that df lacks, are an error."""
    columns = columns or refdata.delivery_columns()
    if df.columns != columns:
        missing, extra = [c for c in columns if c not in df.columns], [c for c in df.columns if c not in columns]
        raise ValueError(f"columns differ from the layout: missing {missing}, extra {extra}" if missing or extra else "columns are not in the layout's order")
    complete(df, columns).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def write_products(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_rows(df: DataFrame) -> DataFrame:
    """Ten flat columns for a spreadsheet, commas inside as semicolons; df is what is left after rejections."""
    flat = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(","), F.lit(";"))
    plain = ["mpn", "part_desc", "manufacturer_name", "brand_name", "classpath"]
    return df.select(*(flat(c).alias(c) for c in plain), F.col("confidence.status").alias("status"), F.col("confidence.overall").alias("overall"), flat_attributes(F.col("attributes")).alias("attributes"), F.to_json("descriptions").alias("descriptions"), F.coalesce("decision", F.lit("")).alias("decision"))
