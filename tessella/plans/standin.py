"""Catalogue-shaped rows made from the benchmark tables, in expressions that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column, expression over part.
CATALOGUE = [
    ("row_id", "cast(p_partkey AS string)"),
    ("Mfg_Part_Num", "CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE concat('P', lpad(cast(p_partkey AS string), 7, '0')) END"),
    ("Part_Desc", "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' 3/8 CPLG brs 150#' WHEN 1 THEN ' sch 40 VLV SST' WHEN 2 THEN ' std hex' ELSE '' END)"),
    ("E1_Brand", "CASE p_partkey % 4 WHEN 0 THEN '-- Unbranded --' WHEN 1 THEN p_brand WHEN 2 THEN ' N/A ' ELSE NULL END"),
    ("Unilog_Brand", "CASE p_partkey % 3 WHEN 0 THEN '-- No Unilog Brand --' WHEN 1 THEN upper(replace(p_brand, '#', ' ')) ELSE NULL END"),
    ("DIB_Brand", "CASE p_partkey % 5 WHEN 0 THEN 'none' ELSE p_brand END"),
    ("Part_Manuf", "CASE p_partkey % 7 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE concat('Maker ', cast(p_partkey % 76 AS string), ' (M', cast(p_partkey % 76 AS string), ')') END"),
]
#: Label, value, unit, source, page, confidence: expressions over part.
ATTRIBUTES = [
    ("'Size'", "cast(p_size + (p_partkey % 8) / 8.0e0 AS string)", "CASE p_partkey % 4 WHEN 0 THEN 'inches' WHEN 1 THEN 'in.' WHEN 2 THEN 'xyz' ELSE NULL END", "'http://a.example/1'", "1", "0.9e0"),
    ("'Material'", "CASE p_partkey % 5 WHEN 0 THEN 'SS' WHEN 1 THEN ' brass ' WHEN 2 THEN 'aluminium' WHEN 3 THEN 'Unobtanium' ELSE NULL END", "NULL", "'http://a.example/2'", "2", "0.7e0"),
    ("'Voltage Rating'", "CASE WHEN p_partkey % 3 = 0 THEN '120' ELSE '240.0' END", "' volts '", "NULL", "NULL", "0.8e0"),
    ("'Color'", "CASE p_partkey % 3 WHEN 0 THEN 'grey' WHEN 1 THEN 'Gunmetal' ELSE '' END", "''", "'desc'", "3", "0.699e0"),
    ("'Mounting Type'", "CASE p_partkey % 2 WHEN 0 THEN 'built in' ELSE NULL END", "NULL", "'http://a.example/3'", "1", "0.95e0"),
    ("'Number of Wash Cycles'", "CASE p_partkey % 6 WHEN 0 THEN '5.0' WHEN 1 THEN '4' ELSE NULL END", "NULL", "' '", "4", "0.0e0"),
    ("'Sound Level'", "CASE p_partkey % 4 WHEN 3 THEN '48' ELSE NULL END", "'dba'", "'http://a.example/4'", "5", "1.0e0"),
    ("'Amperage Rating'", "'15'", "CASE WHEN p_partkey % 9 = 0 THEN 'bogus' ELSE 'amps' END", "'http://a.example/5'", "1", "0.75e0"),
]
_FIELDS = (("label", "string"), ("candidate_value", "string"), ("candidate_uom", "string"), ("source", "string"), ("source_page", "int"), ("confidence", "double"))

#: Nouns of part names as a small taxonomy: (dept, class, fine, keywords).
TAXONOMY = [
    ("Hardware", "Fasteners", "Bolts", ["bolt", "rod"]),
    ("Hardware", "Fasteners", "Rings", ["ring", "washer ring"]),
    ("Hardware", "Tools", "Anvils", ["anvil"]),
    ("Machinery", "Transmission", "Gears", ["gear", "cold gear"]),
    ("Machinery", "Plates & Sheets", "Plates", ["plate", "late"]),
    ("Plumbing", "Valves", "Valves", ["vlv", "valve"]),
]


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(TAXONOMY)]
    return spark.createDataFrame(rows, "ordinal int, dept string, class_name string, fine string, keywords array<string>")


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def catalogue(parts: DataFrame, *extra: str) -> DataFrame:
    return parts.select(*extra, *(F.expr(e).alias(c) for c, e in CATALOGUE))


def candidates() -> object:
    """Column of part: its attribute candidates."""
    one = lambda row: F.struct(*(F.expr(e).cast(t).alias(n) for (n, t), e in zip(_FIELDS, row, strict=True)))
    return F.array(*map(one, ATTRIBUTES))


def master(parts: DataFrame) -> DataFrame:
    """(name, code, ordinal) of the brands."""
    return parts.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("ordinal")).withColumn("code", F.concat(F.lit("B-"), F.split_part("name", F.lit("#"), F.lit(2)))).select("name", "code", "ordinal")


# The same in SQL.
CATALOGUE_SQL = "cat AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, " + ", ".join(f"{e} AS {c}" for c, e in CATALOGUE) + " FROM part)"
ATTRIBUTES_SQL = "cand AS (" + " UNION ALL ".join("SELECT p_partkey, " + f"{i} AS pos, " + ", ".join(f"CAST({e} AS {t}) AS {n}" for (n, t), e in zip(_FIELDS, row, strict=True)) + " FROM part" for i, row in enumerate(ATTRIBUTES)) + ")"
TAXONOMY_SQL = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d}', '{c}', '{f}', [{', '.join(repr(k) for k in ks)}])" for i, (d, c, f, ks) in enumerate(TAXONOMY)) + ") AS t(ordinal, dept, class_name, fine, keywords))"
