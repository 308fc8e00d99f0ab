"""Header mapping, cleaning and keys of catalogue rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import clean, strip


@dataclass
class HeaderReport:
    mapped: dict[str, str] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)


def map_headers(columns: list[str]) -> HeaderReport:
    """Source header of each canonical column: exact aliases first, then aliases inside a header, longest first."""
    plain = lambda h: re.sub(r"[^a-z0-9]", "", h.lower())
    alias = refdata.inverted(refdata.HEADER_ALIASES) | {plain(c): c for c in refdata.CATALOGUE_COLUMNS}
    owner: dict[str, str] = {}
    taken: set[str] = set()
    for h in columns:
        name = alias.get(plain(h))
        if name and name not in owner:
            owner[name] = h
            taken.add(h)
    longest = sorted((a for a in alias if len(a) >= 5), key=lambda a: (-len(a), a))
    for h in columns:
        if h in taken:
            continue
        name = next((alias[a] for a in longest if a in plain(h)), None)
        if name and name not in owner:
            owner[name] = h
            taken.add(h)
    if "Mfg_Part_Num" not in owner and "Part_Desc" not in owner:
        raise ValueError(f"neither a part number nor a description among the headers: {', '.join(columns)}")
    return HeaderReport(owner, [c for c in refdata.CATALOGUE_COLUMNS if c not in owner], [h for h in columns if h not in taken])


def normalise_columns(df: DataFrame) -> tuple[DataFrame, HeaderReport]:
    report = map_headers(df.columns)
    quoted = lambda h: F.col(f"`{h}`")
    canonical = [quoted(report.mapped[c]).cast("string").alias(c) if c in report.mapped else F.lit(None).cast("string").alias(c) for c in refdata.CATALOGUE_COLUMNS]
    return df.select(*canonical, *(quoted(h) for h in report.ignored)), report


def find_column(columns: list[str], keywords: list[str], default: str | None = None) -> str | None:
    """The first header that holds all keywords, without regard to case."""
    return next((c for c in columns if all(k.lower() in c.lower() for k in keywords)), default)


def best_brand(unilog: Column, e1: Column, dib: Column) -> Column:
    return F.coalesce(unilog, e1, dib)


def best_manufacturer(manufacturer: Column, brand: Column) -> Column:
    return F.coalesce(manufacturer, brand)


def product_key(row_id: Column, mpn: Column, desc: Column) -> Column:
    return F.coalesce(row_id, mpn, desc, F.lit("row"))


def cleaned(df: DataFrame) -> DataFrame:
    """Canonical columns as a clean record; a catalogue's columns come in, other columns stay."""
    names = {"Mfg_Part_Num": "mpn", "Part_Desc": "part_desc", "E1_Brand": "e1_brand", "Unilog_Brand": "unilog_brand", "DIB_Brand": "dib_brand", "Part_Manuf": "part_manuf"}
    out = df.select(*(c for c in df.columns if c not in names), *(clean(F.col(k)).alias(v) for k, v in names.items()))
    brand = best_brand(F.col("unilog_brand"), F.col("e1_brand"), F.col("dib_brand"))
    return out.withColumn("best_brand", brand).withColumn("best_manufacturer", best_manufacturer(F.col("part_manuf"), F.col("best_brand"))).withColumn("has_brand", F.col("best_brand").isNotNull())


def require_some_content(df: DataFrame) -> DataFrame:
    """df, or an error if no row has a part number or a description."""
    if df.where("mpn IS NOT NULL OR part_desc IS NOT NULL").isEmpty():
        raise ValueError("every row lacks both a part number and a description")
    return df


def name_and_code(c: Column) -> tuple[Column, Column]:
    """'Name (CODE)' as its two parts; without a code all is name."""
    s = strip(c)
    return F.coalesce(F.nullif(strip(F.regexp_extract(s, r"^(.*?)\s*\(([^()]+)\)$", 1)), F.lit("")), s), F.nullif(F.regexp_extract(s, r"^(.*?)\s*\(([^()]+)\)$", 2), F.lit(""))


def bootstrap_master(manufacturers: DataFrame, brands: DataFrame) -> DataFrame:
    """(name, code) from columns raw of both: codes where they are written, else MFR-0001 and on by name.

    Names are few against rows; numbering them takes one sort of the distinct names.
    """
    from pyspark.sql import Window

    both = manufacturers.select("raw").unionByName(brands.select("raw")).select(*(c.alias(n) for c, n in zip(name_and_code(F.col("raw")), ("name", "code"), strict=True)))
    one = both.where("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.min("code").alias("code"))
    number = F.row_number().over(Window.orderBy("name"))
    return one.select("name", F.coalesce("code", F.concat(F.lit("MFR-"), F.lpad(number.cast("string"), 4, "0"))).alias("code"))
