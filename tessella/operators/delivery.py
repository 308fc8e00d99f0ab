"""The wide delivery layout, its inverse, and flat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import strip, without_marks
from tessella.operators.classify import split_path


def _text(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def delivery(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns of the layout, all strings and none null, from products with any of mpn, part_desc, the three brands,
    part_manuf, classpath, dept, class_name, fine, product_name, manufacturer_name, brand_name, trade_name, descriptions,
    features and attributes. Other layout columns are taken by their own name where df has them."""
    columns = columns or refdata.delivery_columns()
    have = set(df.columns)
    own = lambda name, default="": F.coalesce(F.nullif(_text(F.col(f"`{name}`")), F.lit("")), F.lit(default)) if name in have else F.lit(default)
    levels = split_path(F.col("classpath")) if "classpath" in have else (F.lit(""),) * 3
    level = lambda name, k: F.coalesce(F.nullif(own(name), F.lit("")), levels[k])
    brand, mpn = own("brand_name"), own("mpn")
    base = F.concat(F.regexp_replace(without_marks(brand), r"\s+", "_"), F.lit("_"), mpn)
    asset = lambda end: F.when((without_marks(brand) != "") & (mpn != ""), F.concat(base, F.lit(end))).otherwise("")
    made = {
        "Mfg_Part_Num": mpn, "MANUFACTURER_PART_NUMBER": mpn, "Part_Desc": own("part_desc"), "E1_Brand": own("e1_brand", "-- Unbranded --"), "Unilog_Brand": own("unilog_brand", "-- No Unilog Brand --"),
        "DIB_Brand": own("dib_brand", "-- No DIB Brand --"), "Part_Manuf": own("part_manuf"), "Classpath": own("classpath"), "Dept": level("dept", 0), "Class": level("class_name", 1), "Fine": level("fine", 2),
        "Product Name": own("product_name"), "MANUFACTURER_NAME": own("manufacturer_name"), "BRAND_NAME": brand, "TRADE_NAME": own("trade_name"), "Product Image": asset(".jpg"), "Specification Sheet": asset("_Specification_Sheet.pdf"),
    }
    made["Actual Image (Yes/No)"] = F.when(made["Product Image"] != "", "Yes").otherwise("")
    if "descriptions" in have:
        made |= {d: _text(F.try_element_at("descriptions", F.lit(d))) for d in refdata.DESCRIPTIONS}
    if "features" in have:
        made |= {f"ITEM_FEATURES_{i + 1}": _text(F.get("features", F.lit(i))) for i in range(20)}
    if "attributes" in have:
        for i in range(50):
            a = F.get("attributes", F.lit(i))
            made |= {f"ATTRIBUTE_LABEL {i + 1}": _text(a["label"]), f"ATTRIBUTE_VALUE {i + 1}": _text(a["value"]), f"ATTRIBUTE_UOM {i + 1}": _text(a["uom"])}
    return df.select(*((made[c] if c in made else own(c)).alias(c) for c in columns))


def slots_to_attributes(df: DataFrame, slots: int = 50) -> Column:
    """The attribute slots of a delivery row as an array; blank labels are no attributes."""
    each = [F.struct(F.col(f"`ATTRIBUTE_LABEL {i}`").alias("label"), F.nullif(F.col(f"`ATTRIBUTE_VALUE {i}`"), F.lit("")).alias("value"), F.nullif(F.col(f"`ATTRIBUTE_UOM {i}`"), F.lit("")).alias("uom")) for i in range(1, slots + 1)]
    return F.filter(F.array(*each), lambda a: F.coalesce(a["label"] != "", F.lit(False)))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; nulls and missing columns are empty."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def flat_attributes(attributes: Column) -> Column:
    """'label:value uom | …' with commas as semicolons."""
    one = lambda a: F.concat(a["label"], F.lit(":"), F.concat_ws(" ", a["value"], F.nullif(a["uom"], F.lit(""))))
    return F.replace(F.array_join(F.transform(attributes, one), " | "), F.lit(","), F.lit(";"))
