"""Batch metrics, accuracy and completeness. All are partial aggregates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators import positions
from tessella.operators.validate import grounded

#: Rows below which accuracy is little to go by.
FEW = 5


def batch_metrics(scored: DataFrame) -> DataFrame:
    """One row: counts and the means of per-product rates; zeros for no rows."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    return scored.agg(
        F.count("*").alias("products"),
        F.count_if(F.col("confidence.status") == "HIGH").alias("high"),
        F.count_if("confidence.needs_review").alias("needs_review"),
        F.count_if(~F.col("validation.valid")).alias("invalid"),
        mean("validation.lov_rate").alias("lov_rate"),
        mean("validation.uom_rate").alias("uom_rate"),
        mean("validation.grounding_rate").alias("grounding_rate"),
        mean("confidence.overall").alias("confidence"),
    )


def pooled_grounding(products: DataFrame, blanks_count: bool = False, empty: float = 1.0) -> DataFrame:
    """Sourced claims over all claims of all products; a claim is a value, blank ones only if blanks_count."""
    claim = lambda a: a["value"].isNotNull() & (F.lit(blanks_count) | (strip(a["value"]) != ""))
    claims = F.filter("attributes", claim)
    totals = products.agg(F.sum(F.size(claims)).alias("claims"), F.sum(F.size(F.filter(claims, lambda a: grounded(a["source"])))).alias("grounded"))
    return totals.select(F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("grounded", F.lit(0)).alias("grounded"), F.coalesce(F.round(F.try_divide("grounded", "claims"), 4), F.lit(empty)).alias("rate"))


def same_field(a: Column, b: Column) -> Column:
    """Equal but for case and white space; nan, none and null are blank."""
    norm = lambda c: F.lower(F.coalesce(strip(c.cast("string")), F.lit("")))
    blank = lambda c: F.when(norm(c).isin("nan", "none", "null"), "").otherwise(norm(c))
    return blank(a) == blank(b)


def field_accuracy(predicted: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n, accuracy, warning) over rows that both have, and field '(overall)', the mean of the fields'. warning: that
    there are fewer than FEW rows to go by, or null."""
    p = predicted.select(key, *(F.col(f).alias(f"p_{f}") for f in fields))
    e = expected.select(key, *(F.col(f).alias(f"e_{f}") for f in fields))
    both = p.join(e, key)
    hits = both.agg(F.count("*").alias("n"), *(F.round(F.avg(same_field(F.col(f"p_{f}"), F.col(f"e_{f}")).cast("int")), 4).alias(f) for f in fields))
    rows = hits.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("accuracy")) for f in fields), F.struct(F.lit("(overall)").alias("field"), F.round(sum(F.col(f) for f in fields) / len(fields), 4).alias("accuracy")))).alias("r"))
    return rows.select("r.field", "n", "r.accuracy", F.when(F.col("n") < FEW, f"fewer than {FEW} rows").alias("warning"))


def aligned_accuracy(predicted: DataFrame, expected: DataFrame, fields: list[str], predicted_order: list, expected_order: list) -> DataFrame:
    """field_accuracy() of tables that share no key: the first row of one order against the first of the other, and so on, as far
    as the shorter table goes. Tables may be of any length."""
    p, e = positions.ordered_index(predicted, *predicted_order), positions.ordered_index(expected, *expected_order)
    return field_accuracy(p, e, "row_index", fields)


def completeness(products: DataFrame) -> DataFrame:
    """One row: shares with a path, manufacturer and brand, mean number of valued attributes, share to review."""
    share = lambda c: F.coalesce(F.round(F.avg((F.coalesce(strip(c), F.lit("")) != "").cast("int")), 4), F.lit(0.0))
    return products.agg(
        share("classpath").alias("with_classpath"),
        share("manufacturer_name").alias("with_manufacturer"),
        share("brand_name").alias("with_brand"),
        F.coalesce(F.round(F.avg(F.size(F.filter("attributes", lambda a: F.coalesce(strip(a["value"]), F.lit("")) != ""))), 2), F.lit(0.0)).alias("mean_attributes"),
        F.coalesce(F.round(F.avg(F.col("confidence.needs_review").cast("int")), 4), F.lit(0.0)).alias("review_share"),
    )


def full_evaluation(scored: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: batch metrics, pooled grounding, overall accuracy and the share to review."""
    overall = field_accuracy(scored, expected, key, fields).where("field = '(overall)'").select(F.col("accuracy").alias("field_accuracy"))
    pooled = pooled_grounding(scored).select(F.col("rate").alias("pooled_grounding"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(batch_metrics(scored)).join(one(pooled), "_one").join(one(overall), "_one").drop("_one")
    return out.withColumn("review_share", F.coalesce(F.round(F.try_divide("needs_review", "products"), 4), F.lit(0.0)))


def print_report(row: dict, label: str = "evaluation") -> str:
    return "\n".join([f"== {label} ==", *(f"{k:>20}: {v}" for k, v in row.items())])
