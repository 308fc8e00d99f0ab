"""Answers of a text model, checked against what may be answered; lookups by key, path and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import strip
from tessella.operators import resolve
from tessella.operators.positions import row_index  # noqa: F401

#: Confidence of a model's choice of a name, and of a class.
NAME_CONFIDENCE, CLASS_CONFIDENCE = resolve.CHOSEN, 0.82
Chooser = resolve.Chooser
options = resolve.options


def chosen(asked: DataFrame, choose: Chooser | None, confidence: float = NAME_CONFIDENCE) -> DataFrame:
    """asked(id, options) to (id, name, confidence, method): the option that the answer names, but for case
    and blanks around it. An answer that is no option is worth nothing, as is no answer."""
    none = asked.select("id", F.lit(None).cast("string").alias("answer"))
    answers = resolve.first_answers(choose(asked) if choose else none)
    both = asked.join(answers, "id", "left")
    said = F.lower(strip("answer"))
    name = F.get(F.filter("options", lambda o: F.lower(o) == said), F.lit(0))
    return both.select("id", name.alias("name")).select("id", "name", F.when(F.col("name").isNotNull(), F.lit(confidence)).otherwise(0.0).alias("confidence"), F.when(F.col("name").isNotNull(), "llm").otherwise("unresolved").alias("method"))


def brand_or_null(c: str):
    """A brand, or null for what stands in place of one."""
    return F.when(~F.lower(strip(c)).isin(refdata.BRAND_PLACEHOLDERS), strip(c))


def best_of(df: DataFrame, columns: list[str], master: DataFrame, reject: float = 0.72, review: float = 0.85, choose: Chooser | None = None) -> DataFrame:
    """df and best_match: what the first of the columns that resolves gives, or else unresolved."""
    out = df
    for c in columns:
        out = resolve.resolve(out.withColumn(c, brand_or_null(c)), c, master, reject, review, False, choose)
    hits = [F.when(F.col(f"{c}_match.name").isNotNull(), F.col(f"{c}_match")) for c in columns]
    return out.withColumn("best_match", F.coalesce(*hits, F.col(f"{columns[0]}_match"))).drop(*(f"{c}_match" for c in columns))


def distinct_names(master: DataFrame) -> DataFrame:
    """master(name, code, ordinal) without blank names; of equal names the first stays."""
    named = master.withColumn("name", F.trim("name")).where("name <> ''")
    return named.groupBy("name").agg(F.min_by("code", "ordinal").alias("code"), F.min("ordinal").alias("ordinal"))


def by_path(paths: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """paths(path, ...) and the taxonomy entry of exactly this path, the first of equals; null columns where there is none."""
    entry = F.struct("ordinal", "dept", "class_name", "fine", "keywords")
    known = taxonomy.groupBy(F.concat_ws(">", "dept", "class_name", "fine").alias("path")).agg(F.min_by(entry, "ordinal").alias("entry"))
    return paths.join(known, "path", "left")


def point(df: DataFrame, key: str, value, order: str) -> DataFrame:
    """The first row of a key, by order."""
    return df.where(F.col(key) == F.lit(value)).orderBy(order).limit(1)
