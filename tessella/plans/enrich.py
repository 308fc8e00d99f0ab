"""The whole row pipeline: a chain of stages, each a DataFrame transform."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators import attributes, catalogue, classify, content, resolve, understanding, validate
from tessella.plans.envelope import Stage

#: Takes and gives a DataFrame; external services stand behind such hooks and are off by default.
Provider = Callable[[DataFrame], DataFrame]


@dataclass
class References:
    """master: (name, code, ordinal) or none; taxonomy: (ordinal, dept, class_name, fine, keywords)."""

    taxonomy: DataFrame
    manufacturers: DataFrame | None = None
    brands: DataFrame | None = None


@dataclass
class Services:
    """What may be asked of services outside; none by default. understand: prompts; choose_name, choose_class: questions with
    options; extract: rows that may get candidates, a column that normalise_all() takes."""

    understand: understanding.Answer | None = None
    choose_name: resolve.Chooser | None = None
    choose_class: resolve.Chooser | None = None
    extract: Provider | None = None


def stages(refs: References, services: Services = Services()) -> list[Stage]:
    """The stages from canonical catalogue rows, which may bring candidates or a model's reply, to scored products."""
    none = F.array().cast(f"array<{attributes.CANDIDATE}>")
    parsed = lambda: F.from_json("reply", f"array<{attributes.CANDIDATE}>")

    def resolved(df: DataFrame) -> DataFrame:
        for column, master, limits in (("best_manufacturer", refs.manufacturers, (0.70, 0.82, True)), ("best_brand", refs.brands, (0.72, 0.85, False))):
            df = resolve.resolve(df, column, master, *limits, services.choose_name) if master is not None else resolve.pass_through(df, column)
        return df

    def classified(df: DataFrame) -> DataFrame:
        df = df.withColumn("search_text", understanding.search_text(F.col("part_desc"), F.col("facts"), F.col("extras")))
        return classify.classify(df, "search_text", refs.taxonomy, services.choose_class)

    def extracted(df: DataFrame) -> DataFrame:
        df = services.extract(df) if services.extract else df
        given = [F.when(F.size(c) > 0, c) for c in ([parsed()] if "reply" in df.columns else []) + ([F.col("candidates")] if "candidates" in df.columns else [])]
        df = df.withColumn("candidates", F.coalesce(*given, attributes.from_description(F.col("facts"), F.col("extras")), none))
        name = lambda c: F.coalesce(F.col(f"{c}_match.name"), F.col(c))
        return df.select(
            *(c for c in df.columns if c not in ("candidates", "reply", "facts", "extras", "search_text", "classification", "best_manufacturer_match", "best_brand_match")),
            name("best_manufacturer").alias("manufacturer_name"), name("best_brand").alias("brand_name"), F.lit(None).cast("string").alias("product_name"), F.lit(None).cast("string").alias("with_value"),
            F.col("classification.dept").alias("dept"), F.col("classification.class_name").alias("class_name"), F.col("classification.fine").alias("fine"), F.col("classification.classpath").alias("classpath"),
            F.coalesce("best_manufacturer_match.confidence", F.lit(0.0)).alias("manufacturer_confidence"), F.col("classification.confidence").alias("classification_confidence"),
            attributes.normalise_all(F.col("candidates")).alias("attributes"), F.array().cast("array<string>").alias("features"),
        )

    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    return [
        Stage("input", catalogue.cleaned, lambda df: F.when(blank("Mfg_Part_Num") & blank("Part_Desc"), "neither part number nor description")),
        Stage("understanding", lambda df: understanding.understood(df, services.understand)),
        Stage("resolution", resolved),
        Stage("classification", classified),
        Stage("extraction", extracted, lambda df: F.when(F.col("reply").isNotNull() & parsed().isNull(), "candidates are not a JSON list") if "reply" in df.columns else F.lit(None)),
        Stage("texts", content.with_content),
        Stage("scores", validate.scored),
    ]


def enrich(rows: DataFrame, refs: References, services: Services = Services()) -> DataFrame:
    """Products from canonical catalogue rows, all of which can be enriched; see run.enrich_safely for others."""
    for stage in stages(refs, services):
        rows = stage.run(rows)
    return rows
