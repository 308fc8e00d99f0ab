"""Validation, confidence and triage of a product with attributes and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import let, strip


def unit_known(uom: Column, known: list[str] = refdata.KNOWN_UNITS) -> Column:
    return uom.isNull() | (uom == "") | uom.isin(known)


def grounded(source: Column) -> Column:
    return F.coalesce(F.length(strip(source)) > 0, F.lit(False))


def within_limit(field: str, text: Column) -> Column:
    """True or false where the field has a limit, else null."""
    limit = refdata.LENGTH_LIMITS.get(field)
    return F.lit(None).cast("boolean") if limit is None else F.length(F.coalesce(text, F.lit(""))) <= limit


def _rate(items: Column, good) -> Column:
    return F.when(F.size(items) > 0, F.round(F.size(F.filter(items, good)) / F.size(items), 4)).otherwise(F.lit(1.0))


def _said(text: Column) -> Column:
    return F.when(text.isNull(), "None").otherwise(F.concat(F.lit("'"), text, F.lit("'")))


def report(attributes: Column, descriptions: Column, known: list[str] = refdata.KNOWN_UNITS) -> dict[str, Column]:
    """The three rates, the issues, and those of length, which alone make a product invalid."""
    valued = F.filter(attributes, lambda a: a["value"].isNotNull())
    united = F.filter(attributes, lambda a: a["uom"].isNotNull() & (a["uom"] != ""))
    matched = lambda a: F.coalesce(a["lov_matched"], F.lit(False))
    named = lambda what, a: F.concat(F.lit(f"{what}: attribute '"), F.coalesce(a["label"], F.lit("None")), F.lit("' "))
    lov = F.transform(F.filter(valued, lambda a: ~matched(a)), lambda a: F.concat(named("LOV non-compliance", a), F.lit("value="), _said(a["value"]), F.lit(" not LOV-matched -- needs human review")))
    uom = F.transform(F.filter(united, lambda a: ~unit_known(a["uom"], known)), lambda a: F.concat(named("UOM non-compliance", a), F.lit("uom="), _said(a["uom"]), F.lit(" not in approved UOM set")))
    ground = F.transform(F.filter(valued, lambda a: ~grounded(a["source"])), lambda a: F.concat(named("Ungrounded", a), F.lit("value="), _said(a["value"]), F.lit(" has no source -- needs review")))
    too_long = []
    for field, limit in refdata.LENGTH_LIMITS.items():
        text = F.try_element_at(descriptions, F.lit(field))
        said = _said(text)
        shown = F.when(F.length(said) > 60, F.concat(F.left(said, F.lit(60)), F.lit("..."))).otherwise(said)
        too_long.append(F.when(~within_limit(field, text), F.concat(F.lit(f"Character limit exceeded: {field} is "), F.length(text).cast("string"), F.lit(f" chars (limit={limit}): "), shown)))
    over = F.array_compact(F.array(*too_long))
    return {
        "over": over,
        "lov_rate": _rate(valued, matched),
        "uom_rate": _rate(united, lambda a: unit_known(a["uom"], known)),
        "grounding_rate": _rate(valued, lambda a: grounded(a["source"])),
        "issues": F.concat(lov, uom, ground),
    }


def reasons(attributes: Column, manufacturer: Column, classification: Column, valid: Column, uom_rate: Column, overall: Column, status: Column) -> Column:
    """Why a person should look, each reason once."""
    percent = lambda c, d: F.format_string(f"%.{d}f%%", c * 100)
    unmatched = F.filter(attributes, lambda a: a["value"].isNotNull() & ~F.coalesce(a["lov_matched"], F.lit(False)))
    flagged = F.filter(attributes, lambda a: F.coalesce(a["needs_review"], F.lit(False)))
    loose = F.filter(attributes, lambda a: a["value"].isNotNull() & F.coalesce(a["source"] == "", F.lit(True)))

    def named(items: Column) -> Column:
        first = F.array_join(F.transform(F.slice(items, 1, 3), lambda a: F.concat(F.lit("'"), a["label"], F.lit("'"))), ", ")
        more = F.when(F.size(items) > 3, F.concat(F.lit(" (+"), (F.size(items) - 3).cast("string"), F.lit(" more)"))).otherwise("")
        return F.when(F.size(items) > 0, F.concat(F.size(items).cast("string"), F.lit(" attribute(s) not LOV-matched: "), first, more))

    single = F.array(
        F.when(~valid, "Product failed hard validation checks (e.g. character limit exceeded)"),
        *(F.when(~valid, f"Field '{f}' exceeds allowed character limit") for f in refdata.LENGTH_LIMITS),
        F.when(status == "LOW", F.concat(F.lit("Overall confidence score ("), percent(overall, 2), F.lit(") is LOW (< 60%)"))),
        F.when(manufacturer < refdata.LOW_CONFIDENCE, F.concat(F.lit("Manufacturer match confidence is low ("), percent(manufacturer, 2), F.lit(")"))),
        F.when(classification < refdata.LOW_CONFIDENCE, F.concat(F.lit("Classification confidence is low ("), percent(classification, 2), F.lit(")"))),
        let(unmatched, named),
        F.when(uom_rate < 1, F.concat(F.lit("UOM compliance rate is "), percent(uom_rate, 1), F.lit(" (contains unapproved unit)"))),
        let(loose, lambda x: F.when(F.size(x) > 0, F.concat(F.size(x).cast("string"), F.lit(" attribute(s) lack source grounding")))),
    )
    each = F.transform(flagged, lambda a: F.concat(F.lit("Attribute '"), a["label"], F.lit("' flagged with needs_review=True")))
    return F.array_distinct(F.concat(F.array_compact(single), each))


def scored(df: DataFrame) -> DataFrame:
    """df(attributes, descriptions, manufacturer_confidence, classification_confidence) with validation (valid, three rates,
    issues) and confidence (overall, status, needs_review, reasons).

    Step by step through plain columns: Spark would copy the fields of a struct into each of their uses.
    """
    c, w, attributes = F.col, refdata.WEIGHTS, F.col("attributes")
    out = df.withColumns({f"_v_{k}": v for k, v in report(attributes, c("descriptions")).items()})
    overall = c("manufacturer_confidence") * w["manufacturer"] + c("classification_confidence") * w["classification"] + c("_v_lov_rate") * w["lov"] + c("_v_uom_rate") * w["uom"] + c("_v_grounding_rate") * w["grounding"]
    out = out.withColumns({"_v_overall": F.round(overall, 4), "_v_valid": F.size("_v_over") == 0, "_v_flagged": F.exists(attributes, lambda a: F.coalesce(a["needs_review"], F.lit(False)))})
    out = out.withColumn("_v_status", F.when(c("_v_overall") > refdata.HIGH_ABOVE, "HIGH").when(c("_v_overall") >= refdata.MEDIUM_FROM, "MEDIUM").otherwise("LOW"))
    why = reasons(attributes, c("manufacturer_confidence"), c("classification_confidence"), c("_v_valid"), c("_v_uom_rate"), c("_v_overall"), c("_v_status"))
    validation = F.struct(c("_v_valid").alias("valid"), *(c(f"_v_{k}").alias(k) for k in ("lov_rate", "uom_rate", "grounding_rate")), F.concat("_v_issues", "_v_over").alias("issues"))
    confidence = F.struct(c("_v_overall").alias("overall"), c("_v_status").alias("status"), ((c("_v_status") == "LOW") | ~c("_v_valid") | c("_v_flagged")).alias("needs_review"), why.alias("reasons"))
    return out.select(*df.columns, validation.alias("validation"), confidence.alias("confidence"))
