"""Attribute candidates, their normal form, and lookups in attribute arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import label_key, let, strip
from tessella.functions.units import controlled_value, number, to_fraction, unit

CANDIDATE = "struct<label:string,candidate_value:string,candidate_uom:string,source:string,source_page:int,confidence:double>"
ATTRIBUTE = "struct<label:string,value:string,uom:string,raw_value:string,source:string,source_page:int,confidence:double,lov_matched:boolean,needs_review:boolean>"


def split_value_unit(c: Column) -> tuple[Column, Column]:
    """A number-like start and a trailing unit of up to six letters; else all is value."""
    text = strip(c)
    rx = r"^\s*([\d.,/\-\s]+?)\s*([A-Za-zµ°%]{1,6})\.?\s*$"
    head = strip(F.regexp_extract(text, rx, 1))
    ok = text.rlike(rx) & head.rlike(r"\d")
    return F.when(ok, head).otherwise(text), F.when(ok, F.regexp_extract(text, rx, 2))


def normalise(candidate: Column) -> Column:
    """One candidate as an attribute: unit, controlled value, inch fraction, and whether a person should look."""
    raw = F.struct(
        F.nullif(strip(candidate["candidate_value"]), F.lit("")).alias("value"),
        F.coalesce(F.nullif(candidate["confidence"], F.lit(0.0)), F.lit(0.5)).alias("confidence"),
        strip(F.coalesce(candidate["label"], F.lit(""))).alias("label"),
        F.nullif(strip(candidate["candidate_uom"]), F.lit("")).alias("unit"),
    )
    none = F.lit(None).cast("string")

    def looked_up(r: Column) -> Column:
        return F.struct(r.alias("r"), unit(r["unit"]).alias("known"), controlled_value(r["label"], r["value"]).alias("listed"))

    def made(v: Column) -> Column:
        r, known, listed = v["r"], v["known"], v["listed"]
        given = r["value"].isNotNull()
        inches = F.when(known == "in", to_fraction(number(listed["value"])))
        review = ~listed["matched"] | (r["confidence"] < refdata.REVIEW_BELOW) | (r["unit"].isNotNull() & known.isNull())
        return F.struct(
            r["label"].alias("label"),
            F.when(given, F.coalesce(inches, listed["value"])).otherwise(none).alias("value"),
            F.when(given, F.coalesce(known, r["unit"])).otherwise(F.nullif(candidate["candidate_uom"], F.lit(""))).alias("uom"),
            r["value"].alias("raw_value"),
            candidate["source"].alias("source"),
            candidate["source_page"].alias("source_page"),
            r["confidence"].alias("confidence"),
            (given & listed["matched"]).alias("lov_matched"),
            (given & review).alias("needs_review"),
        )

    return let(let(raw, looked_up), made)


def normalise_all(candidates: Column) -> Column:
    return F.transform(candidates, normalise)


def from_json(reply: Column) -> Column:
    """Candidates of a JSON list, code fences aside; entries without label or value go, confidence is 0.5 by default."""
    plain = F.regexp_replace(F.regexp_replace(strip(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    parsed = F.from_json(plain, f"array<{CANDIDATE}>")
    kept = F.filter(parsed, lambda a: a["label"].isNotNull() & (a["label"] != "") & a["candidate_value"].isNotNull())
    return F.coalesce(kept, F.array().cast(f"array<{CANDIDATE}>"))


def facts(reply: Column, known: list[str]) -> tuple[Column, Column]:
    """(known facts, others) of a JSON object as maps without nulls; anything else gives empty maps."""
    plain = F.regexp_replace(F.regexp_replace(strip(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    all_ = F.coalesce(F.from_json(plain, "map<string,string>"), F.create_map().cast("map<string,string>"))
    named = F.array(*(F.lit(k) for k in known))
    return F.map_filter(all_, lambda k, v: v.isNotNull() & F.array_contains(named, k)), F.map_filter(all_, lambda k, v: v.isNotNull() & ~F.array_contains(named, k))


def fact_label(name: Column) -> Column:
    """A fact's label: its words in title case, at most 60 characters."""
    parts = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.left(F.array_join(F.transform(parts, F.initcap), ""), F.lit(60))


def known_facts(facts: Column) -> Column:
    """A map of facts without nulls and without what only tells where they come from."""
    return F.map_filter(facts, lambda k, v: v.isNotNull() & ~k.isin("row_id", "source_desc", "extra_attributes"))


def all_facts(facts: Column, extras: Column) -> Column:
    """Known facts and extras in one map; an extra of the same name wins."""
    return F.map_zip_with(known_facts(facts), F.coalesce(extras, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def no_facts(facts: Column, extras: Column) -> Column:
    return (F.size(known_facts(facts)) == 0) & (F.coalesce(F.size(extras), F.lit(0)) <= 0)


def from_description(facts: Column, extras: Column | None = None) -> Column:
    """Candidates from what a description states: named facts in the order and with the labels of FACT_LABELS, then extras by
    their own names. A trailing unit apart, no source, confidence 0.35. The kind of product and its number are no candidates."""

    def one(label: Column, text: Column) -> Column:
        value, uom = split_value_unit(text)
        return F.struct(label.alias("label"), value.alias("candidate_value"), uom.alias("candidate_uom"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("source_page"), F.lit(0.35).alias("confidence"))

    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    named = F.array(*(pair(F.lit(label), F.try_element_at(facts, F.lit(name))) for name, label in refdata.FACT_LABELS.items()))
    if extras is not None:
        more = F.transform(F.map_entries(extras), lambda e: pair(fact_label(e["key"]), e["value"]))
        named = F.concat(named, F.coalesce(more, F.array().cast("array<struct<label:string,value:string>>")))
    said = F.filter(named, lambda e: F.coalesce(F.length(strip(e["value"])) > 0, F.lit(False)))
    return F.transform(said, lambda e: one(e["label"], e["value"]))


def keys(attributes: Column) -> Column:
    """Normal forms of all labels; worth a column of its own where several lookups follow."""
    return F.transform(F.coalesce(attributes, F.array().cast(f"array<{ATTRIBUTE}>")), lambda a: label_key(F.coalesce(a["label"], F.lit(""))))


def position(keys: Column, *labels: str) -> Column:
    """Index of the first attribute with one of the labels, or else of the first whose label holds one of
    them or lies in one; null if there is none. No lambda runs where a label is met exactly."""
    wanted = [" ".join(k.lower().split()) for k in labels]
    exact = F.array_min(F.array(*(F.nullif(F.array_position(keys, F.lit(k)), F.lit(0).cast("long")) for k in wanted)))
    alike = F.transform(keys, lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(k)) | F.contains(F.lit(k), x) for k in wanted)))
    return F.coalesce(exact, F.nullif(F.array_position(alike, F.lit(True)), F.lit(0).cast("long"))).cast("int") - 1


def find(attributes: Column, *labels: str) -> Column:
    """The attribute at position()."""
    return F.get(attributes, let(keys(attributes), lambda k: position(k, *labels)))


def value_of(attributes: Column, *labels: str) -> Column:
    return F.nullif(strip(find(attributes, *labels)["value"]), F.lit(""))


def unit_of(attributes: Column, *labels: str) -> Column:
    return F.nullif(strip(find(attributes, *labels)["uom"]), F.lit(""))


def value_with_unit(attributes: Column, *labels: str) -> Column:
    whole = lambda c: F.nullif(strip(c), F.lit(""))
    pair = let(find(attributes, *labels), lambda a: F.struct(whole(a["value"]).alias("value"), whole(a["uom"]).alias("uom")))
    return let(pair, lambda p: F.when(p["value"].isNotNull(), F.concat_ws(" ", p["value"], p["uom"])))


def status(a: Column) -> Column:
    """What a reader is told about an attribute."""
    source = F.coalesce(a["source"], F.lit(""))
    grounded = F.when(source.rlike("(?i)^https?://"), "grounded").when(source != "", "desc only").otherwise("no source")
    return F.when(a["needs_review"], "needs review").when(a["value"].isNull(), "empty (OK)").otherwise(F.concat(grounded, F.when(a["lov_matched"], " / LOV").otherwise(" / no LOV")))
