"""Texts about a product from its attributes. A product has manufacturer_name, brand_name, mpn, product_name, fine,
class_name, dept, with_value, attributes and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import clean_number, distinct_ignoring_case, english_list, join_parts, label_key, let, singular, strip, without_marks
from tessella.operators.attributes import keys, position

_A = F.col
MOUNT, CYCLES, VOLT, AMP = ("Mounting Type", "Mounting", "Mount"), ("Number of Wash Cycles", "Wash Cycles"), ("Voltage Rating", "Voltage"), ("Amperage Rating", "Amperage", "Current Rating")
SOUND, DEPTH = ("Sound Level", "Noise Level"), ("Depth With Door Open", "Depth")


#: Attribute lookups that the texts make, by name.
LOOKUPS = {"mount": MOUNT, "cycles": CYCLES, "invoice_cycles": (*CYCLES, "Wash Cycle Count"), "material": ("Material",), "volt": VOLT, "amp": AMP, "depth": DEPTH, "sound": SOUND, "series": ("Series",), "color": ("Color", "Finish"), "size": ("Size",)}


def with_parts(df: DataFrame) -> DataFrame:
    """df and columns _p_*, everything that the texts use, looked up once.

    Labels are normalised once, then each lookup is an index, a value and a unit in columns of
    their own: nothing is copied into the expressions that use it.
    """
    full = lambda c: F.nullif(strip(c), F.lit(""))
    out = df.withColumn("_p_keys", keys(_A("attributes")))
    out = out.withColumns({f"_p_at_{k}": position(_A("_p_keys"), *labels) for k, labels in LOOKUPS.items()})
    out = out.withColumns({f"_p_{what}_{k}": full(F.get("attributes", _A(f"_p_at_{k}"))[field]) for k in LOOKUPS for what, field in (("value", "value"), ("unit", "uom"))})
    value, unit = (lambda k: _A(f"_p_value_{k}")), (lambda k: _A(f"_p_unit_{k}"))
    both = lambda k: F.when(value(k).isNotNull(), F.concat_ws(" ", value(k), unit(k)))
    kind = F.coalesce(full(_A("product_name")), F.nullif(singular(full(_A("fine"))), F.lit("")), full(_A("class_name")), full(_A("dept")))
    parts = {
        "type": kind, "manufacturer": full(_A("manufacturer_name")), "brand": full(_A("brand_name")), "mpn": full(_A("mpn")), "with": full(_A("with_value")),
        "mount": value("mount"), "cycles": clean_number(value("cycles")), "invoice_cycles": clean_number(value("invoice_cycles")), "material": value("material"),
        "volt": value("volt"), "volt_uom": unit("volt"), "amp": value("amp"), "amp_uom": unit("amp"), "depth": value("depth"), "depth_uom": unit("depth"),
        "volts": both("volt"), "amps": both("amp"), "sound": both("sound"), "series": value("series"), "color": value("color"), "size": value("size"),
    }
    return out.withColumns({f"_p_{k}": v for k, v in parts.items()})


class Parts:
    """Columns of with_parts() by their short names; columns, not a struct, as Spark copies a struct's fields into each use."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"_p_{name}")


def material_short(c: Column) -> Column:
    return let(label_key(c), lambda key: reduce(lambda out, kv: out.when(F.contains(key, F.lit(kv[0])), kv[1]), refdata.MATERIAL_SHORT.items(), F.when(F.lit(False), "")).otherwise(F.upper(strip(c))))


def _token(value: Column, uom: Column, default: str) -> Column:
    return F.concat(clean_number(value), F.upper(F.coalesce(uom, F.lit(default))))


def head_tail(head: Column, *tail: Column) -> Column:
    return join_parts(", ", head, *tail)


def _with(head: Column, value: Column) -> Column:
    return join_parts(" ", head, F.concat(F.lit("With "), value))


def invoice(p: Parts) -> Column:
    text = join_parts(" ", F.upper(p["type"]), F.upper(p["mount"]), p["invoice_cycles"], material_short(p["material"]), _token(p["volt"], p["volt_uom"], "V"), _token(p["amp"], p["amp_uom"], "A"), _token(p["depth"], p["depth_uom"], "in"))
    return F.left(text, F.lit(refdata.LENGTH_LIMITS["INVOICE_DESC"]))


def mobile(p: Parts) -> Column:
    return head_tail(join_parts(" ", p["manufacturer"], without_marks(p["brand"])), p["type"], p["series"], p["mpn"])


def short(p: Parts) -> Column:
    return head_tail(_with(join_parts(" ", p["brand"], p["series"], p["mpn"], p["type"]), p["with"]), F.concat(p["mount"], F.lit(" Mounting")), F.concat(p["cycles"], F.lit(" Wash Cycles")), p["material"])


def retail(p: Parts) -> Column:
    return head_tail(join_parts(" ", p["series"], p["type"]), F.concat(p["mount"], F.lit(" Mounting")), F.concat(p["cycles"], F.lit("-Wash Cycle")), p["material"])


def long(p: Parts) -> Column:
    return head_tail(_with(join_parts(" ", p["brand"], p["type"]), p["with"]), p["series"], F.concat(p["cycles"], F.lit(" Wash Cycles")), p["volts"], p["amps"], p["sound"], p["material"])


def _given(features: Column) -> Column:
    return F.filter(F.transform(F.coalesce(features, F.array().cast("array<string>")), strip), lambda f: f != "")


def marketing(p: Parts, features: Column) -> Column:
    own = F.array_compact(F.array(F.concat(F.lit("a quiet "), p["sound"], F.lit(" sound rating")), F.concat(p["cycles"], F.lit(" wash cycles to choose from")), F.concat(p["volts"], F.lit(" operation")), F.concat(F.lit("a "), p["material"], F.lit(" construction"))))
    return let(F.slice(distinct_ignoring_case(F.concat(own, _given(features))), 1, 4), lambda phrases: _sentence(p, phrases))


def _sentence(p: Parts, phrases: Column) -> Column:
    start = F.concat(F.coalesce(p["brand"], F.lit("This")), F.lit(" "), F.coalesce(p["type"], F.lit("product")), F.lit(" offers "), english_list(phrases), F.lit(" for dependable everyday performance"))
    return F.when(F.size(phrases) == 0, "").otherwise(F.concat(start, F.coalesce(F.concat(F.lit(", and comes equipped "), F.lower(p["with"]), F.lit(".")), F.lit("."))))


def bullets(p: Parts, features: Column) -> Column:
    said = lambda what, c: F.concat(F.lit(f"{what}: "), c)
    own = F.array_compact(F.array(said("Sound Level", p["sound"]), F.concat(p["cycles"], F.lit(" Wash Cycles")), said("Voltage", p["volts"]), said("Amperage", p["amps"]), said("Material", p["material"]), said("Color", p["color"]), said("Mounting", p["mount"]), said("Size", p["size"]), F.concat(F.lit("With "), p["with"])))
    return F.slice(distinct_ignoring_case(F.concat(_given(features), own)), 1, 20)


def with_content(df: DataFrame) -> DataFrame:
    """df with descriptions (a map of six texts) and features. Marketing reads the features as they come in."""
    p, f = Parts(), F.col("features")
    texts = {"MOBILE_DESC": mobile(p), "INVOICE_DESC": invoice(p), "SHORT_DESC": short(p), "LONG_DESC1": long(p), "RETAIL_DESC": retail(p), "MARKETING_DESCRIPTION": marketing(p, f)}
    pairs = [x for k, v in texts.items() for x in (F.lit(k), v)]
    parts = with_parts(df)
    return parts.select(*(c for c in df.columns if c != "features"), F.create_map(*pairs).alias("descriptions"), bullets(p, f).alias("features"))
