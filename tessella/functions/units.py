"""Units, measurements and inch fractions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import let, lookup, strip

_SPELLINGS = refdata.inverted(refdata.UNITS)
_VALUES = refdata.inverted(refdata.VALUES)
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def unit(c: Column | str) -> Column:
    """The approved unit of a spelling, or null."""
    return lookup(F.lower(strip(c)), _SPELLINGS)


def number(c: Column) -> Column:
    return let(strip(c), lambda s: F.when(s.rlike(_NUMBER), s.try_cast("double")))


def measurement(c: Column | str) -> tuple[Column, Column]:
    """(number, unit text): a leading integer or decimal and the rest; a fraction has no number; text without one is all unit."""
    both = let(strip(c), lambda s: F.struct(F.regexp_extract(s, r"^([0-9][0-9./\-]*)", 1).alias("head"), F.nullif(strip(F.regexp_replace(s, r"^[0-9][0-9./\-]*", "")), F.lit("")).alias("rest")))
    return let(both, lambda v: F.when(v["head"].rlike(r"^[0-9]+(\.[0-9]*)?$"), v["head"].try_cast("double"))), both["rest"]


def plain_number(n: Column) -> Column:
    return let(n, lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string")))


def normal_measurement(c: Column | str, compressed: bool = False, upper: bool = False) -> Column:
    """'120 V', or '120V'; null without a number or with an unknown unit."""
    n, rest = measurement(c)
    u = unit(rest)
    u = F.upper(u) if upper else u
    return F.concat(plain_number(n), F.lit("" if compressed else " "), u)


def to_fraction(n: Column, parts: int = 64) -> Column:
    """W, N/D or W-N/D to the nearest of parts (a power of two), reduced; null if negative or not finite."""

    def split(x: Column) -> Column:
        return F.struct(x.alias("x"), F.floor(x).alias("whole"), F.bround((x - F.floor(x)) * parts).cast("int").alias("top"))

    def text(v: Column) -> Column:
        whole = v["whole"] + F.when(v["top"] == parts, 1).otherwise(0)
        top = v["top"] % parts
        divisors = F.lit(1)
        for k in range(1, parts.bit_length()):
            divisors = F.greatest(divisors, F.when(top % (1 << k) == 0, 1 << k).otherwise(1))
        return let(F.struct(whole.alias("whole"), top.alias("top"), divisors.alias("common")), lambda w: _written(w, parts))

    return let(F.when((n >= 0) & (n < 1e15), n), lambda x: F.when(x.isNotNull(), let(split(x), text)))


def _written(w: Column, parts: int) -> Column:
    whole = w["whole"].cast("string")
    fraction = F.concat((w["top"] / w["common"]).cast("int").cast("string"), F.lit("/"), (F.lit(parts) / w["common"]).cast("int").cast("string"))
    return F.when(w["top"] == 0, whole).when(w["whole"] == 0, fraction).otherwise(F.concat(whole, F.lit("-"), fraction))


def from_fraction(c: Column) -> Column:
    """The number of W, N/D or W-N/D; null for other forms and a zero below the line."""

    def one(s: Column) -> Column:
        part = lambda k: F.regexp_extract(s, r"^(?:([0-9]+)-)?([0-9]+)/([0-9]+)$", k).try_cast("double")
        mixed = F.coalesce(part(1), F.lit(0.0)) + F.try_divide(part(2), part(3))
        return F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?$|^\.[0-9]+$"), s.try_cast("double")).when(s.rlike(r"^(?:[0-9]+-)?[0-9]+/[0-9]+$"), mixed)

    return let(strip(c), one)


def controlled_value(label: Column, value: Column) -> Column:
    """Struct (value, matched): labels without a list pass; listed spellings give the canonical value; others stay unmatched."""
    free = ~F.lower(strip(label)).isin(refdata.CONTROLLED_LABELS)
    known = lookup(F.lower(strip(value)), _VALUES)
    found = F.struct(free.alias("free"), known.alias("known"), value.alias("value"))
    return let(found, lambda v: F.struct(F.when(v["free"], v["value"]).otherwise(F.coalesce(v["known"], v["value"])).alias("value"), (v["free"] | v["known"].isNotNull()).alias("matched")))
