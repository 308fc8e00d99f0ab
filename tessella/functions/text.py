"""String expressions: cleaning, normalising, tokens, templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import refdata


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def clean(c: Column | str, placeholders: list[str] = refdata.PLACEHOLDERS) -> Column:
    """Stripped, or null for what stands in place of a value."""
    return let(strip(c), lambda s: F.when(~F.lower(s).isin(placeholders), s))


def entity_key(c: Column | str) -> Column:
    """Lower case, only letters, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), r"\s+", " "))


def label_key(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def expand_abbreviations(c: Column | str) -> Column:
    def pattern(short: str) -> str:
        if short.endswith("#"):
            return rf"(?i)(?<![0-9]){short}"
        return r"(?i)\b" + r"\s*".join(map(re.escape, short.split())) + r"\b"

    return reduce(lambda out, pair: F.regexp_replace(out, pattern(pair[0]), pair[1]), refdata.ABBREVIATIONS, F.col(c) if isinstance(c, str) else c)


def tokens(c: Column | str) -> Column:
    """Words of letters, digits and underscores in any script, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), F.lit(1))


def words(c: Column | str) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def chunks(c: Column | str, size: int = refdata.CHUNK_WORDS, step: int = refdata.CHUNK_STEP) -> Column:
    """Array of runs of size words, one every step words; a short tail stays. Empty for no words."""
    w = words(c)
    starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))
    return F.when(F.size(w) > 0, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def join_parts(sep: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *(F.nullif(p, F.lit("")) for p in parts))


def singular(c: Column | str) -> Column:
    def one(plain: Column) -> Column:
        low = F.lower(plain)
        cut = low.endswith("s") & ~low.endswith("ss") & ~low.endswith("us") & (F.length(plain) > 3)
        return F.coalesce(lookup(low, refdata.IRREGULAR_SINGULARS), F.when(cut, F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain))

    return let(strip(c), one)


def clean_number(c: Column | str) -> Column:
    """5.0 becomes 5; what is no whole number stays."""

    def one(x: Column) -> Column:
        n = F.when(x.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), strip(x).try_cast("double"))
        return let(F.struct(x.alias("x"), n.alias("n")), lambda v: F.when(v["n"].isNotNull() & (v["n"] == F.floor(v["n"])) & (F.abs(v["n"]) < 1e15), v["n"].cast("bigint").cast("string")).otherwise(v["x"]))

    return let(F.col(c) if isinstance(c, str) else c, one)


def without_marks(c: Column | str) -> Column:
    return strip(F.translate(c, "®™©", ""))


def snippet(c: Column | str, size: int = 400) -> Column:
    return F.left(c, F.lit(size))


def display_snippet(c: Column | str, size: int = 320) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("…"))).otherwise(F.col(c) if isinstance(c, str) else c)


def highlight(c: Column, terms: list[str]) -> Column:
    """Terms of two letters or more wrapped in marks, longest first, without regard to case."""
    use = sorted({t for t in terms if len(t) > 1}, key=lambda t: (-len(t), t))
    return F.regexp_replace(c, "(?i)(" + "|".join(map(re.escape, use)) + ")", "<mark>$1</mark>") if use else c


def short_url(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^https?://", ""), "/$", "")


def percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f%%", c * 100))


def english_list(items: Column) -> Column:
    """a; a, and b; a, b, and c."""

    def one(x: Column) -> Column:
        n = F.size(x)
        return F.when(n == 0, "").when(n == 1, F.get(x, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(x, F.lit(1), n - 1), ", "), F.lit(", and "), F.try_element_at(x, F.lit(-1))))

    return let(items, one)


def distinct_ignoring_case(items: Column) -> Column:
    """The first of those equal without regard to case, in order."""
    none = F.array().cast("array<string>")
    return F.aggregate(items, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """A literal map's value, or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)
