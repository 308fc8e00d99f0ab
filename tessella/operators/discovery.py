"""Where evidence may be found: queries, source lists, blocked sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import refdata
from tessella.functions.text import strip


def search_queries(mpn: Column, manufacturer: Column, desc: Column, fine: Column) -> Column:
    """Up to nine queries, the most specific first, each once."""
    mpn, manufacturer, desc = (F.coalesce(strip(c), F.lit("")) for c in (mpn, manufacturer, desc))
    fine = F.coalesce(fine, F.lit(""))
    has = lambda *cs: F.array_position(F.array(*(c != "" for c in cs)), False) == 0
    both = [F.when(has(mpn, manufacturer), F.concat(manufacturer, F.lit(" "), mpn, F.lit(f" {what}"))) for what in ("specifications", "datasheet", "installation manual", "technical data")]
    own = [F.when(has(mpn), F.concat(mpn, F.lit(f" {what}"))) for what in ("specifications", "datasheet")]
    rest = [F.when(has(mpn, fine), F.concat(mpn, F.lit(" "), fine)), F.when(has(manufacturer, fine), F.concat(manufacturer, F.lit(" "), fine, F.lit(" specifications"))), F.when(has(desc), desc)]
    return F.array_distinct(F.array_compact(F.array(*both, *own, *rest)))


def blocked(url: Column) -> Column:
    """Whether any blocked name is part of the address."""
    return F.lower(url).rlike("|".join(refdata.BLOCKED_SITES))


def parse_source_lines(reply: Column) -> Column:
    """Array of (url, document_type) from lines 'address | type', list marks aside; unknown types are product pages."""
    lines = F.transform(F.split(reply, r"\r?\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[-*•\d.]+\s*", "")))
    known = list(refdata.DOCUMENT_TYPES)

    def parsed(x: Column) -> Column:
        kind = F.replace(F.lower(strip(F.substring_index(F.regexp_replace(x, r"^[^|]*\|", ""), "\u0000", 1))), F.lit(" "), F.lit("_"))
        return F.struct(strip(F.substring_index(x, "|", 1)).alias("url"), F.when(F.contains(x, F.lit("|")) & kind.isin(known), kind).otherwise("product_page").alias("document_type"))

    return F.filter(F.transform(lines, parsed), lambda s: F.startswith(s["url"], F.lit("http")))


def document_label(kind: Column) -> Column:
    from tessella.functions.text import lookup

    return F.coalesce(lookup(kind, refdata.DOCUMENT_TYPES), F.nullif(F.replace(kind, F.lit("_"), F.lit(" ")), F.lit("")), F.lit("Source"))
