"""The few functions that Spark lacks, over Arrow batches."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIPPED = {"script", "style", "nav", "footer", "header"}


def ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Matching-blocks similarity; 0 where cheap upper bounds already fall below floor."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if 2 * min(len(a), len(b)) < floor * total or 2 * sum((Counter(a) & Counter(b)).values()) < floor * total:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in _SKIPPED

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in _SKIPPED and self.depth > 0

    def handle_data(self, data: str) -> None:
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def page_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return " ".join(p.parts)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(page_text)


@F.pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """A capital after anything that is no letter."""
    return s.map(lambda x: None if x is None else x.title())


def register(spark: SparkSession) -> None:
    """The three as SQL functions."""
    spark.udf.register("similarity", similarity)
    spark.udf.register("html_text", html_text)
    spark.udf.register("title_case", title_case)
