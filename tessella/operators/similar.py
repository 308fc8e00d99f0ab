"""The most similar names of a list for each of many strings, by matching-blocks similarity, without comparing all with all.

Names are laid out by length in bands (each half as long again as the one before), and large
bands in blocks of bounded size. A string goes only to the bands whose lengths can reach the
floor. Where strings and names of a block meet, numpy bounds all their similarities at once by
the letters that they share; then each string takes names in falling order of the bound, works
the exact similarity out, and stops where the bound falls below what it already has. The bound
is never below the similarity, so results are exact. Strings are dealt over as many tasks as
their number asks for, with a copy of the names of a block in each; nothing is broadcast, no
join compares pairs, and no task holds more than a block and its deal.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of a block, strings of a deal, and letters told apart (further ones share a place, which only loosens the bound).
BLOCK, DEAL, LETTERS = 4096, 20_000, 64
#: A band's names are longer than those of the band before by this factor.
_STEP = 1.5


def _band(length: Column) -> Column:
    return F.floor(F.log(_STEP, length + 1)).cast("int")


def profiles(strings: list[str]) -> np.ndarray:
    """Counts of each letter; rows are strings."""
    out = np.zeros((len(strings), LETTERS), np.int32)
    for row, s in zip(out, strings, strict=True):
        row += np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") % LETTERS, minlength=LETTERS).astype(np.int32)
    return out


def _bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shared = np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2)
    total = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :]
    return np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)


def best(strings: list[str], names: list[str], order: list[int], k: int, floor: float) -> Iterator[list[tuple[float, int]]]:
    """For each string its k most similar names of at least floor, as (similarity, place in names), best first; of equals
    the one of least order first. The similarity is SequenceMatcher's, the name being its second sequence."""
    prepared: dict[int, SequenceMatcher] = {}
    rows = max(1, 4_000_000 // (LETTERS * max(1, len(names))))
    target = profiles(names)
    for start in range(0, len(strings), rows):
        some = strings[start : start + rows]
        for s, bound in zip(some, _bounds(profiles(some), target), strict=True):
            found: list[tuple[float, int, int]] = []
            places = np.flatnonzero(bound >= floor)
            for at in places[np.argsort(-bound[places], kind="stable")].tolist():
                if len(found) == k and bound[at] < -found[-1][0]:
                    break
                if at not in prepared:
                    prepared[at] = SequenceMatcher(None, "", names[at])
                matcher = prepared[at]
                matcher.set_seq1(s)
                score = matcher.ratio()
                if score >= floor:
                    found = sorted([*found, (-score, order[at], at)])[:k]
            yield [(-score, at) for score, _, at in found]


def most_similar(values: DataFrame, names: DataFrame, k: int = 1, floor: float = 0.0, block: int = BLOCK, deal: int = DEAL) -> DataFrame:
    """values(raw, a) and names(b, ordinal, ...) to (raw, rank, score, columns of names but b): the k names whose b is most like
    a, of those that reach floor, best first, the earliest ordinal of equals. values are read twice and should be stored.

    Strings and names may be empty, and names may repeat; rows with null a or b take no part, repeated values give their rows
    again but for rank, which counts over them all, so values should be distinct."""
    values = values.select("raw", "a").where("a IS NOT NULL")
    names = names.where("b IS NOT NULL").withColumn("_band", _band(F.length("b")))
    # As many bands as the logarithm of the longest name; their sizes and two counts are all that the driver sees.
    sizes = {r["_band"]: r["n"] for r in names.groupBy("_band").agg(F.count("*").alias("n")).collect()}
    payload = [f for f in names.schema if f.name not in ("b", "_band")]
    schema = T.StructType([T.StructField("raw", T.StringType()), T.StructField("score", T.DoubleType()), *payload])
    result = ["raw", "rank", "score", *(f.name for f in payload)]
    if not sizes:
        return values.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1)).select(*result)
    deals = max(1, -(-values.count() // deal))
    pieces = F.create_map(*(F.lit(x) for b, n in sizes.items() for x in (b, -(-n // block))))
    last = max(sizes)
    reach = floor / (2 - floor)
    length = F.length("a")
    low = _band(F.floor(length * reach).cast("int")) if reach > 0 else F.lit(0)
    high = F.least(_band(F.ceil(length / reach).cast("int")), F.lit(last)) if reach > 0 else F.lit(last)
    sent = values.withColumn("_of", F.explode(F.when(low <= high, F.sequence(low, high)))).where(F.col("_of").isin(*sizes))
    sent = sent.withColumn("_part", F.explode(F.sequence(F.lit(0), F.try_element_at(pieces, F.col("_of")) - 1))).withColumn("_deal", F.pmod(F.xxhash64("raw"), F.lit(deals)))
    held = names.withColumn("_piece", F.pmod(F.xxhash64("b", "ordinal"), F.try_element_at(pieces, F.col("_band")).cast("long"))).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)).cast("array<long>")))
    columns = [f.name for f in payload]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        raws, places, scores = [], [], []
        order = right.column("ordinal").to_pylist()
        for raw, found in zip(left.column("raw").to_pylist(), best(left.column("a").to_pylist(), right.column("b").to_pylist(), order, k, floor), strict=True) if right.num_rows else ():
            for score, at in found:
                raws.append(raw)
                places.append(at)
                scores.append(score)
        picked = right.select(columns).take(pa.array(places, pa.int64()))
        return pa.table([pa.array(raws, pa.string()), pa.array(scores, pa.float64()), *picked.columns], names=["raw", "score", *columns])

    met = sent.groupBy("_of", F.col("_part").cast("long").alias("_part"), "_deal").cogroup(held.groupBy("_band", "_piece", "_copy")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("raw").orderBy(F.desc("score"), "ordinal"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(*result)
