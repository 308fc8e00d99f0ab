"""Suffix-array dedup: passages that occur elsewhere, found from sparse suffix arrays.

Suffixes are kept only where a text's own content selects them: at the minimiser of each
window of words (see module substring, whose deal this shares). A shard sorts its suffixes by
what follows, compares neighbours, and for every length that neighbours share sorts those
that share it by what precedes, so that each match is extended left as far as any other place
allows. A window is repeated if some match reaches over it on both sides; so none is missed.

Null text has no words; an empty table gives no rows. Repeated rows repeat each other. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, substring

#: Passages of 50 words or more.
SETTINGS = substring.Settings(width=50, anchor=12, shard=120_000)
SCHEMA = "doc_id long, n_words long, n_repeated long, spans array<struct<start:int,end:int>>"


def _order(rows: np.ndarray) -> np.ndarray:
    """Order of rows of symbols, 0 being the end."""
    return np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols rows of a and b share from the left; ends match nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def by_neighbours(held: list[tuple[int, list[bytes]]], weights: np.ndarray, s: substring.Settings) -> list[int]:
    """Masks of the repeated windows of (anchor, words) pieces; one that weighs more than 1 is there twice."""
    single, copies = len(held), np.flatnonzero(weights > 1)
    held = held + [held[k] for k in copies.tolist()]
    ids: dict[bytes, int] = {}
    reach, most, m = s.width, s.width - s.anchor, len(held)
    right, left = np.zeros((m, reach + 1), np.int64), np.zeros((m, max(most, 1)), np.int64)
    at = np.zeros(m, np.int64)
    anchors: dict[int, int] = {}
    for k, (anchor, words) in enumerate(held):
        symbols = [ids.setdefault(w, len(ids) + 1) for w in words]
        at[k] = a = int(np.flatnonzero(common.windows(common.text_hashes(b" ".join(words)), s.anchor).view(np.int64) == anchor)[0])
        right[k, 0] = anchors.setdefault(anchor, len(anchors) + 1)
        behind = symbols[a : a + reach]
        right[k, 1 : 1 + len(behind)] = behind
        before = symbols[max(0, a - most) : a][::-1]
        left[k, : len(before)] = before
    order = _order(right)
    right, left, place = right[order], left[order], at[order]
    ahead = np.concatenate(([0], _same(right[1:], right[:-1]) - 1))  # words shared with the neighbour before
    rank = np.empty(m, np.int64)
    rank[_order(left)] = np.arange(m)
    count = np.array([len(w) for _, w in held], np.int64)[order] - s.width + 1
    masks = np.zeros(m, np.uint64)
    for l in range(most + 1):
        group = np.cumsum(ahead < s.width - l)
        by_left = np.lexsort((rank, group))
        near = np.where(np.diff(group[by_left]) == 0, _same(left[by_left][1:], left[by_left][:-1]), -1)
        best = np.full(m, -1, np.int64)
        best[by_left[1:]] = near
        best[by_left[:-1]] = np.maximum(best[by_left[:-1]], near)
        window = place - l
        good = (best >= l) & (window >= 0) & (window < count)
        masks[good] |= np.uint64(1) << window[good].astype(np.uint64)
    out = np.zeros(m, np.uint64)
    out[order] = masks
    return out[:single].tolist()


def passages(docs: DataFrame, settings: substring.Settings = SETTINGS) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text): spans of words that lie in passages which also occur elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n, total, spans = [], [], []
            for text, *found in zip(batch.column(1).cast(pa.binary()).to_pylist(), substring.lists(batch.column(2)), substring.lists(batch.column(3)), strict=True):
                words = (text or b"").split()
                edge = np.diff(substring.covered(words, found, settings).view(np.int8), prepend=0, append=0)
                both = list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True))
                n.append(len(words))
                total.append(sum(b - a for a, b in both))
                spans.append([{"start": a, "end": b} for a, b in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(spans, span)], names=["doc_id", "n_words", "n_repeated", "spans"])

    rows, found = substring.with_found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), settings, by_neighbours)
    return rows.select("doc_id", "text", *found).mapInArrow(common.lean(run), SCHEMA)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_repeated, and spans as start:end of words, end exclusive, joined by commas."""
    out = passages(common.table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


SQL = r"""
WITH toks AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(list_slice(ws, i, i + 49), ' '))) AS c FROM toks, unnest(range(1, len(ws) - 48)) AS t(i)),
p AS (SELECT DISTINCT r, i + o - 1 AS p FROM w, range(0, 50) AS q(o) WHERE c > 1),
runs AS (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS run FROM p),
s AS (SELECT r, min(p) AS a, max(p) + 1 AS b FROM runs GROUP BY r, run),
g AS (SELECT r, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, coalesce(spans, '') AS spans FROM toks LEFT JOIN g USING (r)
"""
