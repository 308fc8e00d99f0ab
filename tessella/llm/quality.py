"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths measure how many characters of a text lie inside
n-grams that the text holds more than once, and how many lie in lines seen before. The
hashing is numpy on the bytes of one text at a time; nothing is shuffled.

Null text counts as no text: no words, so base_failed is true and kept false. Repeated rows
are judged each on its own. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, dup_gram_share array<double>, base_failed boolean, kept boolean"
)

_WS, _SYMBOL, _CONT = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, *range(9, 14)]] = _WS
_CLASS[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
_CLASS[0x80:0xC0] = _CONT


@dataclass(frozen=True)
class Rules:
    """min_words and repeat_percent make the base verdict; grams maps an n-gram length to the
    largest share of characters that may lie in repeated n-grams of it; line_share is the
    same for repeated lines."""

    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    grams: tuple[tuple[int, float], ...] = ((5, 0.45), (8, 0.40), (13, 0.35))
    line_share: float = 0.50


def measure(text: bytes, rules: Rules = Rules()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line share, gram shares)."""
    kind = _CLASS[np.frombuffer(text, np.uint8)]
    char = kind < _CONT
    inside = kind != _WS
    words = text.split()
    n = len(words)
    n_symbols = int(np.count_nonzero(kind == _SYMBOL))
    ends = np.zeros(len(text) + 1, np.int64)
    np.cumsum(char & inside, out=ends[1:])
    word_chars = int(ends[-1])
    if not n:
        return 0, 0, n_symbols, 0, 0, 0.0, [0.0] * len(rules.grams)
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += len(line.decode())
        elif line and not line.isspace():
            seen.add(line)
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    sizes = ends[np.flatnonzero(edge < 0)] - ends[np.flatnonzero(edge > 0)]
    h = common.word_hashes(words)
    at: dict[int, np.ndarray] = {}

    def mask(k: int) -> np.ndarray | None:
        if k not in at:
            flags = common.repeated(common.windows(h, k))
            at[k] = common.covered(flags, k, n) if flags.any() else None
        return at[k]

    base = mask(rules.window)
    shares = []
    for k, _ in rules.grams:
        m = mask(k)
        shares.append(0.0 if m is None else float(sizes[m].sum()) / word_chars)
    return n, word_chars, n_symbols, dup_lines, 0 if base is None else int(base.sum()), dup_chars / int(np.count_nonzero(char)), shares


def verdict(m: tuple, rules: Rules) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    failed = m[0] < rules.min_words or 100 * m[4] > rules.repeat_percent * m[0]
    fine = m[5] <= rules.line_share and all(s <= most for s, (_, most) in zip(m[6], rules.grams, strict=True))
    return failed, fine and not failed


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or b"", rules) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            both = [verdict(m, rules) for m in rows]
            cols = [batch.column(0), *(pa.array([m[k] for m in rows], pa.int64()) for k in range(5)), pa.array([m[5] for m in rows], pa.float64()), pa.array([m[6] for m in rows], pa.list_(pa.float64())), pa.array([b[0] for b in both], pa.bool_()), pa.array([b[1] for b in both], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), SCHEMA)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, rules: Rules = Rules()) -> DataFrame:
    """docs without the rows whose text the rules reject; columns as in docs, whatever their names. Null and
    empty texts are rejected, repeated rows judged each on its own; an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            keep = [verdict(measure(t or b"", rules), rules)[1] for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return common.over(docs, run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents")).drop("dup_line_share", "dup_gram_share")


#: Base counts and the verdict of Rules() in DuckDB.
_GRAM = """
w{k} AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + {k} - 1)) AS c FROM toks, unnest(range(1, len(ws) - {k} + 2)) AS t(i)),
c{k} AS (SELECT r, count(*) AS n, sum(length(ws[p])) AS ch FROM (SELECT DISTINCT w{k}.r, i + o AS p FROM w{k}, range(0, {k}) AS q(o) WHERE c > 1) JOIN toks USING (r) GROUP BY r)"""
SQL = f"""
WITH toks AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM toks) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT r, count(*) AS n, sum(length(line)) AS b FROM lines WHERE k > 1 GROUP BY r),
{",".join(_GRAM.format(k=k) for k in (5, 8, 13))},
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c8.n, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN len(ws) = 0 THEN 0 ELSE coalesce(dup.b, 0) / length(text) END AS line_share,
    coalesce(c5.ch, 0) AS a, coalesce(c8.ch, 0) AS b, coalesce(c13.ch, 0) AS c
  FROM toks LEFT JOIN dup USING (r) LEFT JOIN c5 USING (r) LEFT JOIN c8 USING (r) LEFT JOIN c13 USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR line_share > 0.5 OR a > 0.45 * word_chars OR b > 0.4 * word_chars OR c > 0.35 * word_chars) AS kept
FROM m
"""
