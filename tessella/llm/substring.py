"""Substring dedup: words in long passages that occur elsewhere are removed.

A window of consecutive words is judged by its own text. Each window names one anchor, the
least of the rolling hashes inside it, so equal windows name equal anchors, and a run of
windows with one anchor is a segment. Only segments whose anchor occurs twice need a look.
They are dealt by anchor, each different segment once with its weight (2 if it occurs more
than once); a shard builds a compressed FM-index of its segments (module fm) and streams them
through it: backward search over the wavelet tree gives matching statistics, and matches as
long as a window whose interval weighs 2 or more are reported.

An anchor with very many different segments is dealt window by window instead: equal windows
are merged, with their weights added up before the shuffle, and the index judges each different
window once. So no shard grows with the number of copies or of surroundings of a passage. All
joins with documents go by a hash of id and text, and what a segment is found to be depends on
its words alone.

Null text has no words; an empty table gives no rows. Repeated rows count as occurrences of each
other, so all their windows go. Other columns are not read, and may have any name. Words are
compared as words in the index; 64-bit hashes name anchors and windows, and anchor and segment
hash together name a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, fm

_HIGH = np.uint64(0xFFFFFFFF00000000)


@dataclass(frozen=True)
class Settings:
    """width: words of a window; anchor: words hashed for an anchor; shard: words in one index;
    wide: different segments of an anchor beyond which its windows are dealt one by one."""

    width: int = 35
    anchor: int = 10
    shard: int = 150_000
    wide: int = 2048


def segments(words: list[bytes] | bytes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, segment hash) of each run of windows with one anchor, in a text or its words."""
    h = common.text_hashes(words if isinstance(words, bytes) else b" ".join(words))
    n = len(h) - s.width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    x = common.windows(h, s.anchor)
    # The least hash in each window and its first place, by doubling; the place is in the low half.
    least, have, want = (x & _HIGH) | np.arange(len(x), dtype=np.uint64), 1, s.width - s.anchor + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = (least & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    up, down = common.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    body = (sums[first + count + s.width - 1] - sums[first]) * down[first]
    return first, count, x[at[first]], common.mix(body + count.astype(np.uint64))


def _anchors(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, anchor, segment) arrays of every row: each segment once, or twice if it occurs again in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, segs = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                _, _, a, g = segments(text or b"", s)
                if len(g) > 1:
                    order = np.argsort(g, kind="stable")
                    same = g[order][1:] == g[order][:-1]
                    third = np.concatenate(([False, False], same[1:] & same[:-1]))
                    order = order[~third]
                    a, g = a[order], g[order]
                anchors.append(a.view(np.int64))
                segs.append(g.view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(anchors, kind), pa.array(segs, kind)], names=["id", "anchor", "segment"])

    return docs.select("id", "text").mapInArrow(common.lean(run), "id long, anchor array<long>, segment array<long>")


_PIECES = "anchor long, piece long, segment long, place int, weight long, words binary"


def _texts(rows: DataFrame, s: Settings, wide: bool) -> DataFrame:
    """rows(id, text, wanted: array of (anchor, segment, weight)): the wanted segments' words, or those of each of their windows.
    Equal rows have equal ids; most of them are passed over here, and what is left of them where pieces are looked up."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
            out = []
            return made

        met: set[int] = set()
        for batch in batches:
            for key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key in met:
                    continue
                if len(met) >= 100_000:
                    met.clear()
                met.add(key)
                words = (text or b"").split()
                want = {w["segment"]: w for w in wanted}
                first, count, _, g = segments(text or b"", s)
                keys = g.view(np.int64)
                for k in np.flatnonzero(np.isin(keys, np.fromiter(want, np.int64, len(want)))).tolist():
                    w = want.pop(int(keys[k]), None)
                    if w is None:
                        continue
                    own = words[first[k] : first[k] + count[k] + s.width - 1]
                    if not wide:
                        out.append((w["anchor"], w["segment"], w["segment"], 0, w["weight"], b" ".join(own)))
                        continue
                    pieces = common.windows(common.text_hashes(b" ".join(own)), s.width).view(np.int64)
                    out += [(w["anchor"], p, w["segment"], o, w["weight"], b" ".join(own[o : o + s.width])) for o, p in enumerate(pieces.tolist())]
                    if len(out) >= 10_000:
                        yield flush()
            if len(out) >= 10_000:
                yield flush()
        yield flush()

    return rows.select("id", "text", "wanted").mapInArrow(common.lean(run, 256), _PIECES)


Lookup = Callable[[list[tuple[int, list[bytes]]], np.ndarray, Settings], list[int]]


def by_index(held: list[tuple[int, list[bytes]]], weights: np.ndarray, s: Settings) -> list[int]:
    """Masks of the repeated windows of (anchor, words) pieces, by an FM-index of them all."""
    ids: dict[bytes, int] = {}
    symbols = [np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int64) for _, words in held]
    return fm.repeated_windows(symbols, weights, s.width)


def _looked_up(rows: DataFrame, s: Settings, lookup: Lookup) -> DataFrame:
    """Shards of rows(anchor, piece, weight, words), sorted by anchor and piece: (anchor, piece, mask) of pieces with repeated windows.
    A piece that comes again, from an equal row, is passed over. All different pieces of an anchor that may hold equal windows
    must be in one shard: s.wide at most, or windows that are all different."""

    def search(held: list[tuple]) -> pa.RecordBatch:
        masks = lookup([(r[0], r[3].split(b" ")) for r in held], np.array([r[2] for r in held], np.int64), s)
        rows = [(r[0], r[1], m) for r, m in zip(held, masks, strict=True) if m]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(3)], names=["anchor", "piece", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, anchor, pieces, before = [], 0, None, 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == before:
                    continue
                before = row
                pieces = pieces + 1 if row[0] == anchor else 1
                if (row[0] != anchor or pieces > s.wide) and words >= s.shard:
                    yield search(held)
                    held, words = [], 0
                anchor = row[0]
                held.append(row)
                words += row[3].count(b" ") + 1 + len(row[3]) // 64
        if held:
            yield search(held)

    return rows.select("anchor", "piece", "weight", "words").mapInArrow(common.lean(run), "anchor long, piece long, mask long")


def repeats(docs: DataFrame, settings: Settings = Settings(), lookup: Lookup = by_index) -> DataFrame:
    """(id, segments, masks): for each id with repeated windows, its segments' hashes and masks. docs has id and text."""
    with common.spent(docs.sparkSession):
        return _repeats(docs, settings, lookup)


def _repeats(docs: DataFrame, s: Settings, lookup: Lookup) -> DataFrame:
    if s.width - s.anchor + 1 > 62:
        raise ValueError("a segment's windows must fit a mask")
    n = common.partitions(docs.sparkSession)
    anchors = common.materialise(_anchors(docs, s))
    each = anchors.select("id", F.explode(F.arrays_zip("anchor", "segment")).alias("r")).select("id", "r.anchor", "r.segment")
    often = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    met = common.materialise(each.join(often, "anchor"))
    common.discard(anchors)
    different = met.groupBy("anchor", "segment").agg(F.least(F.count("*"), F.lit(2)).alias("weight"), F.min("id").alias("id"))
    wide = common.materialise(different.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > s.wide).select("anchor"), tidy=False)
    some = not wide.isEmpty()

    def pieces(rows: DataFrame, windows: bool) -> DataFrame:
        wanted = common.materialise(rows.groupBy("id").agg(F.collect_list(F.struct("anchor", "segment", "weight")).alias("wanted")))
        return _texts(common.split(docs, wanted.select("id"), ["id"])[0].join(wanted, "id"), s, windows)

    whole = pieces(different.join(wide.hint("merge"), "anchor", "left_anti") if some else different, False)
    masks = _looked_up(whole.repartition(n, "anchor").sortWithinPartitions("anchor", "piece"), s, lookup).select("anchor", F.col("piece").alias("segment"), "mask")
    if some:
        cut = common.materialise(pieces(different.join(wide.hint("merge"), "anchor"), True))
        each = cut.groupBy("anchor", "piece", "words").agg(F.sum("weight").alias("weight"))
        found = common.materialise(_looked_up(each.repartition(n, "anchor", "piece").sortWithinPartitions("anchor", "piece"), s, lookup).select("anchor", "piece").distinct(), tidy=False)
        bit = F.expr("shiftleft(1L, place)")
        masks = masks.unionByName(cut.select("anchor", "piece", "segment", bit.alias("mask")).join(found.hint("merge"), ["anchor", "piece"]).groupBy("anchor", "segment").agg(F.bit_or("mask").alias("mask")))
    masks = common.materialise(masks)
    hits = met.join(masks, ["anchor", "segment"]).select("id", "segment", "mask").distinct()
    found = hits.groupBy("id").agg(F.collect_list(F.struct("segment", "mask")).alias("r"))
    return common.materialise(found.select("id", F.col("r.segment").alias("segments"), F.col("r.mask").alias("masks")))


def lists(column: pa.Array) -> list[np.ndarray | None]:
    """The rows of a list column of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends, gone = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    return [None if g else flat[a:b] for a, b, g in zip(ends[:-1].tolist(), ends[1:].tolist(), gone.tolist(), strict=True)]


def covered(words: list[bytes], found: tuple[np.ndarray | None, np.ndarray | None], s: Settings) -> np.ndarray:
    """Which words lie in a repeated window; found: segments and masks of the text's id."""
    n, (keys, masks) = len(words), found
    if keys is None or not len(keys):
        return np.zeros(n, bool)
    first, count, _, g = segments(words, s)
    if not len(g):
        return np.zeros(n, bool)
    order = np.argsort(keys)
    keys, masks = keys[order], masks[order]
    at = np.searchsorted(keys, g.view(np.int64))
    at[at == len(keys)] = 0
    mask = np.where(keys[at] == g.view(np.int64), masks[at], 0)
    window = np.repeat(np.arange(len(first)), count)
    place = np.arange(len(window)) - first[window]
    return common.covered((mask[window] >> place) & 1 == 1, s.width, n)


def with_found(docs: DataFrame, s: Settings, lookup: Lookup = by_index) -> tuple[DataFrame, list[str]]:
    """docs with two more columns for covered(), and their names."""
    key, *names = common.fresh(docs, "_id", "_segments", "_masks")
    text = F.col("text").cast("string")
    by = F.xxhash64(F.col("doc_id").cast("string"), text)
    found = repeats(docs.select(by.alias("id"), text.alias("text")), s, lookup)
    found = found.select(F.col("id").alias(key), *(F.col(c).alias(n) for c, n in zip(("segments", "masks"), names, strict=True)))
    some, rest = common.split(docs.select(*common.columns(docs), by.alias(key)), found.select(key), [key])
    none = rest.select(*common.columns(rest), *(F.lit(None).cast("array<long>").alias(n) for n in names))
    return some.join(found, key, "left").select(*common.columns(none)).unionByName(none).drop(key), names


def removed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs(doc_id, text); kept is the words left, joined by blanks."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, *found in zip(batch.column(1).cast(pa.binary()).to_pylist(), lists(batch.column(2)), lists(batch.column(3)), strict=True):
                words = (text or b"").split()
                out = covered(words, found, s)
                n.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~out).tolist()] if gone[-1] else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    rows, found = with_found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), s)
    return rows.select("doc_id", "text", *found).mapInArrow(common.lean(run), "doc_id long, n_words long, n_removed long, kept binary")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """docs with repeated words taken out of text and n_chars counted anew. A text that loses
    nothing stays as it is, null too; what is left of the others is joined by blanks. All rows
    stay, repeated ones too, and columns are as in docs, whatever their names."""
    s, schema = settings, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = (batch.schema.get_field_index(c) for c in ("text", "n_chars"))
            texts = []
            for text, *found in zip(batch.column(k).to_pylist(), lists(batch.column(batch.num_columns - 2)), lists(batch.column(batch.num_columns - 1)), strict=True):
                if found[0] is None or text is None:
                    texts.append(text)
                    continue
                words = text.encode().split()
                out = covered(words, found, s)
                texts.append(b" ".join([words[i] for i in np.flatnonzero(~out).tolist()]).decode() if out.any() else text)
            cols = list(batch.columns)[:-2]
            cols[k] = pa.array(texts, batch.schema.field(k).type)
            if n >= 0:
                cols[n] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-2])

    rows, found = with_found(docs, s)
    return common.over(rows.select(*common.columns(docs), *found), run, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as strings, counted; at most for small tables.
SQL = r"""
WITH toks AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(list_slice(ws, i, i + 34), ' '))) AS c FROM toks, unnest(range(1, len(ws) - 33)) AS t(i)),
p AS (SELECT DISTINCT r, i + o AS p FROM w, range(0, 35) AS q(o) WHERE c > 1),
g AS (SELECT r, list(p) AS ps FROM p GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(ps, []), k)), ' '), '')) AS kept_sha256
FROM toks LEFT JOIN g USING (r)
"""
