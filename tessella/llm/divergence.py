"""How the sources of a language differ in their words: divergences of all pairs, and each source's own terms.

Documents are counted in their partitions, a bounded table of (lang, source, term) at a time, so
a frequent word travels once for each table and not for each document. The terms kept of a
language are dealt by hash into blocks; a block is a dense matrix of its language's sources by
its terms. Numpy broadcasts all pairs of its rows against each other, a bounded tile at a time;
Spark adds up what the blocks give for a pair, and merges the ten best terms that each block
has for a source. Sources beyond what a tile can hold are dealt over further tasks, by rows.

All numbers are integers: shares are worked out by long division in steps of 1000, exact for
fewer than 9e15 occurrences in a group.

Null text, lang and source count as empty strings; a source without terms is compared like any
other, and a language without kept terms has all its pairs at 0. Repeated rows count as often
as they come. Other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common

LEAST_DOCS, TOP, SCALE_STEPS = 10, 10, 3
#: Entries that a task counts before it hands them on; cells of a block's matrix, terms of a block, and rows by columns of a tile.
ENTRIES, CELLS, TERMS, TILE = 300_000, 1 << 22, 2048, 1 << 20
#: Letters in lower case and whatever is beyond ASCII stay; all else parts terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "lang string, source string, part string, item string, value long, rank int"


def term_counts(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """docs(lang, source, text) to (lang, source, term, n, docs): occurrences and documents, summed over
    part of a partition; a row with null term for each source met."""
    schema = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                for k in range(0, len(n) + 1, 50_000):
                    words = [None] * (k == 0) + list(n)[k : k + 50_000]
                    cols = [[lang] * len(words), [source] * len(words), [w and w.decode() for w in words], [n.get(w, 0) for w in words], [docs.get(w, 0) for w in words]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.encode().translate(_TABLE).split()
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) >= entries:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(common.lean(run, 64), schema)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * counts / totals) in integers, by long division."""
    out, rest = counts // totals, counts % totals
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out, rest = out * 1000 + rest // totals, rest % totals
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tile(terms: pa.Table, side: pa.Table, rows: int, tile: int, top: int) -> pa.Table:
    """Of one block of terms: sums of all pairs of sources whose first is in this task's rows, and these rows' best terms."""
    empty = pa.table({n: pa.array([], pa.int64() if n == "value" else pa.string()) for n in ("lang", "part", "source", "item", "value")})
    if not side.num_rows:
        return empty
    (sources,), (sizes,), (kept,), (part,) = (side.column(c).to_pylist() for c in ("sources", "sizes", "kept", "of_part"))
    lang = side.column("of_lang")[0].as_py()
    held = sorted(zip(terms.column("term").to_pylist(), terms.column("cells").to_pylist(), strict=True), key=lambda x: x[0].encode())
    place = {s: k for k, s in enumerate(sources)}
    counts = np.zeros((len(sources), len(held)), np.int64)
    for t, (_, cells) in enumerate(held):
        for cell in cells:
            counts[place[cell["source"]], t] = cell["n"]
    totals = np.array(sizes, np.int64)
    p = shares(counts + 2, (totals + 2 * kept)[:, None])
    q = shares(counts.sum(axis=0) + 2, totals.sum() + 2 * kept)
    first, last = part * rows, min(len(sources), (part + 1) * rows)
    out: list[tuple[str, str, str, int]] = []
    step = max(1, math.isqrt(tile // len(held)))
    for a in range(first, last, step):
        upper = p[a : min(a + step, last)]
        for b in range(a, len(sources), step):
            sums = divergence(upper[:, None, :], p[None, b : b + step, :]).sum(axis=2)
            out += [("pair", sources[a + i], sources[b + j], v) for i, row in enumerate(sums.tolist()) for j, v in enumerate(row) if a + i < b + j]
    for a in range(first, last):
        own = np.flatnonzero((counts[a] > 0) & (p[a] > q))
        f = divergence(p[a][own], q[own])
        out += [("term", sources[a], held[own[k]][0], int(f[k])) for k in np.argsort(-f, kind="stable")[:top]]
    if not out:
        return empty
    cols = list(zip(*out, strict=True))
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "part": pa.array(cols[0], pa.string()), "source": pa.array(cols[1], pa.string()), "item": pa.array(cols[2], pa.string()), "value": pa.array(cols[3], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, entries: int = ENTRIES, cells: int = CELLS, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """RESULT for docs(text, lang, source)."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = term_counts(plain, entries).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = common.materialise(counted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("docs").alias("docs")).where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "cells"))
    kept = held.where("term IS NOT NULL")
    sums = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = held.where("term IS NULL").select("lang", F.inline("cells")).select("lang", "source")
    langs = (
        groups.join(sums, ["lang", "source"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
        .join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
        .select("lang", F.col("all.source").alias("sources"), F.col("all.n").alias("sizes"), F.coalesce("kept", F.lit(0)).alias("kept"))
    )
    langs = common.materialise(langs, tidy=False)
    # Two numbers fix the blocks: how many terms are kept, and how many sources the largest language has.
    most = langs.agg(F.max(F.size("sources"))).first()[0] or 1
    blocks = max(1, -(-kept.count() // min(terms, max(64, cells // most))))
    rows = max(1, min(most, tile // most))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    # A task has these rows of the matrix; what it needs of the others it has too.
    parts = -(-most // rows)
    keys = ["lang", "block", "part"]
    cut = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    sides = dealt.select("lang", "block").distinct().join(langs, "lang").select("lang", "block", cut, "sources", "sizes", "kept").where(F.col("part") * rows < F.size("sources"))
    sides = sides.toDF("of_lang", "of_block", "of_part", "sources", "sizes", "kept")  # names of their own, since both sides come from one table
    left = dealt.select("lang", "block", cut, "term", "cells").groupBy(*keys)
    found = left.cogroup(sides.groupBy("of_lang", "of_block", "of_part")).applyInArrow(lambda terms, side: _tile(terms, side, rows, tile, top), "lang string, part string, source string, item string, value long")
    found = common.materialise(found)
    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = half.select("lang", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))), "value")
    none = langs.where("kept = 0").select("lang", "sources", F.explode("sources").alias("source")).select("lang", "source", F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(none).withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    names = [c.split()[0] for c in RESULT.split(", ")]
    return ranked.select(*names).unionByName(best.select(*names))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS body FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + (CAST(1000000000 AS HUGEINT) * (x.n + 2)) // (s.total + 2 * v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (x.all_n + 2)) // (v.total + 2 * v.v) AS q FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
