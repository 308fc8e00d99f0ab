"""Nearest neighbours by score-aware anisotropic product quantisation.

Vectors are scaled to length one, so that the largest inner product is the largest cosine,
and cut into short sub-vectors with 16 centres each. Centres and codes minimise a loss that
weighs the part of the residual along the vector more than the part across it, as only the
former moves the inner products that matter. Two 4-bit codes make a byte; a query's table of
partial scores is added up byte by byte for all rows, and the best of each block of rows are
ranked again by the exact measure on the original vectors. The k-th of these scores is then a
floor: the angle between a row and its code, and the rounding of the table, bound the row's
true cosine from above, and every row whose bound reaches the floor is ranked exactly too. So
no neighbour is lost to the codes, however many rows share theirs.

The codebook and the cells' centres are fitted on a bounded sample (Settings.sample rows, by hash
order of vec_id); every row is coded and scanned. A row goes once, to the cell of its nearest
centre; large cells are split into blocks of bounded size, each coded in the one task that holds
it. A query's exact cosines to the sample give it a floor that its k-th neighbour can't lie
below, and the angle to a cell's centre less the cell's widest angle bounds what the cell can
hold; the query goes only to cells whose bound reaches its floor. So where vectors are
clustered, as embeddings are, it meets few cells; where they are not, it meets all, and a block
holds as many rows as memory allows so that this costs few copies of a query. What blocks find
is merged by a ranking that each task begins with its own. Nothing goes through the driver but
the sample, and the size and widest angle of each cell.

Vectors that are null, zero, or hold a null or non-finite component take no part. A repeated
row is a candidate of its copies; a query's own row is left out once. Ties go to the smaller
vec_id, a null vec_id last. Vectors of another length than the query's are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common

#: More than rounding can move a bound by: the root of 1 - c * c is off by up to 1e-7 near 1.
SLACK = 1e-6
FOUND = "query_id long, query_row long, vec_id long, score double, own boolean"


@dataclass(frozen=True)
class Settings:
    """k: neighbours; sample: rows that the codebook is fitted on; width: components of a
    sub-vector; threshold: cosine above which scores matter, which sets the loss's weight;
    rerank: rows of each block that are ranked exactly at first, to find the floor that the other
    rows' bounds must reach; block, least: rows in a block at most, and those that a block should
    have before rows are dealt to more tasks; cells: centres at most."""

    k: int = 5
    sample: int = 4096
    width: int = 2
    threshold: float = 0.2
    rounds: int = 6
    rerank: int = 128
    block: int = 131_072
    least: int = 4096
    cells: int = 256


@dataclass(frozen=True)
class Codebook:
    centres: np.ndarray  # (subs, 16, width)
    weight: float  # extra weight of the squared parallel residual
    dims: int

    def _split(self, x: np.ndarray) -> np.ndarray:
        subs, _, width = self.centres.shape
        out = np.zeros((len(x), subs * width))
        out[:, : self.dims] = x
        return out.reshape(len(x), subs, width)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(rows, subs) of 0..15 for unit rows x: nearest centres first, then coordinate descent on the loss."""
        parts = self._split(x)
        subs = parts.shape[1]
        codes = np.empty((len(x), subs), np.uint8)
        along = np.empty((len(x), subs))
        for s in range(subs):
            gap = parts[:, s, None, :] - self.centres[s][None]
            codes[:, s] = np.einsum("nck,nck->nc", gap, gap).argmin(1)
            along[:, s] = np.einsum("nk,nk->n", gap[np.arange(len(x)), codes[:, s]], parts[:, s])
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(subs):
                gap = parts[:, s, None, :] - self.centres[s][None]
                par = np.einsum("nck,nk->nc", gap, parts[:, s])
                rest = total - along[:, s]
                loss = np.einsum("nck,nck->nc", gap, gap) + self.weight * (rest[:, None] + par) ** 2
                codes[:, s] = loss.argmin(1)
                along[:, s] = par[np.arange(len(x)), codes[:, s]]
                total = rest + along[:, s]
        return codes

    def bounds(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For unit rows x and what their codes stand for: the latter's length, and the cosine and sine of the angle between."""
        back = self.centres[np.arange(len(self.centres)), codes[:, : len(self.centres)]]
        length = np.sqrt((back * back).sum((1, 2)))
        scale = np.divide(1, length, out=np.zeros_like(length), where=length > 1e-9)
        cos = np.clip((back * self._split(x)).sum((1, 2)) * scale, -1, 1)
        return length * (scale > 0), cos, np.sqrt(1 - cos * cos)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, bytes, 256) partial scores as unsigned bytes' range integers, two codes to a byte;
        what a step is worth, and the largest score that a sum of no steps can stand for."""
        dots = np.einsum("qsk,sck->qsc", self._split(q), self.centres)
        if dots.shape[1] % 2:
            dots = np.concatenate([dots, np.zeros_like(dots[:, :1])], 1)
        low = dots.min(2, keepdims=True)
        scale = np.maximum((dots - low).max((1, 2), keepdims=True), 1e-12)
        steps = np.rint((dots - low) * (255 / scale)).astype(np.uint16)
        step = scale[:, 0, 0] / 255
        return (steps[:, 1::2, :, None] + steps[:, 0::2, None, :]).reshape(len(q), -1, 256), step, low.sum((1, 2)) + len(self.centres) * step / 2


def fit(x: np.ndarray, settings: Settings = Settings()) -> Codebook:
    """A codebook for unit rows x, by alternating codes and centres under the anisotropic loss."""
    dims, width = x.shape[1], settings.width
    subs = -(-dims // width)
    t = settings.threshold**2
    weight = max(0.0, t / (1 - t) * (dims - 1) - 1)
    rnd = np.random.default_rng(7)
    book = Codebook(np.zeros((subs, 16, width)), weight, dims)
    parts = book._split(x)
    pick = rnd.choice(len(x), 16, replace=len(x) < 16)
    book.centres[:] = parts[pick].transpose(1, 0, 2) + rnd.normal(0, 1e-4, (subs, 16, width))
    for turn in range(settings.rounds):
        codes = book.codes(x, sweeps=0 if turn < 2 else 1)
        gap = np.stack([parts[:, s] - book.centres[s][codes[:, s]] for s in range(subs)], 1)
        along = np.einsum("nsk,nsk->ns", gap, parts)
        total = along.sum(1)
        for s in range(subs):
            rest = total - along[:, s]
            for c in range(16):
                own = codes[:, s] == c
                if not own.any():
                    book.centres[s, c] = parts[rnd.integers(len(x)), s]
                    continue
                p = parts[own, s]
                left = len(p) * np.eye(width) + weight * p.T @ p
                right = (p + weight * (rest[own] + (p * p).sum(1))[:, None] * p).sum(0)
                book.centres[s, c] = np.linalg.solve(left, right)
            now = np.einsum("nk,nk->n", parts[:, s] - book.centres[s][codes[:, s]], parts[:, s])
            total, along[:, s] = rest + now, now
    return book


@dataclass(frozen=True)
class Cells:
    """Unit centres, and the sample in units, both of bounded size."""

    centres: np.ndarray
    sample: np.ndarray

    def nearest(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the cosine of its angle to the centre."""
        dots = units @ self.centres.T
        cell = dots.argmax(1)
        return cell, dots[np.arange(len(units)), cell]

    def reached(self, units: np.ndarray, narrowest: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query the cells that may hold one of its k nearest. narrowest: of each cell the least cosine of a row to its centre."""
        if len(self.sample) > k:
            dots = units @ self.sample.T
            floor = np.partition(dots, -k - 1, axis=1)[:, -k - 1] - SLACK  # the query's own row may be one of them
        else:
            floor = np.full(len(units), -2.0)
        angle = np.arccos(np.clip(units @ self.centres.T, -1, 1)) - np.arccos(np.clip(narrowest, -1, 1))[None, :]
        bound = np.cos(np.clip(angle, 0, np.pi)) + SLACK
        return [np.flatnonzero(row >= f) for row, f in zip(bound, floor, strict=True)]


def cells(units: np.ndarray, n: int, rounds: int = 8) -> Cells:
    """n centres at most, by alternating nearest centres and means of directions."""
    rnd = np.random.default_rng(11)
    centres = units[rnd.choice(len(units), min(n, len(units)), replace=False)]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return Cells(centres, units)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(v.isNotNull() & fine & F.exists(v, lambda c: c != 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    y = _scaled(x)
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def _cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The exact measure for rows and a query that _scaled() gave, each row alike wherever it stands."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


class Block:
    """Rows of one length, coded, in order of their ids."""

    def __init__(self, book: Codebook, ids: list[int | None], x: np.ndarray, settings: Settings) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.book, self.settings = book, settings
        self.ids, self.x = [ids[i] for i in order], x[order]
        made = []
        for k in range(0, len(ids), 4096):
            units = _units(self.x[k : k + 4096])
            codes = book.codes(units)
            made.append((codes, *book.bounds(units, codes)))
        codes, self.length, self.cos, self.sin = (np.concatenate(m) for m in zip(*made, strict=True))
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
        self.packed = (codes[:, 0::2] | codes[:, 1::2] << 4).T.copy()

    def search(self, queries: list[tuple[int, int]], q: np.ndarray) -> list[tuple]:
        """(query id, query row, id, score, own) of the k + 1 nearest of this block for each query."""
        ids, k, out = self.ids, self.settings.k, []
        keep, place = min(len(ids), self.settings.rerank), np.arange(len(ids), dtype=np.int64)
        for (query_id, row), own, vector, table, step, least in zip(queries, q, _scaled(q), *self.book.tables(_units(q)), strict=True):
            score = np.zeros(len(ids), np.int32)
            for byte, code in zip(table.astype(np.int32), self.packed, strict=True):
                score += byte[code]
            best = np.argpartition(place - (score.astype(np.int64) << 32), keep - 1)[:keep]
            if keep < len(ids):
                floor = np.sort(_cosines(_scaled(self.x[best]), vector))[-k - 1] - SLACK if keep > k else -1.0
                # The angle of query to code is at most that of query to row and that of row to code together.
                need = np.where(self.cos > -floor, floor * self.cos - np.sqrt(max(0.0, 1 - floor * floor)) * self.sin, -1) * self.length - SLACK
                best = np.flatnonzero(score * step + least >= need)
            best = np.sort(best)
            exact = _cosines(_scaled(self.x[best]), vector)
            for j in np.lexsort((best, -exact))[: k + 1]:
                i = int(best[j])
                out.append((query_id, row, ids[i], float(exact[j]), ids[i] == query_id and bool((self.x[i] == own).all())))
        return out


def search(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The settings.k nearest rows of vectors for each row of queries; both have (vec_id, embedding).

    (query_id, rank, vec_id, score). queries is assumed to be some rows of vectors. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows, asked = valid(vectors).withColumn("dims", F.size("v")), valid(queries)
    asked = asked.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("dims", F.size("v")).withColumn("row", F.xxhash64("v"))
    sizes = {r.dims: r["count"] for r in rows.groupBy("dims").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books, laid = {}, {}
    for dims, n in sizes.items():
        sample = rows.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).collect()
        units = _units(np.array([r.v for r in sample]))
        books[dims], laid[dims] = fit(units, settings), cells(units, max(1, min(settings.cells, len(units) // 16, n // settings.least)))

    def by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(dims, places in the batch, unit rows) of a batch that ends in dims and v."""
        dims = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            yield d, at, _units(batch.column(batch.num_columns - 1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, cos = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d, at, units in by_dims(batch):
                cell[at], cos[at] = laid[d].nearest(units)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cos)], names=["vec_id", "dims", "v", "cell", "cos"])

    homes = common.materialise(rows.select("vec_id", "dims", "v").mapInArrow(common.lean(placed), "vec_id long, dims int, v array<double>, cell int, cos double"))
    most = {d: min(settings.block, max(settings.least, -(-n // common.partitions(spark)))) for d, n in sizes.items()}
    narrowest = {d: np.ones(len(c.centres)) for d, c in laid.items()}
    pieces: dict[int, dict[int, int]] = {d: {} for d in sizes}
    for r in homes.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.min("cos").alias("cos")).collect():
        narrowest[r.dims][r.cell], pieces[r.dims][r.cell] = r.cos, -(-r.n // most[r.dims])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, each with the blocks that it goes to: cell << 32 | piece."""
        for batch in batches:
            to: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for d, at, units in by_dims(batch):
                for k, reached in zip(at.tolist(), laid[d].reached(units, narrowest[d], settings.k), strict=True):
                    to[k] = [c << 32 | p for c in reached.tolist() for p in range(pieces[d].get(c, 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int64()))], names=["vec_id", "row", "dims", "v", "to"])

    columns = [c.split()[0] for c in FOUND.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by dims, block and asked: each block's rows, and then the queries."""
        key, ids, parts, block = None, [], [], None
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            ends = [k for k in range(1, len(at)) if at[k] != at[k - 1]] + [len(at)]
            start = 0
            for end in ends:
                piece, (*own, asks) = batch.slice(start, end - start), at[start]
                x = piece.column(5).flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1)
                if own != key:
                    key, ids, parts, block = own, [], [], None
                if not asks:
                    ids += piece.column(3).to_pylist()
                    parts.append(x)
                elif ids:
                    block = block or Block(books[own[0]], ids, np.concatenate(parts), settings)
                    hits = block.search(list(zip(piece.column(3).to_pylist(), piece.column(4).to_pylist(), strict=True)), x)
                    yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)], names=columns)
                start = end

    count = F.create_map(*(F.lit(x) for d, own in pieces.items() for c, n in own.items() for x in (f"{d}:{c}", n)))[F.concat_ws(":", "dims", "cell")]
    each = homes.select("dims", (F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("vec_id", "v"), count)).alias("block"), F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("long").alias("row"), "v")
    known = asked.where(F.col("dims").isin(*sizes)).select("vec_id", "row", "dims", "v")
    sent = known.mapInArrow(common.lean(routed), "vec_id long, row long, dims int, v array<double>, to array<long>")
    streamed = sent.select("dims", F.explode("to").alias("block"), F.lit(True).alias("asks"), "vec_id", "row", "v")
    dealt = each.unionByName(streamed).repartition(common.partitions(spark), "dims", "block").sortWithinPartitions("dims", "block", "asks")
    found = dealt.mapInArrow(common.lean(run, 256), FOUND)
    query = ("query_id", "query_row")
    order = (F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    # The own row is the first of those equal to the query in id and vector; it goes, and k others stay.
    marked = found.withColumn("own", F.col("own") & (F.row_number().over(Window.partitionBy(*query, "own").orderBy(*order)) == 1))
    ranked = marked.where("NOT own").withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order))).where(F.col("rank") <= settings.k)
    copies = asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "copies")
    return ranked.join(copies, list(query)).select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


