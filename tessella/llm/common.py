"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder


_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def materialise(df: DataFrame, tidy: bool = True) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again; tidy: free the shuffle files of spent plans."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (noted := _written.get()) is not None:
        noted.append(path)
    if tidy:
        # Shuffle files go when the driver's JVM finds their plan unreachable, which may take long by itself.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("t-"):
            _delete(df.sparkSession, folder)


@contextmanager
def spent(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """Deletes at its end what was materialised inside, but for the last keep tables."""
    noted: list[str] = []
    token = _written.set(noted)
    try:
        yield
    finally:
        _written.reset(token)
        for path in noted[: len(noted) - keep]:
            _delete(spark, path)
        if (outer := _written.get()) is not None:
            outer += noted[len(noted) - keep :]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, longer where df has such columns."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def split(df: DataFrame, keys: DataFrame, on: list[str], bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """(rows of df that may have a partner in keys, rows that surely have none), by equal columns, nulls being equal.

    The bitmap has a fixed size, so it can always be broadcast. It spares most rows the shuffle of
    the join that must follow; with very many keys it lets more of them through.
    """
    at, word, held = fresh(df, "_at", "_word", "_set")
    hashed = F.pmod(F.xxhash64(*on), F.lit(bits))
    words = keys.select(hashed.alias(at)).groupBy(F.shiftright(at, 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 63 AS int)))").alias(held))
    marked = df.withColumn(at, hashed).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), word, "left")
    inside = F.coalesce(F.expr(f"getbit({held}, cast({at} & 63 AS int))"), F.lit(0).cast("byte")) == 1
    return marked.where(inside).select(*columns(df)), marked.where(~inside).select(*columns(df))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n; the tables grow as longer texts come."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in ((0, _BASE), (1, _INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit value for each word, the same in every process (see stable_hash)."""
    return np.fromiter(map(stable_hash, words), np.uint64, len(words))


_LANE = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) if k else 0 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LANES = 256


def text_hashes(data: bytes) -> np.ndarray:
    """A 64-bit value for each word of data.split(), the same in every process: eight bytes at a time for all words at once."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64)
    room = np.zeros(n + 8, np.uint8)
    room[:n] = np.frombuffer(data, np.uint8)
    inside = np.zeros(n + 2, bool)
    np.logical_and(room[:n] != 32, room[:n] - np.uint8(9) > 4, out=inside[1:-1])  # the white space of split()
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    eights = np.ndarray((n + 1,), "<u8", buffer=room, strides=(1,))
    out = mix(eights[starts] & _LANE[np.minimum(size, 8)] ^ size.astype(np.uint64) * _U(_BASE))
    longer = np.flatnonzero((size > 8) & (size <= _LANES))
    at = 8
    while len(longer):
        lane = eights[starts[longer] + at] & _LANE[np.minimum(size[longer] - at, 8)]
        out[longer] = mix((out[longer] ^ lane) * _U(0x9FB21C651E98DF25))
        at += 8
        longer = longer[size[longer] > at]
    for k in np.flatnonzero(size > _LANES).tolist():
        out[k] = stable_hash(data[starts[k] : ends[k]])
    return out


class _Memo(dict):
    """Hashes of the words seen, kept while they are few enough to stay in memory."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_memo = _Memo()
stable_hash = _memo.__getitem__


def release() -> None:
    """Give back what a worker process needs no more: it stays, and serves later stages too."""
    _memo.clear()
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(mapper: Mapper, rows: int = 1024) -> Mapper:
    """The mapper over slices of few rows, so that little is held at once; at a task's end its memory is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        finally:
            release()

    return run


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n consecutive values; empty when there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    x = (sums[n:] - sums[:m]) * down[:m]
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that low and high bits are both usable."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def repeated(x: np.ndarray) -> np.ndarray:
    """Which values of x occur at least twice in x."""
    if len(x) < 2:
        return np.zeros(len(x), bool)
    order = np.argsort(x)
    s = x[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return np.zeros(len(x), bool)
    flag = np.zeros(len(x), bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.empty(len(x), bool)
    out[order] = flag
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total positions lie in a window of n that starts where starts is true."""
    step = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(starts)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[:total]) > 0


def over(df: DataFrame, mapper: Mapper, schema: StructType) -> DataFrame:
    """df.mapInArrow() for a mapper that returns df's first columns; names may hold any marks."""
    names = [c if c.isidentifier() else fresh(df, f"_{k}")[0] for k, c in enumerate(df.columns)]
    safe = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema.fields)])
    return df.toDF(*names).mapInArrow(lean(mapper), safe).toDF(*schema.names)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(u, v): one row (u, c) for each vertex, c the smallest vertex reachable.

    Alternating large-star and small-star steps until no edge changes; each is a partial-aggregated
    minimum and a join. The minima are written first, so that the join reads two plain shuffles and
    Spark can split a hub's rows. Nothing is collected but counts. Empty edges give no rows.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = e.count()
    while n:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), tidy=False)
        large = materialise(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), tidy=False)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), tidy=False)
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old, was = e, n
        e = materialise(small.select("e.u", "e.v").where("u <> v").distinct())
        n = e.count()
        settled = n == was and e.join(old.hint("merge"), ["u", "v"], "left_anti").isEmpty()
        for done in (low, large, least, old):
            discard(done)
        if settled:
            break
    stars = e.select("u", F.col("v").alias("c"))
    return stars.unionByName(stars.select(F.col("c").alias("u"), "c").distinct())
