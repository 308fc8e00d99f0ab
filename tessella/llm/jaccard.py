"""N-gram Jaccard join with signature trees, and the components of its links.

Every link is found. Documents with equal shingle sets are one class from the start. Tokens
have one order, that of their hashes, and classes meet where they share a token of their
prefixes in this order: two linked sets share at least Settings.common(n) of them, n being
the size of the smaller. How many classes hold a token is counted by a partial aggregation
of prefix tokens, so what is known of a token does not blur as the corpus grows. Tokens of more
than Settings.often classes are hot. A class that has fewer hot tokens than it must share goes
without them, as some other token is then shared; so hot tokens bring only those classes
together that consist of them to a large part. Two rounds follow.

1. Classes that meet others in enough tokens are dealt by the least class they meet, a bounded
   number at a time; a signature tree over each lot (nodes hold the OR of token bitmaps, and
   the range of set sizes) is traversed against itself. Node pairs whose greatest possible
   overlap is too small are cut off, as are those that are linked already; what is left is
   compared exactly. Large lots are dealt in parts, and some sets of each group that the parts
   have found go on to a lot of such sets. This joins most copies, and need not be complete.
2. Within each prefix token's group the same traversal runs over the members that round 1
   left apart. Groups beyond a bound are cut into blocks; members of the group's main label
   meet only the others. Pairs that the trees can't rule out, and that met in as many tokens as
   linked sets must share, are compared exactly.

Connected components of the links give the result. Sets, bitmaps, counts and links stay in
the cluster; nothing is collected or broadcast but bitmaps of fixed size.

Null or wordless text has an empty set and is linked with nothing: its component is its own
doc_id. Repeated rows are one class. A null doc_id takes part, and is the component's id only
if no other id is there. Other columns are not read, and an empty table gives no rows. Tokens are 64-bit hashes of shingles, and
a class is known by a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = 2048
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """Shingles of words; links at percent; often: classes beyond which a token is hot; lot, part and
    block bound what a task holds at once in rounds 1 and 2, carried what a lot keeps from one
    filling to the next, and heads how many of a group's sets go on from a part to the next level; leaf is the size of a tree's leaves."""

    words: int = 4
    percent: int = 85
    often: int = 64
    lot: int = 384
    part: int = 4096
    heads: int = 16
    carried: int = 64
    block: int = 1024
    leaf: int = 32

    def least(self, n: int) -> int:
        """Tokens of a set of n that any linked set has too; so also the least size of a linked set."""
        return (self.percent * n + 99) // 100

    def common(self, n: int) -> int:
        """Prefix tokens that two linked sets share, n being the smaller size."""
        return max(1, min(4 + n // 16, self.least(n)))

    def prefix(self, n: int) -> int:
        """Tokens of a set's prefix. Behind the k-th token that linked sets share, at least
        least(n) - k others of these follow, so the first common(n) are all in the prefix."""
        return n - self.least(n) + self.common(n)

    def least_sql(self, n: str) -> str:
        return f"(({self.percent} * ({n}) + 99) DIV 100)"

    def common_sql(self, n: str) -> str:
        return f"greatest(1, least(4 + ({n}) DIV 16, {self.least_sql(n)}))"


def occurrences(text: bytes, words: int = 4) -> np.ndarray:
    """64-bit tokens, one for each shingle; the whole sequence is one if it is shorter."""
    w = text.translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    return common.windows(common.word_hashes(w), min(words, len(w)))


def shingles(text: bytes, words: int = 4) -> np.ndarray:
    """Sorted distinct tokens."""
    return np.unique(occurrences(text, words))


def class_key(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)) if len(tokens) else 0


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, np.uint8)
    bits[(tokens >> np.uint64(20)).astype(np.int64) % _BITS] = 1
    return np.packbits(bits).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: is the Jaccard similarity of two sorted sets at least percent?"""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Node:
    __slots__ = ("bits", "items", "parts", "high", "low", "slack")

    def __init__(self, items: np.ndarray, bits: np.ndarray, n: np.ndarray, slack: np.ndarray, leaf: int) -> None:
        self.items = items
        self.bits = np.bitwise_or.reduce(bits[items])
        self.low, self.high, self.slack = int(n[items].min()), int(n[items].max()), int(slack[items].max())
        self.parts: tuple[Node, ...] = ()
        if len(items) > leaf:
            own = bits[items]

            def alike(k: int) -> np.ndarray:
                both = np.bitwise_count(own & own[k]).sum(1, dtype=np.int64)
                return both / np.bitwise_count(own | own[k]).sum(1, dtype=np.int64)

            a = int(alike(0).argmin())
            to_a = alike(a)
            to_b = alike(int(to_a.argmin()))
            side = to_a > to_b
            if side.all() or not side.any():
                side = np.arange(len(items)) < len(items) // 2
            self.parts = tuple(Node(items[s], bits, n, slack, leaf) for s in (side, ~side))


class SignatureTree:
    """Over sets known by their bitmaps and sizes."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, percent: int, leaf: int) -> None:
        self.bits, self.n, self.percent = bits, n, percent
        self.slack = n - np.bitwise_count(bits).sum(1, dtype=np.int64)  # tokens that share a bit with another
        self.root = Node(np.arange(len(n)), bits, n, self.slack, leaf)

    def _apart(self, a: Node, b: Node) -> bool:
        """No member of a can reach the threshold with one of b."""
        p = self.percent
        if 100 * a.high < p * b.low or 100 * b.high < p * a.low:
            return True
        shared = int(np.bitwise_count(a.bits & b.bits).sum())
        most = min(a.high, b.high, a.slack + shared, b.slack + shared)
        return (100 + p) * most < p * (a.low + b.low)

    def pairs(self, group: callable) -> Iterator[tuple[int, int]]:
        """Pairs of members that may be linked; group(i) tells what is joined already, and may change meanwhile."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if a is not b and self._apart(a, b):
                continue
            known = group(int(a.items[0]))
            if all(group(i) == known for i in a.items.tolist()) and (a is b or all(group(i) == known for i in b.items.tolist())):
                continue
            if a is b:
                if a.parts:
                    x, y = a.parts
                    stack += [(x, y), (y, y), (x, x)]
                else:
                    yield from self._leaves(a.items, a.items, group, True)
            elif not a.parts and not b.parts:
                yield from self._leaves(a.items, b.items, group, False)
            elif b.parts and (not a.parts or len(b.items) >= len(a.items)):
                stack += [(a, x) for x in b.parts]
            else:
                stack += [(x, b) for x in a.parts]

    def _leaves(self, a: np.ndarray, b: np.ndarray, group: callable, same: bool) -> Iterator[tuple[int, int]]:
        shared = np.bitwise_count(self.bits[a][:, None] & self.bits[b][None]).sum(2, dtype=np.int64)
        na, nb = self.n[a][:, None], self.n[b][None]
        most = np.minimum(np.minimum(na, nb), np.minimum(self.slack[a][:, None], self.slack[b][None]) + shared)
        near = (100 + self.percent) * most >= self.percent * (na + nb)
        if same:
            near &= a[:, None] < b[None]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = int(a[i]), int(b[j])
            if group(x) != group(y):
                yield x, y


class Lot:
    """Round 1: sets of one block, a bounded number at a time; joined sets get one label, a key of theirs."""

    def __init__(self, settings: Settings) -> None:
        self.settings, self.kept = settings, []

    def join(self, new: list[tuple[int, np.ndarray]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """new: (key, tokens). ((key, label) of each, pairs of labels found to be one)."""
        all_, old, s = self.kept + new, len(self.kept), self.settings
        parent = list(range(len(all_)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        same = []
        if len(all_) > 1:
            n = np.array([len(t) for _, t in all_], np.int64)
            tree = SignatureTree(np.stack([bitmap(t) for _, t in all_]), n, s.percent, s.leaf)
            for i, j in tree.pairs(find):
                if linked(all_[i][1], all_[j][1], s.percent):
                    a, b = sorted((find(i), find(j)))
                    if b < old:
                        same.append((all_[a][0], all_[b][0]))
                    parent[b] = a
        size = np.bincount([find(i) for i in range(len(all_))], minlength=len(all_))
        best = sorted(np.flatnonzero(size).tolist(), key=lambda i: (-size[i], i))[: s.carried]
        labels = [(all_[i][0], all_[find(i)][0]) for i in range(old, len(all_))]
        self.kept = [all_[i] for i in best]
        return labels, same


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) from sorted batches; the first columns are the key."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _classes(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_hash, n, key, prefix) of every row; a task gives a class's prefix once, if it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, keys, prefixes = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                t = shingles(text or b"", s.words)
                key = class_key(t)
                n.append(len(t))
                keys.append(key)
                if key in seen or not len(t):
                    prefixes.append(None)
                    continue
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(key)
                prefixes.append(t[: s.prefix(len(t))].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n", "key", "prefix"])

    return docs.mapInArrow(common.lean(run), "doc_id long, text_hash long, n long, key long, prefix array<long>")


_ROUND1 = "key long, label long, bits binary"


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(doc_id, text_hash, ...) with the text of each; a row of docs that is there several times comes several times."""
    on = ["doc_id", "text_hash"]
    few = common.split(docs, keys, on)[0].alias("d")
    keys = keys.hint("merge").alias("k")
    # Merge joins throughout: the plan is then the same at every size, and nothing is broadcast that grows with the corpus.
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    return few.join(keys, same).select(*(f"k.{c}" for c in keys.columns if c not in on), "d.text")


def _round1(rows: DataFrame, s: Settings) -> DataFrame:
    """rows(block, part, key, text) to _ROUND1; a row without bits is a pair of labels. Each lot is a block's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, block, new, had, out = Lot(s), None, [], set(), []

        def close() -> None:
            nonlocal new
            labels, same = lot.join(new)
            out.extend((k, v, bitmap(t).tobytes()) for (k, v), (_, t) in zip(labels, new, strict=True))
            out.extend((a, b, None) for a, b in same)
            new = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["key", "label", "bits"])
            out = []
            return made

        for batch in batches:
            for b, part, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if (b, part) != block:
                    if new:
                        close()
                    lot, block, had = Lot(s), (b, part), set()
                if key in had:  # a row that is there several times
                    continue
                if len(had) > 50_000:
                    had.clear()
                had.add(key)
                new.append((key, shingles(text or b"", s.words)))
                if len(new) >= s.lot:
                    close()
                if len(out) >= 1000:
                    yield flush()
        if new:
            close()
        yield flush()

    dealt = rows.select("block", "part", "key", "text").repartition(common.partitions(rows.sparkSession), "block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInArrow(common.lean(run), _ROUND1)


def _first_round(docs: DataFrame, one: DataFrame, s: Settings) -> DataFrame:
    """_ROUND1 of all classes in one(doc_id, text_hash, key, n, block): lots of at most s.part classes each,
    then lots of their labels, until each block has become one lot."""

    def dealt(rows: DataFrame) -> DataFrame:
        sizes = common.materialise(rows.groupBy("block").agg(F.ceil(F.count("*") / s.part).cast("int").alias("parts")).where("parts > 1"), tidy=False)
        parts = F.coalesce("parts", F.lit(1))
        return rows.join(sizes.hint("merge"), "block", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    rows = common.materialise(dealt(one), tidy=False)
    out = common.materialise(_round1(_texts(docs, rows), s))
    level = out
    while not (large := rows.where("parts > 1")).isEmpty():
        # Some sets of each group stand for what a part has joined; of sets that were joined with none, each for itself.
        groups = level.where("bits IS NOT NULL")
        sizes = groups.groupBy("label").agg(F.greatest(F.lit(1), F.floor(F.count("*") / s.heads)).alias("share"))
        heads = groups.join(sizes.hint("merge"), "label").where((F.col("key") == F.col("label")) | (F.pmod(F.xxhash64("key", F.lit(11)), F.col("share")) == 0)).select("key")
        left = common.materialise(large.drop("parts", "part").join(heads.hint("merge"), "key"), tidy=False)
        if left.count() >= large.count():
            break  # nothing was joined: the same lots would come again
        rows = common.materialise(dealt(left), tidy=False)
        level = common.materialise(_round1(_texts(docs, rows), s))
        out = out.unionByName(level.select("key", "label", F.lit(None).cast("binary").alias("bits")))
    return out


def _candidates(rows: DataFrame, s: Settings) -> DataFrame:
    """rows(token, i, j, weight, key, label, n, bits, main) dealt by the first three: (a, b, weight) of pairs that trees can't rule out.
    Where a cell holds two blocks, only pairs across count: those within a block meet in a cell of their own."""
    names = ["a", "b", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=names)
            out = []
            return made

        for (_, i, j, weight), members in _grouped(batches, 4):
            across = i >= 0 or (i < -1 and j != -2 - i)
            keys, labels, main = ([m[k] for m in members] for k in (0, 1, 4))
            if len(set(labels)) < 2:
                continue
            tree = SignatureTree(np.frombuffer(b"".join(m[3] for m in members), np.uint64).reshape(len(members), -1), np.array([m[2] for m in members], np.int64), s.percent, s.leaf)
            for x, y in tree.pairs(labels.__getitem__):
                if across and main[x] == main[y]:
                    continue
                out.append((min(keys[x], keys[y]), max(keys[x], keys[y]), weight))
                if len(out) >= 20_000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(common.lean(run), "a long, b long, weight long")


def _verified(pairs: DataFrame, s: Settings) -> DataFrame:
    """pairs(a, b, x, y), x and y the texts: those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3)), strict=True)
            good = [linked(shingles(x, s.words), shingles(y, s.words), s.percent) for x, y in both]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return pairs.select("a", "b", "x", "y").mapInArrow(common.lean(run, 64), "u long, v long")


def _met(classes: DataFrame, s: Settings) -> DataFrame:
    """(token, key, n, hot, least) of the prefix tokens that several classes hold; least is the least class of them."""
    each = classes.where("prefix IS NOT NULL").select("key", "n", F.explode("prefix").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("c"), F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    held = held.select("token", "least", (F.col("c") > s.often).alias("hot"))
    # A class that several tasks have given comes several times.
    return each.join(held.hint("merge"), "token").groupBy("token", "key").agg(F.first("n").alias("n"), F.first("hot").alias("hot"), F.first("least").alias("least"))


def labels(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_hash, n, c) for every row of docs(doc_id, text): c is equal for the rows of one component, null without words."""
    with common.spent(docs.sparkSession):
        return _labels(docs, settings)


def _labels(docs: DataFrame, s: Settings) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    classes = common.materialise(_classes(docs.select("doc_id", "text_hash", "text"), s))
    met = common.materialise(_met(classes, s))
    least = s.common_sql(s.least_sql("n"))
    own = met.groupBy("key", "n").agg(F.count_if("hot").alias("hot"), F.count_if(~F.col("hot")).alias("cool"), F.min("least").alias("any"), F.min(F.when(~F.col("hot"), F.col("least"))).alias("first"))
    # A class with fewer hot tokens than it must share meets others in its other tokens too.
    own = own.where(f"hot + cool >= {least}").withColumn("plain", F.expr(f"hot < {least}"))
    own = own.where("NOT plain OR cool > 0").select("key", "plain", F.when(F.col("plain"), F.col("hot")).otherwise(0).alias("spared"), F.when(F.col("plain"), F.col("first")).otherwise(F.col("any")).alias("block"))
    named = classes.where("n > 0").groupBy("key").agg(F.min(F.struct("n", "doc_id", "text_hash")).alias("r")).select("key", "r.*")
    one = common.materialise(named.join(own.hint("merge"), "key"))
    first = _first_round(docs, one, s)
    # Round 2. Labels of one component are one, so that groups that lots have joined stay out.
    known = common.components(first.select(F.col("key").alias("u"), F.col("label").alias("v")))
    known = common.materialise(known.select(F.col("u").alias("key"), F.col("c").alias("label")), tidy=False)
    sets = one.join(first.where("bits IS NOT NULL").select("key", "bits").hint("merge"), "key").join(known.hint("merge"), "key", "left")
    sets = common.materialise(sets.select("key", "n", "plain", "spared", F.coalesce("label", "key").alias("label"), "bits"), tidy=False)
    rows = met.select("token", "key", "hot").join(sets.select("key", "label", "plain").hint("merge"), "key").where("NOT (hot AND plain)").select("token", "key", "label")
    rows = common.materialise(rows)
    member = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    groups = rows.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size"), *member).where("least <> most")
    # Many tokens have the same members; one of these stands for all.
    groups = common.materialise(groups.groupBy("size", "s0", "s1").agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "size", "weight"), tidy=False)
    rows = common.materialise(rows.join(groups.hint("merge"), "token"))
    cells = _cells(rows, s).join(sets.select("key", "n", "bits").hint("merge"), "key").select("token", "i", "j", "weight", "key", "label", "n", "bits", "main")
    cells = cells.repartition(common.partitions(spark), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    pairs = common.materialise(_candidates(cells, s).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("spared").alias(f"spared{side}")).hint("merge"), side)
    pairs = common.materialise(pairs.where(f"weight >= {s.common_sql('least(na, nb)')} - greatest(spareda, sparedb)").select("a", "b"))
    used = one.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().hint("merge"), "key").select("doc_id", "text_hash", "key")
    texts = common.materialise(_texts(docs, common.materialise(used, tidy=False)).groupBy("key").agg(F.first("text").alias("text")))
    for side, name in zip("ab", "xy", strict=True):
        pairs = pairs.join(texts.select(F.col("key").alias(side), F.col("text").alias(name)).hint("merge"), side)
    found = common.components(known.select(F.col("key").alias("u"), F.col("label").alias("v")).unionByName(_verified(pairs, s)))
    named = classes.select("doc_id", "text_hash", "n", "key").join(found.select(F.col("u").alias("key"), "c"), "key", "left")
    return common.materialise(named.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.coalesce("c", "key")).alias("c")))


def _cells(rows: DataFrame, s: Settings) -> DataFrame:
    """rows(token, key, label, size, weight) dealt to cells (token, i, j) of bounded size, with main: has it the label of the group's most members?

    A group within the bound is one cell, i = -1. Of others, blocks of main members meet blocks of the others (i >= 0),
    and blocks of the others meet each other (i = -2 - the first block, main: is it of that one?).
    """
    small = rows.where(f"size <= {s.block}").select("token", F.lit(-1).alias("i"), F.lit(0).alias("j"), "weight", "key", "label", F.lit(True).alias("main"))
    large = rows.where(f"size > {s.block}")
    most = large.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"))
    most = common.materialise(most.select("token", F.col("m.label").alias("top"), F.col("m.c").alias("tops")), tidy=False)
    half = s.block // 2
    large = large.join(most.hint("merge"), "token").withColumn("main", F.expr("label = top"))
    large = large.withColumn("mains", F.ceil(F.col("tops") / half).cast("int")).withColumn("others", F.ceil((F.col("size") - F.col("tops")) / half).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    across = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("others")).otherwise(F.col("mains")) - 1)))
    across = across.select("token", F.when(F.col("main"), F.col("own")).otherwise(F.col("other")).cast("int").alias("i"), F.when(F.col("main"), F.col("other")).otherwise(F.col("own")).cast("int").alias("j"), "weight", "key", "label", "main")
    among = large.where("NOT main").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    among = among.select("token", (-2 - F.least("own", "other")).cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), "weight", "key", "label", (F.col("own") <= F.col("other")).alias("main"))
    return small.unionByName(across).unionByName(among)


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    labelled = labels(docs, settings)
    worded = labelled.where("n > 0")
    # Written first, so that the join reads two plain shuffles and Spark can split a large component.
    named = common.materialise(worded.groupBy("c").agg(F.min("doc_id").alias("component_id")), tidy=False)
    rest = worded.join(named.hint("merge"), "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return rest.unionByName(labelled.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """docs with one document of each component, that of the smallest id (of a repeated id, the
    smallest hash of the text; rows equal in both stay once); columns as in docs, whatever their
    names. Documents without words all stay, null texts among them."""
    found = labels(docs, settings)
    keys = common.fresh(docs, "_none", "_id", "_hash")
    stays, rows = common.fresh(docs, "_stays", "_rows")
    found = found.select(F.col("doc_id").isNull().alias(keys[0]), F.coalesce("doc_id", F.lit(0)).alias(keys[1]), F.col("text_hash").alias(keys[2]), "n", "c")
    first = found.where("n > 0").groupBy("c").agg(F.min(F.struct(*keys)).alias("r")).select("r.*").withColumn(stays, F.lit(True))
    each = found.where("n > 0").groupBy(*keys).agg(F.count("*").alias(rows)).join(first.hint("merge"), keys, "left")
    # What goes, and what repeats, is the smaller part; all other rows pass without a shuffle.
    special = common.materialise(each.where(F.col(stays).isNull() | (F.col(rows) > 1)).select(*keys, F.coalesce(stays, F.lit(False)).alias(stays)))
    text = F.col("text").cast("string")
    marked = docs.select(*common.columns(docs), F.col("doc_id").isNull().alias(keys[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(keys[1]), F.xxhash64(text).alias(keys[2]))
    some, rest = common.split(marked, special, keys)
    some = some.join(special.hint("merge"), keys, "left").where(F.coalesce(stays, F.lit(True)))
    once = some.where(F.col(stays).isNotNull()).dropDuplicates(keys).unionByName(some.where(F.col(stays).isNull()))
    own = common.columns(docs)
    return rest.select(*own).unionByName(once.select(*own))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
