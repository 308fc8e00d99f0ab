"""Alignment of two tokenizers by a transducer whose state is a dangling suffix.

Both token sequences of a text spell the same bytes. Read in step, one side leads by some
unmatched bytes: the residual. The state is which side leads and its residual; the next token
of the other side leads to the next state, and these transitions are remembered by residual and
token. An empty residual closes a group: both sides have a border there. Each transition links
the leading token with the token read, since their bytes overlap, and no others do.

Both vocabularies treat a text segment by segment (see segments), with an empty residual at
each end, so what the transducer gives for a segment is remembered too.

Documents are dealt in blocks of bounded size, each with a dictionary of its linked id pairs,
so an id pair that stands in every document travels once a block: counts over the corpus are
sums over dictionaries, and are joined back to dictionaries, then to the blocks' documents.

Texts that are null or empty, or whose tokens of either side don't spell the text (such as
texts with U+2581, which one vocabulary takes for a blank), have no tokens: zeros and an empty
digest. Every row gives one row and counts as a document of its own, repeated rows too. Other
columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common, segments, trie

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Segments in a generation of the memo, transitions remembered, and pairs of documents and id pairs in a block.
MEMO, STEPS, BLOCK = 200_000, 1_000_000, 600_000
Group = tuple[list[int], list[int]]


class Transducer:
    """a, b: the bytes of each side's ids."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]) -> None:
        self._bytes = (a, b)
        self._steps: dict[tuple[int, bytes, int], tuple[int, bytes] | None] = {}

    def _step(self, lead: int, residual: bytes, token: int) -> tuple[int, bytes] | None:
        """The state after the side behind has read a token: (side that leads, its residual); None if the bytes differ."""
        key = (lead, residual, token)
        if key in self._steps:
            return self._steps[key]
        read = self._bytes[1 - lead][token]
        if residual.startswith(read):
            after = (lead, residual[len(read) :])
        elif read.startswith(residual):
            after = (1 - lead, read[len(residual) :])
        else:
            after = None
        if len(self._steps) >= STEPS:
            self._steps.clear()
        self._steps[key] = after
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[Group], list[tuple[int, int]]] | None:
        """Groups of ids between common borders, and the linked pairs; None if the sides spell different bytes."""
        sides, at, groups, links = (a, b), [0, 0], [], []
        first = self._bytes[0]
        while at[0] < len(a):
            ids: tuple[list[int], list[int]] = ([a[at[0]]], [])
            last, lead, residual = [a[at[0]], -1], 0, first[a[at[0]]]
            at[0] += 1
            while residual:
                behind = 1 - lead
                if at[behind] >= len(sides[behind]):
                    return None
                token = sides[behind][at[behind]]
                at[behind] += 1
                last[behind] = token
                ids[behind].append(token)
                links.append((last[0], last[1]))
                state = self._step(lead, residual, token)
                if state is None:
                    return None
                lead, residual = state
            groups.append(ids)
        return (groups, links) if at[1] == len(b) else None


class Aligner:
    """The two tokenizers of the libraries, special tokens' strings being plain text, and the transducer between them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        marks = {t.content for t in self._a.get_added_tokens_decoder().values()}
        pieces = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
        self._transducer = Transducer({i: trie.shown_bytes(t) for t, i in self._a.get_vocab().items() if t not in marks}, pieces)
        # Segments are borders of the second vocabulary only if no piece goes on from a character into a blank or line feed.
        if any(" " in t.lstrip(b" ").decode("utf-8", "replace") or b"\n" in t and t != b"\n" for t in pieces.values()):
            raise ValueError(f"{b_path}: pieces reach across blanks")
        self._memo = segments.Memo(self._solve, MEMO)

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments of text by either tokenizer; the second's own blank in front is the segment's, or dropped."""
        a = [e.ids for e in self._a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self._b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return a, [i if t[0] == " " else i[1:] for t, i in zip(texts, b, strict=True)]

    def _solve(self, todo: list[str]) -> Iterator[tuple[str, int, bytes] | None]:
        """Of each segment: its groups in writing, tokens of either side (in one number), and links; None if the bytes differ."""
        for text, a, b in zip(todo, *self.ids(todo), strict=True):
            found = self._transducer.align(a, b)
            # The first side spells the text always; the second may not.
            if found is None:
                yield None
                continue
            groups, links = found
            written = ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
            yield written, len(a) << 32 | len(b), array("q", [x << 32 | y for x, y in links]).tobytes()

    def documents(self, texts: list[str | None]) -> Iterator[tuple[str, int, int, bytes]]:
        """Of each text: its groups in writing, its number of tokens of either side, its links (a << 32 | b)."""
        cut = [segments.segments(" " + t) if t else [] for t in texts]
        memo = self._memo.of({s for parts in cut for s in parts})
        for parts in cut:
            found = [memo[s] for s in parts]
            if not found or None in found:
                yield "", 0, 0, b""
            else:
                n = sum([f[1] for f in found])
                yield ";".join([f[0] for f in found]), n >> 32, n & 0xFFFFFFFF, b"".join([f[2] for f in found])


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs(doc_id, text) to (doc_id, groups array<struct<a array<int>, b array<int>>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            found = [[dict(zip("ab", ([int(i) for i in side.split(",")] for side in g.split("|")), strict=True)) for g in written.split(";")] if written else [] for written, *_ in aligner(a_path, b_path).documents(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run, 128), "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


_BLOCK = "block long, doc_id long, n_a long, n_b long, n_groups long, digest string, entry array<int>, times array<int>, pairs array<long>, docs array<int>"


def blocks(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of aligned documents: one row a document, and one row a block with its dictionary. entry, times: a document's different
    linked pairs, as places in the dictionary, and their occurrences; pairs, docs: the dictionary (null in a document's row), and in
    how many of the block's documents a pair is. Rows stay small, since Spark reads and writes them by the thousand, whatever they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, next_id = aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        rows: list[tuple[int | None, int, int, int, str]] = []
        linked: list[np.ndarray] = []
        times: list[np.ndarray] = []
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, linked, times, next_id
            pairs, entry, n = np.unique(np.concatenate(linked), return_inverse=True, return_counts=True)
            ends = pa.array(np.cumsum([0, *map(len, linked)]), pa.int32())
            own = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (entry, np.concatenate(times))]
            plain = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds[1:6], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([next_id] * len(rows), pa.int64()), *plain, *own, *(pa.nulls(len(rows), k) for k in kinds[8:])], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([next_id], pa.int64()), *(pa.nulls(1, k) for k in kinds[1:8]), pa.array([pairs], kinds[8]), pa.array([n], kinds[9])], names=names)
            next_id, rows, linked, times = next_id + 1, [], [], []

        size = 0
        for batch in batches:
            for doc_id, (written, n_a, n_b, links) in zip(batch.column(0).to_pylist(), find.documents(batch.column(1).to_pylist()), strict=True):
                own, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                rows.append((doc_id, n_a, n_b, written.count(";") + 1 if written else 0, hashlib.sha256(written.encode()).hexdigest() if written else ""))
                linked.append(own)
                times.append(n)
                size += len(own) + 16
                if size >= block:
                    yield from flush()
                    size = 0
        if rows:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run, 128), _BLOCK)


def _scored(held: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one block, from what its dictionary's pairs count."""
    if _loaded:  # a worker that has aligned does so no more
        _loaded.clear()
        common.release()
    held = held.combine_chunks()
    place, count, best = (found.column(c).to_numpy() for c in ("place", "count", "best"))
    counts, bests = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    counts[place], bests[place] = count, best
    entry, times = (pc.list_flatten(held.column(c)).to_numpy() for c in ("entry", "times"))
    times, ends = times.astype(np.int64), np.cumsum(pc.list_value_length(held.column("entry")).to_numpy())

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[np.concatenate([np.zeros(1, np.int64), ends])]
        return sums[1:] - sums[:-1]

    sums = [pa.array(total(x)) for x in (times, times * bests[entry], times * counts[entry])]
    return pa.table([*(held.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *sums, held.column("digest")], names=[c.split()[0] for c in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """RESULT for docs(doc_id, text)."""
    held = common.materialise(blocks(docs, a_path, b_path, block))
    pairs = held.where("pairs IS NOT NULL")
    counts = pairs.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy("pairs").agg(F.sum("docs").alias("count"))
    # An id of the first side has as many partners at most as the second vocabulary has ids.
    most = F.max("count").over(Window.partitionBy(F.shiftright("pairs", 32)))
    scored = counts.select(F.col("pairs").alias("pair"), "count", (F.col("count") == most).cast("int").alias("best"))
    listed = pairs.select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    found = listed.join(scored, "pair").select("of_block", "place", "count", "best")
    own = held.where("pairs IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "digest", "entry", "times")
    return own.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_scored, RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
