"""Byte-level BPE encoding and decoding over an Aho-Corasick automaton.

A piece of text is mapped byte for byte to Latin-1, and one pass of an automaton over the
reversed tokens finds the longest token that starts at each byte. Encoding walks those
longest matches; it steps back to a shorter token wherever the last two tokens could not
stand side by side, that is wherever merging their joined bytes would give other tokens.
That test is memoised, so the walk is linear and reproduces the merges exactly.

Null text counts as empty text: no ids. Every row gives one row, repeated rows too, and an empty table
none; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: A generation of a memo has this many entries, two are kept, and longer pieces never are, so memory stays bounded.
MEMO, MEMO_PIECE = 300_000, 64


class ByteBPE:
    """ranks: token bytes to id, lower ids merge first; pattern: splits a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self._pair: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._piece: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._halves[i] = self._split(token, i)
        # A token that its own merges do not reach can only be a whole piece.
        usable = [t for t, i in ranks.items() if len(t) == 1 or self._halves[i]]
        self._find = ahocorasick.Automaton()
        for t in usable:
            self._find.add_word(t[::-1].decode("latin-1"), ranks[t])
        self._find.make_automaton()
        known = set(usable)
        self._shorter = {ranks[t]: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in usable}
        self._size = {ranks[t]: len(t) for t in usable}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _split(self, token: bytes, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one when its bytes are merged alone; None if they don't."""
        if len(token) == 1:
            return None
        parts = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(self.tokens[a] + self.tokens[b], i), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(i, 0))
            if best[0] >= i:
                return None
            parts[best[1] : best[1] + 2] = [best[0]]
        return (parts[0], parts[1]) if len(parts) == 2 and self.ranks.get(self.tokens[parts[0]] + self.tokens[parts[1]]) == i else None

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side: no merge across their border comes before theirs.

        Undoing the merges from the last to the first gives what stood on either side of the
        border at each moment; the border holds if none of these pairs was due to merge.
        """
        key = (a, b)
        if (known := self._pair.get(key)) is not None:
            return known
        ranks, tokens, halves = self.ranks, self.tokens, self._halves
        # Alive until: the token is taken up by its parent's merge; the final ones are never taken up.
        left, right = [(a, None)], [(b, None)]
        while (h := halves[left[-1][0]]) is not None:
            left.append((h[1], left[-1][0]))
        while (h := halves[right[-1][0]]) is not None:
            right.append((h[0], right[-1][0]))
        i, j, good = len(left) - 1, len(right) - 1, True
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            merged = ranks.get(tokens[x] + tokens[y])
            # Of equal ranks the leftmost merges first: the left parent at its rank goes before the border,
            # the border at its rank goes before the right parent.
            if merged is not None and (x_end is None or merged < x_end) and (y_end is None or merged <= y_end):
                good = False
                break
            if x_end is None and y_end is None:
                break
            if y_end is None or x_end is not None and x_end <= y_end:
                i -= 1
            else:
                j -= 1
        if len(self._pair) >= 4 * MEMO:
            self._pair.clear()
        self._pair[key] = good
        return good

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        longest = [-1] * n
        size = self._size
        for end, i in self._find.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0:  # of the tokens that end in one place, the longest comes first
                longest[at] = i
        out: list[int] = []
        pos, token = 0, longest[0]
        blocked = bytearray(n + 1)
        fits, shorter = self.fits, self._shorter
        while pos < n:
            end = pos + size[token]
            if not blocked[end] and (not out or fits(out[-1], token)):
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
                continue
            token = shorter[token]
            while token < 0:  # nothing shorter: this place can't follow, so the token before must be shorter
                blocked[pos] = 1
                token = out.pop()
                pos -= size[token]
                token = shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, older, out = self._piece, self._older, []
        for p in self.pattern.findall(text):
            ids = memo.get(p)
            if ids is None:
                ids = older.get(p)
                if ids is None:
                    ids = array("I", self.piece(p.encode())).tobytes()
                if len(p) <= MEMO_PIECE:
                    if len(memo) >= MEMO:
                        self._older = older = memo
                        self._piece = memo = {}
                    memo[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.load(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) to (doc_id, bytes binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(common.lean(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """SCHEMA: digests of the ids, and of the bytes that these decode to, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            counts, ids, back = [], [], []
            for text in batch.column(1).to_pylist():
                packed = bpe.encode(text or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), SCHEMA)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
