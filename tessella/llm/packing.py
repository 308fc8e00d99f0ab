"""Cost-balanced packing of tokenised documents into sequences.

A sequence's cost is linear in its tokens plus quadratic in the tokens of each document in it
(attention stays inside a document). Documents are taken in groups of bounded size, longest
first; each goes to the sequence of lowest cost that still has room for it. Only where no
sequence has room for the whole is a document cut, into the largest rooms left. The
capacities of a group add up to its tokens: full sequences, and powers of two for the rest,
so that no sequence needs padding.

Null text counts as empty text and gives one piece, the end mark alone. Every row is packed,
repeated rows each on their own; other columns are not read.

Ids are the library's own, its settings unchanged: a mark that a text spells out, such as
<|endoftext|>, becomes the mark's id. Tables may be empty, and may have further columns of any name.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

LENGTH = 2048
END_ID = 1
#: Tokens in a group: bounds memory, and the loss at a group's end.
GROUP_TOKENS = LENGTH * 1024
#: Cost of n tokens of one document: n + n * n / QUADRATIC.
QUADRATIC = 1024
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Words that a worker remembers at most, twice over, and their greatest length; fewer where it has served other stages.
MEMO, MEMO_WORD, MEMO_STAGE = 600_000, 64, 50_000


def _simple(last: str) -> bool:
    """Latin letters and digits below U+0250, or nothing: normal as they are, and of simple lower case."""
    return last < "\u0250" and last != "\u0130"


def _stem(word: str) -> tuple[str, str]:
    """A word with a small first letter and without one closing mark, and the mark: the vocabulary
    is lower case, and a lone mark after a letter or digit is apart. Normal forms and lower case of
    some letters end in a combining mark, which would join it, so only _simple() ones count. Likewise
    a capital before a combining mark stays: the two may have a normal form that the small letter hasn't."""
    if "A" <= word[:1] <= "Z" and _simple(word[1:2]):
        word = word[0].lower() + word[1:]
    if word[-1:] in (".", ",") and word[-2:-1].isalnum() and _simple(word[-2]):
        return word[:-1], word[-1]
    return word, ""


#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the others as the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _plain(word: str) -> bool:
    """Only simple letters: one piece for the vocabulary, so that the library's model can take them
    without its other steps."""
    return word.isalpha() and _simple(max(word)) and "\u0130" not in word


class WordEncoder:
    """Ids by the tokenizers library, each word between blanks once: no token of this kind of
    vocabulary spans a blank, so a text's ids are those of its words one after another."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        self._most = memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._model = self._lib.model
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._marks = {m: array("I", self._lib.encode(m, add_special_tokens=False).ids).tobytes() for m in ("", ".", ",")}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.replace("\n", " ").split(" ")
        memo = self._memo
        new = set(words).difference(memo)
        extra = {}
        if new:
            if len(memo) >= self._most:
                self._older, self._memo = memo, {}
                memo, new = self._memo, set(words)
            older = self._older
            stems, unknown = {}, {}
            for w in new:
                if w in older:
                    memo[w] = older[w]
                    continue
                stems[w] = stem, _ = _stem(w)
                if stem not in memo and stem not in older:
                    unknown[stem] = None
            for w in [w for w in unknown if _plain(w)]:
                del unknown[w]
                ids = array("I", [t.id for t in self._model.tokenize(w.lower().encode().decode("latin-1").translate(_SHOWN))]).tobytes()
                (memo if len(w) <= MEMO_WORD else extra)[w] = ids
            made = dict(zip(unknown, self._lib.encode_batch_fast(list(unknown), add_special_tokens=False), strict=True)) if unknown else {}
            for w, e in made.items():
                (memo if len(w) <= MEMO_WORD else extra)[w] = array("I", e.ids).tobytes()
            for w, (stem, mark) in stems.items():
                ids = memo.get(stem) or older.get(stem) or extra.get(stem, b"")
                (memo if len(w) <= MEMO_WORD else extra)[w] = ids + self._marks[mark]
        if extra:
            return b"".join([memo[w] if w in memo else extra[w] for w in words])
        return b"".join(map(memo.__getitem__, words))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, memo: int = MEMO) -> WordEncoder:
    if (path, memo) not in _encoders:
        _encoders[path, memo] = WordEncoder(path, memo)
    return _encoders[path, memo]


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Full sequences, then distinct powers of two, adding up to total."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(sizes: list[int], length: int = LENGTH, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these token counts."""
    room = np.array(capacities(sum(sizes), length), np.int64)
    used, cost, out, full = np.zeros(len(room), np.int64), np.zeros(len(room)), [], 0
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            out.append((d, start, length, full, 0))
            room[full] = 0
            full += 1
        if n % length:
            rest.append((n % length, d, n - n % length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    base, room, used, cost = full, room[full:], used[full:], cost[full:]
    for n, d, start in rest:
        while n:
            masked = np.where(room >= n, cost, np.inf)
            s = int(masked.argmin())
            take = n
            if masked[s] == np.inf:
                s = int(room.argmax())
                take = int(room[s])
            out.append((d, start, take, base + s, int(used[s])))
            room[s] -= take
            used[s] += take
            cost[s] += take + take * take / quadratic
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, memo: int = MEMO) -> DataFrame:
    """SCHEMA, one row a piece; ids holds the piece's ids, little-endian unsigned 32-bit. memo: words that a worker remembers at most, twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, names = encoder(path, memo), array("I", [end_id]).tobytes(), [c.split()[0] for c in SCHEMA.split(", ")]
        next_id = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, held, tokens
            pieces = assign([len(ids) // 4 for _, ids in held], length)
            rows = [(held[d][0], start, n, held[d][1][4 * start : 4 * (start + n)], len(held[d][1]) // 4, next_id + s, at) for d, start, n, s, at in pieces]
            next_id += 1 + max(p[3] for p in pieces)
            held, tokens = [], 0
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                held.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.lean(run), SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs, as op10_packing gives them; the last stage, so with columns of its own. Null text
    gives one piece, repeated rows their own pieces each, an empty table none. A worker has served other
    stages before, so it remembers fewer words."""
    return op10_of(docs, MEMO_STAGE)


def op10_of(docs: DataFrame, memo: int = MEMO) -> DataFrame:
    return digests(pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo=memo))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_of(common.table(spark, sf_dir, "documents"))
