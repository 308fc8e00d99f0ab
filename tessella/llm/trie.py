"""BPE encoding by depth-first traversal of a trie of the distinct words, and decoding.

The words of a batch that are new make a trie, kept in depth-first order, so words that begin
alike share the nodes of their beginning. The encoding of a prefix ends in exactly one token, and what is
before that token is the encoding of a shorter prefix; so one token id for each node, its last
token, describes the encodings of all prefixes. The traversal finds a node's last token among
the tokens that end there, which an automaton over the tokens lists: it is the one that can stand behind the last token of the node
where it begins. A shared prefix is worked out once; a word's ids are read off backwards.

Whether two tokens can stand side by side is found by undoing their merges, and remembered.

Special tokens that a text spells out become their ids, as the library has it. Null text counts
as empty: no tokens. Every row gives one row, repeated rows each their own; other columns are
not read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, segments

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Segments in a generation of the memo, words and bytes in one trie, rows worked on at once: bounds of memory.
MEMO, TRIE_WORDS, TRIE_BYTES, ROWS = 250_000, 20_000, 1 << 20, 256
#: Steps of the automaton remembered besides those along the tokens themselves.
STEPS = 1_000_000
#: Words are compared in columns of so many bytes; longer ones share what their first so many bytes share.
WIDTH = 32
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the others as the characters from 256 on.
SHOWN = {chr(b): b for b in _PRINTED} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def shown_bytes(token: str) -> bytes:
    return bytes(map(SHOWN.__getitem__, token))


def preorder(words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
    """The trie of these distinct words, nodes in depth-first order: each word with the depth of the
    node where it leaves the word before. Beginnings are compared up to WIDTH bytes."""
    order = sorted(words)
    if not order:
        return
    heads = np.array([w[:WIDTH] for w in order], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)
    sizes = np.fromiter(map(len, order), np.int64, len(order))
    differ = np.ones((len(order), WIDTH + 1), bool)
    differ[1:, :WIDTH] = heads[1:] != heads[:-1]
    shared = differ.argmax(axis=1)
    shared[0] = 0
    # Padding equals bytes of value 0, so no more is shared than either word has.
    shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    yield from zip(order, shared.tolist(), strict=True)


class TrieBPE:
    """tokens: bytes of each id; merges: pairs of ids in the order in which they merge; special: texts that are ids by themselves."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int]], special: dict[str, int], pattern: str) -> None:
        self.tokens, self._special = tokens, special
        ids = {t: i for i, t in tokens.items()}
        self._merge: dict[tuple[int, int], tuple[int, int]] = {(a, b): (rank, ids[tokens[a] + tokens[b]]) for rank, (a, b) in enumerate(merges)}
        self._size = {i: len(t) for i, t in tokens.items()}
        self._fits: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int, int] | None] = {}
        by_byte = {t[0]: i for t, i in ids.items() if len(t) == 1}
        for i, t in tokens.items():
            self._halves[i] = self._undone([by_byte[b] for b in t], i)
        self._ids = {t: i for t, i in ids.items() if len(t) == 1 or self._halves[i]}
        self._automaton()
        self._decimal = {i: str(i) for i in tokens}
        self._pattern = regex.compile(pattern)
        self._apart = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self._memo = segments.Memo(self._segments, MEMO)

    @classmethod
    def load(cls, path: str, pattern: str) -> TrieBPE:
        """From the library's file of a byte-level vocabulary; settings that change ids otherwise are refused."""
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        model, pre = t["model"], t["pre_tokenizer"]
        plain = not (t["normalizer"] or t["post_processor"] or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if not plain or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in t["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        vocab = model["vocab"]
        special = {a["content"]: a["id"] for a in t["added_tokens"]}
        tokens = {i: shown_bytes(s) for s, i in vocab.items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls(tokens, [(vocab[a], vocab[b]) for a, b in pairs], special, pattern)

    def _undone(self, parts: list[int], whole: int) -> tuple[int, int, int] | None:
        """(left, right, rank) of the last merge that gives this token from its bytes; None if its merges don't."""
        last = None
        while len(parts) > 1:
            best = min(((self._merge[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self._merge), default=None)
            if best is None:
                return None
            k = best[1]
            last = (parts[k], parts[k + 1], best[0])
            parts[k : k + 2] = [self._merge[parts[k], parts[k + 1]][1]]
        return last if parts == [whole] else None

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b can stand side by side: undoing their merges from the last to the first, no
        pair that stood on the two sides of the border was due to merge before either was taken up."""
        merge, halves = self._merge, self._halves
        # What stands at the border, innermost last, each with the rank of the merge that takes it up.
        left: list[tuple[int, float]] = [(a, float("inf"))]
        while (h := halves[left[-1][0]]) is not None:
            left.append((h[1], h[2]))
        right: list[tuple[int, float]] = [(b, float("inf"))]
        while (h := halves[right[-1][0]]) is not None:
            right.append((h[0], h[2]))
        good = True
        while good:
            (x, x_end), (y, y_end) = left[-1], right[-1]
            due = merge.get((x, y))
            # At equal ranks the leftmost goes first: the left merge before the border's, the border's before the right one.
            if due is not None and due[0] < x_end and due[0] <= y_end:
                good = False
            elif x_end <= y_end:
                if len(left) == 1:
                    break
                left.pop()
            else:
                right.pop()
        if len(self._fits) >= 8 * MEMO:
            self._fits.clear()
        self._fits[a << 32 | b] = good
        return good

    def _automaton(self) -> None:
        """States are the beginnings of tokens. Each has the tokens that end there, longest first: (id, bytes)."""
        index = {b"": 0}
        for t in sorted(self._ids):
            for k in range(1, len(t) + 1):
                index.setdefault(t[:k], len(index))
        self._next: dict[int, int] = {}
        self._fall = [0] * len(index)
        self._ends: list[tuple[tuple[int, int], ...]] = [()] * len(index)
        for prefix in sorted(index, key=len):
            state = index[prefix]
            if not prefix:
                continue
            shorter = next(k for k in range(1, len(prefix) + 1) if prefix[k:] in index)
            self._fall[state] = index[prefix[shorter:]]
            own = ((self._ids[prefix], len(prefix)),) if prefix in self._ids else ()
            self._ends[state] = own + self._ends[self._fall[state]]
            self._next[index[prefix[:-1]] << 8 | prefix[-1]] = state
        self._known = len(self._next)

    def _step(self, state: int, b: int) -> int:
        """The state behind byte b; a step that leaves a token's course is remembered too."""
        key, at = state << 8 | b, state
        while (found := self._next.get(at << 8 | b)) is None:
            at = self._fall[at]
        if len(self._next) > self._known + STEPS:
            self._next = dict(islice(self._next.items(), self._known))
        self._next[key] = found
        return found

    def words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each of these distinct words.

        preorder() has the trie's nodes in depth-first order: each word adds those below the depth
        at which it leaves the word before. states and last hold the way from the root to a node.
        """
        out: dict[bytes, list[int]] = {}
        states, last = [0], [-1]
        size, ends, fits, known = self._size, self._ends, self.fits, self._fits
        for word, shared in preorder(words):
            n = len(word)
            if len(last) <= n:
                states += [0] * (n + 1 - len(states))
                last += [-1] * (n + 1 - len(last))
            state, step = states[shared], self._next
            for depth in range(shared + 1, n + 1):
                b = word[depth - 1]
                below = step.get(state << 8 | b)
                if below is None:
                    below, step = self._step(state, b), self._next
                states[depth] = state = below
                for token, length in ends[state]:
                    start = depth - length
                    if not start:
                        break
                    good = known.get(last[start] << 32 | token)
                    if good or good is None and fits(last[start], token):
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                last[depth] = token
            ids, depth = [], n
            while depth:
                ids.append(token := last[depth])
                depth -= size[token]
            ids.reverse()
            out[word] = ids
        return out

    def _segments(self, todo: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each segment: its ids in decimal, and what they decode to."""
        pieces = [[p.encode() for p in self._pattern.findall(s)] for s in todo]
        known: dict[bytes, list[int]] = {}
        fresh: set[bytes] = set()
        size = 0
        for words in pieces:
            for w in words:
                if w not in known and w not in fresh:
                    fresh.add(w)
                    size += len(w)
            if len(fresh) >= TRIE_WORDS or size >= TRIE_BYTES:
                known |= self.words(fresh)
                fresh, size = set(), 0
        known |= self.words(fresh)
        for words in pieces:
            ids = [i for w in words for i in known[w]]
            yield ",".join(map(self._decimal.__getitem__, ids)), b"".join(map(self.tokens.__getitem__, ids))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text: its ids in decimal, joined by commas, and the bytes that they decode to."""
        cut = [[(self._special[p], p) if k % 2 else segments.segments(p) for k, p in enumerate(self._apart.split(t))] if self._apart and self._apart.search(t) else [segments.segments(t)] for t in texts]
        memo = self._memo.of({s for parts in cut for part in parts if isinstance(part, list) for s in part})
        for parts in cut:
            found: list[tuple[str, bytes]] = []
            for part in parts:
                if isinstance(part, list):
                    found += map(memo.__getitem__, part)
                else:
                    found.append((str(part[0]), part[1].encode()))
            yield ",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        special = {i: s.encode() for s, i in self._special.items()}
        return b"".join(special[i] if i in special else self.tokens[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], TrieBPE] = {}


def tokenizer(path: str, pattern: str = public_tokenizers.PATTERN) -> TrieBPE:
    """One for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TrieBPE.load(path, pattern)
    return _loaded[path, pattern]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            found = bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            ids = [list(map(int, i.split(","))) if i else [] for i, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(common.lean(run, ROWS), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(common.lean(run, ROWS), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """SCHEMA: digests of the ids, and of the text that these decode to, without moving either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            counts, digests, back = [], [], []
            for ids, decoded in bpe.encode_batch([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(ids.count(",") + 1 if ids else 0)
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(common.lean(run, ROWS), SCHEMA)


def op13_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
