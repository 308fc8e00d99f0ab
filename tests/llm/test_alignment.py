import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, trie

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SETS = ["aetnorsi", "ab", "0123456789", "éàü ñ", "{}();=\n\t ", "日本語한글\U0001f600", "the of and ing ", "\x1c\x85\xa0᠎ \n 　", "'s't're!?", "▁ﬁ  "]
EDGE = ["", None, "▁", "a ▁b", "<|endoftext|><s></s><0x41>", " ", "\n", " \na", "  a  b ", "x" * 5000, "日" * 800, "a\nb\n\nc \n d", "\u0000x"]


def brute(rows):
    """By byte offsets, all pairs compared."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names = {i: t for t, i in a.get_vocab().items()}
    found, docs = [], Counter()
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xb = [trie.shown_bytes(names[i]) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(xb) == b"".join(yb) == (" " + text).encode():
            found.append((doc_id, [], [], [], Counter()))
            continue
        spans = []
        for tokens in (xb, yb):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = Counter((x[i], y[j]) for i, (s, e) in enumerate(spans[0]) for j, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e)
        docs.update(links.keys())
        groups, start = [], 0
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if start <= s and e <= end) for ids, own in ((x, spans[0]), (y, spans[1]))))
            start = end
        found.append((doc_id, x, y, groups, links))
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, x, y, groups, links in found:
        out.append((doc_id, len(x), len(y), len(groups), sum(links.values()), sum(n for p, n in links.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def random_texts(n, most=60):
    rnd = random.Random(4)
    return ["".join(rnd.choice(rnd.choice(SETS)) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_ids_of_texts_are_those_of_their_segments():
    own = alignment.aligner(A, B)
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    texts = [t for t in EDGE if t] + [t for t in random_texts(8000, 90) if t]
    for t, (written, n_a, n_b, _) in zip(texts, own.documents(texts), strict=True):
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        if "▁" in t:
            assert not written
            continue
        groups = [g.split("|") for g in written.split(";")]
        assert ",".join(g[0] for g in groups) == ",".join(map(str, x)) and ",".join(g[1] for g in groups) == ",".join(map(str, y)), repr(t)
        assert (n_a, n_b) == (len(x), len(y))


def test_transducer():
    t = alignment.Transducer({0: b"ab", 1: b"c", 2: b"a", 3: b"bcd"}, {0: b"a", 1: b"bc", 2: b"abc", 3: b"d"})
    assert t.align([0, 1], [0, 1]) == ([([0, 1], [0, 1])], [(0, 0), (0, 1), (1, 1)])
    assert t.align([2, 3], [2, 3]) == ([([2, 3], [2, 3])], [(2, 2), (3, 2), (3, 3)])
    assert t.align([2, 2], [0, 0]) == ([([2], [0]), ([2], [0])], [(2, 0), (2, 0)])
    assert t.align([], []) == ([], [])
    assert t.align([1], [0]) is None and t.align([0], [0]) is None and t.align([2], [0, 0]) is None


@pytest.mark.parametrize("block", [alignment.BLOCK, 40])
def test_table(spark, block):
    texts = EDGE + random_texts(150) + ["the same text"] * 30 + [("the of and  to\n" * 40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "the")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    assert sorted(map(tuple, alignment.align(docs, A, B, block).collect()), key=str) == brute(rows)
    assert alignment.align(docs.where("false"), A, B).count() == 0
    assert alignment.align(docs.where("text is null"), A, B).collect()[0].groups_sha256 == ""


def test_groups_are_columns(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in alignment.groups(docs, A, B).collect()}
    lib, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert got[2] == [] and [i for a, _ in got[1] for i in a] == lib.encode(" the cat").ids and [i for _, b in got[1] for i in b] == sp.encode("the cat")


def test_rows_hold_one_document_or_one_dictionary(spark):
    # A whole block in one row made Parquet's readers hold thousands of blocks at once.
    texts = random_texts(60) + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = alignment.blocks(docs, A, B).collect()
    own, pairs = [r for r in rows if r.pairs is None], {r.block: r for r in rows if r.pairs is not None}
    assert sorted(r.doc_id for r in own) == list(range(62)) and len(pairs) == 2
    for block, r in pairs.items():
        held = Counter(e for x in own if x.block == block for e in x.entry)
        assert [held[k] for k in range(len(r.pairs))] == r.docs and r.pairs == sorted(set(r.pairs))
    assert all(len(r.entry) == len(set(r.entry)) == len(r.times) and (r.n_a > 0) == bool(r.entry) for r in own)
