import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library():
    rnd, lib, own = random.Random(3), library(), p.WordEncoder(PATH)
    sets = ["abc ", "ABÇé \n", "'s 't'll ", "12 3", "\t\r\x0b\x0c\x1c\x85   x", "日本 é ́a", "<|endoftext|> ΑΣ İ ", "ÉÇßÿŸŁłǅǆÑñaB", "ʰːǀªºµ"]
    texts = ["", " ", "\n\n", "<|endoftext|>", "z" * 5000] + ["".join(rnd.choice(rnd.choice(sets)) for _ in range(rnd.randint(0, 70))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_assign_is_gapless_and_full():
    rnd = random.Random(4)
    for k in range(60):
        sizes = [rnd.choice([1, 5, 70, 900, 2047, 2048, 2049, 9000]) + rnd.randint(0, 30) for _ in range(k)]
        seqs, docs = defaultdict(list), defaultdict(list)
        for d, start, n, s, at in p.assign(sizes):
            seqs[s].append((at, n))
            docs[d].append((start, n))
        for pieces, want in [(seqs[s], c) for s, c in enumerate(p.capacities(sum(sizes)))] + [(docs[d], n) for d, n in enumerate(sizes)]:
            end = 0
            for at, n in sorted(pieces):
                assert at == end and n > 0
                end += n
            assert end == want
        assert len(seqs) == len(p.capacities(sum(sizes)))
        assert all(sum(n for _, n in v) & (sum(n for _, n in v) - 1) == 0 for v in seqs.values())


def test_lowest_cost_takes_the_next_document():
    by = defaultdict(list)
    for d, _, n, s, _ in p.assign([1500, 1400, 500, 400, 148, 148]):
        by[s].append(n)
    assert sorted(map(sorted, by.values())) == [[148, 400, 1500], [148, 500, 1400]]


def test_table(spark):
    rows = [(0, None), (1, ""), (2, "a b c" * 900), (2, "a b c" * 900), (None, "x"), (3, "w" * 50_000)] + [(i, "the quick brown fox " * (i % 60)) for i in range(4, 120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    out = p.digests(p.pack(docs, PATH, group_tokens=4096)).collect()
    lib, ids = library(), defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    assert sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0
    assert p.pack(docs.where("false"), PATH).count() == 0


def test_marks_and_combining_letters_equal_the_library():
    lib, own = library(), p.WordEncoder(PATH)
    marks = ("<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endof text|>", "<endoftext>")
    texts = [f"hello {m} world" for m in marks] + [f"a{m}B." for m in marks] + [m + m for m in marks] + ["\u0130.", "\u0130,", "x\u0130. y", "\u0958.", "e\u0301.", "\u2126,", "\ufb01.", "\u00e9.", "5.", "\u00b2,", "\u0149.", "Don't. 'S, !'s."]
    rnd = random.Random(8)
    letters = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x250), 0x130, 0x130, 0x307, 0x301, 0x345, 0x958, 0x3A3, 0x1E9E, 0x2126, 0x212B, 0x660, 0xFB1D, 0x1F88)] + [".", ",", " ", ". ", ", "] * 12 + list(marks[:2])
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 24))) for _ in range(40_000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == e.ids, repr(t)


def test_every_capital_with_every_mark_equals_the_library():
    lib, own = library(), p.WordEncoder(PATH)
    pairs = [chr(c) + chr(m) for c in (*range(65, 91), *range(97, 123), 0xC0, 0xD8, 0x130, 0x3A9) for m in range(0x300, 0x370)]
    marks = "\u0308\u0301\u0331\u030c\u030a\u0327\u0323\u0307"
    pairs += [chr(c) + a + b for c in range(65, 91) for a in marks for b in marks]
    texts = pairs + [f"In {x}otem, {x}. a{x}b {x}{x}\n{x}, end" for x in pairs]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == e.ids, repr(t)
