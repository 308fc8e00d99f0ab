import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import segments, trie

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGE = ["", None, "<|endoftext|> it's<|endoftext|>", "<|endoftext|", " " * 5000, "a" * 20_000, "ab" * 9_000, "=" * 700, "é日本語\u0000\x1f  \U0001f600", "x\ty\r\n\n z", "x", "a᠎ ᠎ b\n᠎ c", "\n \n"]
SETS = ["aetnorsi", "ab", "0123456789", "éàü ñ", "{}();=\n\t ", "日本語한글", "the of and ing ", "\x1c\x85\xa0᠎ \n 　", "'s't're!?"]


@pytest.fixture(scope="module")
def pair():
    return trie.tokenizer(PATH), Tokenizer.from_file(PATH)


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(rnd.choice(SETS)) for _ in range(rnd.randint(0, 90))) for _ in range(n)]


def test_segments_are_the_text():
    for t in [t or "" for t in EDGE] + random_texts(4000):
        assert "".join(segments.segments(t)) == t
    assert segments.segments("a b\nc  d e ") == ["a", " b", "\nc  d", " e "]


def test_memo_forgets_and_keeps_right():
    solved = []
    memo = segments.Memo(lambda ws: (solved.append(list(ws)), [w.upper() for w in ws])[1], limit=3, longest=5)
    for words in ({"a", "b", "toolong"}, {"a", "c"}, {"d", "e"}, {"a", "f"}, {"toolong"}):
        got = memo.of(words)
        assert all(got[w] == w.upper() for w in words)
    assert sum(ws.count("toolong") for ws in solved) == 2 and sum(ws.count("a") for ws in solved) == 1


def test_equals_the_library(pair):
    own, lib = pair
    texts = [t or "" for t in EDGE] + random_texts(6000)
    for t, (ids, back), e in zip(texts, own.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == ",".join(map(str, e.ids)), repr(t[:80])
        assert back.decode("utf-8", "replace") == lib.decode(e.ids, skip_special_tokens=False) == own.decode(e.ids)


def test_every_character_equals_the_library(pair):
    own, lib = pair
    # Beyond U+3400 the properties come in long ranges: every 16th character there.
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 16 == 5)]
    for k in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}b {chr(c)}  {chr(c)}\n{chr(c)}1" for c in points[k : k + 50_000]]
        for t, (ids, _), e in zip(texts, own.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids == ",".join(map(str, e.ids)), repr(t)


def test_trie_shares_beginnings():
    words = [b"then", b"the", b"there", b"a", b"the\0", b"x" * 40, b"x" * 40 + b"y"]
    order = list(trie.preorder(words))
    assert [w for w, _ in order] == sorted(words)
    for (before, _), (word, shared) in zip(order, order[1:], strict=False):
        assert word[:shared] == before[:shared] and (shared == trie.WIDTH or shared == min(len(word), len(before)) or word[shared] != before[shared])
    assert order[0][1] == 0 and list(trie.preorder([])) == []


def test_broken_ids_decode_as_the_library(pair):
    own, lib = pair
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(50257), rnd.randrange(256), 50256]) for _ in range(rnd.randint(0, 12))]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_other_settings_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        t = json.load(f)
    t["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(t))
    with pytest.raises(ValueError):
        trie.TrieBPE.load(str(tmp_path / "t.json"), public_tokenizers.PATTERN)


def test_table(spark, pair):
    rows = [(i, t, 7) for i, t in enumerate(EDGE)] + [(3, "x", 8), (3, "x", 8), (None, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, trie.round_trip(docs, PATH).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert trie.round_trip(docs.where("false"), PATH).count() == 0
    back = trie.decode(trie.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)
