import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import common, fm
from tessella.llm import substring as s


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {i + o for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for o in range(width)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5)))
    passages = [[word() for _ in range(rnd.randint(30, 120))] for _ in range(8)]
    texts = [None, "", "a", "x " * 400, " ".join(f"{i % 40}" for i in range(200)), "  \x1f" * 40]
    for _ in range(90):
        own = [word() for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 2)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.5:
                p[rnd.randrange(len(p))] = word()
            own = own[: len(own) // 2] + p[rnd.randrange(9) :] + own[len(own) // 2 :]
        texts.append(rnd.choice([" ", "\n", " \t "]).join(own))
    return texts + texts[20:25]


@pytest.mark.parametrize("settings", [s.Settings(), s.Settings(width=9, anchor=3, shard=200, wide=2), s.Settings(width=35, anchor=6, shard=1, wide=1)])
def test_equals_brute_force(spark, settings):
    texts = corpus(1)
    docs = spark.createDataFrame([(None if i == 30 else i // 2 if i < 20 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, id int").repartition(5)
    got = Counter((r.n_words, r.n_removed, bytes(r.kept)) for r in s.removed(docs, settings).collect())
    assert got == Counter(brute(texts, settings.width))


def test_empty_table(spark):
    assert s.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_counts_places():
    rnd = np.random.default_rng(3)
    text = np.concatenate([np.append(rnd.integers(1, 6, 300), 0) for _ in range(4)])
    index = fm.FMIndex(text, np.ones(len(text), np.int64), 40)
    plain = text.tolist()
    for _ in range(300):
        k, at = rnd.integers(1, 9), rnd.integers(0, len(text) - 10)
        pattern = plain[at : at + k]
        if 0 in pattern:
            continue
        low, high = np.zeros(1, np.int64), np.full(1, len(text))
        for c in pattern[::-1]:
            low, high = index.step(low, high, np.array([c]))
        assert high[0] - low[0] == sum(plain[i : i + k] == pattern for i in range(len(plain) - k + 1))


def test_masks_equal_counting():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        segs = [rnd.integers(1, 3, rnd.integers(6, 24)) for _ in range(12)]
        weights = 1 + (rnd.random(12) < 0.2)
        seen = Counter()
        for x, w in zip(segs, weights.tolist()):
            for i in range(len(x) - 5):
                seen[tuple(x[i : i + 6])] += w
        want = [sum(1 << i for i in range(len(x) - 5) if seen[tuple(x[i : i + 6])] > 1) for x in segs]
        assert fm.repeated_windows(segs, weights, 6) == want


def test_stage(spark):
    p = " ".join(f"p{i}" for i in range(40))
    own = "doc_id long, text string, lang string, n_chars long, id string, found string, _at string, _id string, _word string, `a.b` string"
    docs = spark.createDataFrame([(*r, *["x"] * 6) for r in [(1, "start " + p + "\nend", "en", 1), (2, p, None, 2), (3, "clean\n text", "fr", 11), (4, None, None, None)]], own)
    out = s.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("start end", 9), 2: ("", 0), 3: ("clean\n text", 11), 4: (None, None)}


@pytest.mark.parametrize("settings", [s.Settings(width=4, anchor=2, shard=1, wide=3), s.Settings(width=4, anchor=2, shard=50, wide=3), s.Settings(width=4, anchor=2)])
def test_many_equal_rows_hide_no_repeat_of_others(spark, settings):
    """One row 40 times, beside others that share a passage with it or only with each other."""
    shared, lone = "a b c d e f", "p q r s t u"
    rows = [(1, f"x1 {shared} y1")] * 40 + [(2, f"k1 {shared} k6"), (3, f"k2 {shared} k7"), (4, f"m1 {lone} m2"), (5, f"m3 {lone} m4")] + [(6, " ".join(f"w{i}" for i in range(9)))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r.n_words, r.n_removed, bytes(r.kept)) for r in s.removed(docs, settings).collect())
    assert got == Counter(brute([t for _, t in rows], settings.width))


def test_text_hashes_follow_the_words():
    """Equal words have equal hashes wherever they stand, different words different ones, at all lengths."""
    rnd = random.Random(8)
    words = sorted({bytes(rnd.choice([0, 1, 97, 98, 200, 255]) for _ in range(rnd.choice([1, 2, 7, 8, 9, 16, 17, 40, 255, 256, 257, 300]))) for _ in range(3000)} | {b"a" * k for k in range(1, 600)} | {b"\x00" * k for k in range(1, 40)})
    seen = dict(zip(words, common.text_hashes(b" ".join(words)).tolist(), strict=True))
    assert len(set(seen.values())) == len(words)
    for _ in range(300):
        text = b"".join(rnd.choice(words) + rnd.choice([b" ", b"\n", b"\t\r ", b"\x0b\x0c"]) for _ in range(rnd.randint(0, 12)))
        text = rnd.choice([b"", b" ", b"\n "]) + text
        assert common.text_hashes(text).tolist() == [seen[w] for w in text.split()]
    assert len(common.text_hashes(b"")) == len(common.text_hashes(b" \n")) == 0
