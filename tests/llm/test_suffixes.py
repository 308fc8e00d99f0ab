from collections import Counter

import numpy as np
import pytest

from tessella.llm import common, substring, suffixes

from .test_substring import corpus


def brute(text_words, seen, width):
    gone = sorted({i + o for i in range(len(text_words) - width + 1) if seen[tuple(text_words[i : i + width])] > 1 for o in range(width)})
    spans, start = [], None
    for i, x in enumerate(gone):
        if i == 0 or gone[i - 1] != x - 1:
            start = x
        if i + 1 == len(gone) or gone[i + 1] != x + 1:
            spans.append((start, x + 1))
    return len(text_words), len(gone), tuple(spans)


@pytest.mark.parametrize("settings", [suffixes.SETTINGS, substring.Settings(width=9, anchor=3, shard=200, wide=2), substring.Settings(width=20, anchor=5, shard=1)])
def test_equals_brute_force(spark, settings):
    texts = corpus(2)
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + settings.width]) for w in words for i in range(len(w) - settings.width + 1))
    docs = spark.createDataFrame([(None if i == 30 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(5)
    got = Counter((r.n_words, r.n_repeated, tuple((x.start, x.end) for x in r.spans)) for r in suffixes.passages(docs, settings).collect())
    assert got == Counter(brute(w, seen, settings.width) for w in words)


def test_neighbours_equal_counting():
    rnd = np.random.default_rng(6)
    s = substring.Settings(width=9, anchor=2)
    for _ in range(80):
        alphabet = [b"a", b"b", b"c"]
        segs = []
        for _ in range(14):
            words = [alphabet[i] for i in rnd.integers(0, 3, 30)]
            first, count, anchor, _ = substring.segments(words, s)
            k = int(rnd.integers(len(first)))
            segs.append((int(anchor.view(np.int64)[k]), words[first[k] : first[k] + count[k] + 8]))
        weights = 1 + (rnd.random(14) < 0.2)
        seen = Counter()
        for (_, w), times in zip(segs, weights.tolist()):
            for i in range(len(w) - 8):
                seen[tuple(w[i : i + 9])] += times
        want = [sum(1 << i for i in range(len(w) - 8) if seen[tuple(w[i : i + 9])] > 1) for _, w in segs]
        assert suffixes.by_neighbours(segs, weights, s) == want


def test_empty_table(spark):
    assert suffixes.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert common.partitions(spark) == 4


@pytest.mark.parametrize("settings", [substring.Settings(width=4, anchor=2, shard=1, wide=3), substring.Settings(width=4, anchor=2)])
def test_many_equal_rows_hide_no_repeat_of_others(spark, settings):
    shared = "a b c d e f"
    rows = [(1, f"x1 {shared} y1")] * 40 + [(2, f"k1 {shared} k6"), (3, f"k2 {shared} k7")]
    words = [t.encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + settings.width]) for w in words for i in range(len(w) - settings.width + 1))
    got = Counter((r.n_words, r.n_repeated, tuple((x.start, x.end) for x in r.spans)) for r in suffixes.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), settings).collect())
    assert got == Counter(brute(w, seen, settings.width) for w in words)
