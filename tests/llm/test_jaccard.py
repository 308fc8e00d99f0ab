import random
import re
from collections import Counter

import pytest

from tessella.llm import jaccard as j


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())


def brute(rows):
    sets, group = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def corpus(seed, families=14):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6)))
    shared = [word() for _ in range(40)]
    texts = [None, "", " \t\n ", "one", "ONE", "one two three", "One two Three", "one two three four", "one two three four five", "x " * 5000]
    for _ in range(families):
        base = [word() for _ in range(rnd.randint(5, 120))]
        if rnd.random() < 0.4:
            base += shared
        for _ in range(rnd.randint(1, 14)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 30))):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own).upper() if rnd.random() < 0.1 else " ".join(own))
    rnd.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("settings", [j.Settings(), j.Settings(often=2, lot=3, part=5, carried=1, block=4, leaf=1), j.Settings(often=0, lot=2, part=2, carried=1, block=2, leaf=1)])
def test_equals_brute_force(spark, settings):
    rows = corpus(3) + [(7, "one two three four five"), (7, "another text with that id here"), (None, "x " * 5000), (None, "only null id one two"), (101, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    got = Counter(map(tuple, j.join(docs, settings).collect()))
    assert got == brute(rows)


def test_empty_and_linkless(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert j.join(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "f g h i j")], "doc_id long, text string")
    assert sorted(map(tuple, j.join(docs).collect())) == [(1, 2, 1), (2, 0, 2), (3, 2, 3)]


def test_tree_keeps_every_link():
    import numpy as np

    rnd = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = rnd.integers(0, 2**63, size=rnd.integers(1, 900)).astype(np.uint64)
        for _ in range(6):
            own = base.copy()
            own[: len(own) // rnd.integers(8, 40)] = rnd.integers(0, 2**63)
            sets.append(np.unique(own))
    bits, n = np.stack([j.bitmap(s) for s in sets]), np.array([len(s) for s in sets])
    found = {frozenset(p) for p in j.SignatureTree(bits, n, 85, 4).pairs(lambda i: i)}
    links = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if j.linked(sets[a], sets[b], 85)}
    assert links <= found and len(found) < len(sets) ** 2 / 10


def test_components_of_a_long_chain(spark):
    from tessella.llm import common

    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (200, 200)], "u long, v long")
    got = {r.u: r.c for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_stage_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    own = "doc_id long, text string, lang string, _hash string, _none string, _id string, _word string, _set string"
    docs = spark.createDataFrame([(*r, *["x"] * 5) for r in [(5, text, "a"), (3, text + " end", "b"), (9, "quite another text that stays", "c"), (8, None, None), (3, text + " end", "b"), (3, "the same id and quite other words", "b"), (None, text, "z")]], own)
    out = j.stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 3, 8, 9]
