import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessella.llm import divergence as d


def brute(rows, least=10, top=10):
    words, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for w in found:
            words[lang, source, w] += 1
        for w in set(found):
            docs[lang, w] += 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = [s for x, s in groups if x == lang]

        def share(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept}

        counts = {s: defaultdict(int, {w: words[lang, s, w] for w in kept}) for s in sources}
        p = {s: share(c) for s, c in counts.items()}
        q = share(defaultdict(int, {w: sum(c[w] for c in counts.values()) for w in kept}))
        for s in sources:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def sample(n=400, sources=7):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abéÀZz日") for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice([None, "", *map(str, range(sources))]) if rnd.random() < 0.6 else "hot", " 1-".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for _ in range(n)]
    # Ties, repeated rows, a source without terms, a language without kept terms, an empty and a very long text.
    return rows + rows[:20] + [("en", "mute", None), ("en", "mute", "12 34"), ("xx", "a", "one two"), ("xx", "b", None), ("yy", "lone", "x"), ("de", "é", ""), ("de", "long", "wort Wort " * 20_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 3) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n int").repartition(3)


def result(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"entries": 10, "terms": 64, "cells": 64, "tile": 4}])
def test_equals_brute_force(spark, settings):
    rows = sample()
    assert result(d.audit(frame(spark, rows), **settings)) == brute(rows)


def test_sql_equals_brute_force(tmp_path):
    rows = sample(120, 4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)])
    got = con.execute(d.SQL).fetchall()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_empty(spark):
    empty = frame(spark, sample(20)).where("false")
    assert result(d.audit(empty)) == []
    assert result(d.audit(frame(spark, [("en", "a", None), ("en", "b", None)]))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    rnd = random.Random(1)
    for _ in range(2000):
        total = rnd.randint(1, 9 * 10**15)
        count = rnd.randint(0, total)
        assert d.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
