"""Fuzzy and keyword matching against brute force, and the plans they make."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessella.operators import choices, classify, resolve, similar


def key(s):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", s.lower())).strip()


def brute(values, names, k, floor):
    out = {}
    for raw, a in values:
        scored = sorted((-SequenceMatcher(None, a, b).ratio(), ordinal, code) for b, ordinal, code in names)
        out[raw] = [(k_, -s, o, c) for k_, (s, o, c) in enumerate(scored[:k], 1) if -s >= floor]
    return {r: v for r, v in out.items() if v}


def words(n, seed, most=4):
    rnd = random.Random(seed)
    syllables = ["bra", "nd", "ma", "ker", "co", "tool", "é", "works", "1", "22", "x", "日"]
    return ["".join(rnd.choice(syllables) for _ in range(rnd.randint(0, most))) + rnd.choice(["", " inc", " co", " & sons"]) for _ in range(n)]


@pytest.mark.parametrize("k, floor, block, deal", [(1, 0.70, 4096, 20_000), (1, 0.72, 7, 11), (3, 0.4, 16, 50), (5, 0.0, 4096, 60), (2, 1.0, 5, 20_000)])
def test_most_similar_equals_brute_force(spark, k, floor, block, deal):
    values = [(f"v{i}", a) for i, a in enumerate(words(150, 1) + ["", "x" * 250, "ab" * 300])] + [(f"n{i}", a) for i, a in enumerate(words(60, 2)[:20])]
    names = [(b, i, f"c{i}") for i, b in enumerate(words(60, 2) + ["", "x" * 240, "ab" * 290 + "c", "x" * 250])] + [("brand", 900, None), ("brand", 901, "late")]
    rnd = random.Random(3)
    rnd.shuffle(names)
    v = spark.createDataFrame([*values, ("gone", None)], "raw string, a string")
    n = spark.createDataFrame([*names, (None, 1, "gone")], "b string, ordinal int, code string")
    got = {}
    for r in similar.most_similar(v, n, k, floor, block, deal).collect():
        got.setdefault(r.raw, []).append((r.rank, r.score, r.ordinal, r.code))
    assert {raw: sorted(x) for raw, x in got.items()} == brute(values, names, k, floor)


def test_most_similar_of_nothing(spark):
    v, n = spark.createDataFrame([("a", "a")], "raw string, a string"), spark.createDataFrame([("a", 1)], "b string, ordinal int")
    assert similar.most_similar(v.where("false"), n).count() == 0
    empty = similar.most_similar(v, n.where("false"))
    assert empty.count() == 0 and empty.columns == similar.most_similar(v, n).columns


def test_few_exact_similarities_are_worked_out(spark, monkeypatch):
    """The falling bound stops early: far fewer matchers are set than pairs, and all of them give the same as brute force."""
    names = sorted(set(words(400, 5, 6)))
    calls = []
    real = similar.SequenceMatcher

    class Counting(real):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(similar, "SequenceMatcher", Counting)
    strings = [n + "x" for n in names[:100]]
    found = list(similar.best(strings, names, list(range(len(names))), 1, 0.7))
    for s, f in zip(strings, found, strict=True):
        score, at = min((-real(None, s, n).ratio(), i) for i, n in enumerate(names))
        assert f == ([(-score, at)] if -score >= 0.7 else [])
    assert len(calls) < len(strings) * len(names) / 10


def test_no_nested_loops_in_the_plans(spark):
    master = spark.createDataFrame([("Acme", "A", 0), ("Bolt Co", "B", 1)], "name string, code string, ordinal int")
    df = spark.createDataFrame([("acme inc",), ("zzz",)], "raw string")
    tax = spark.createDataFrame([(0, "D", "C", "F", ["bolt", "nut"])], "ordinal int, dept string, class_name string, fine string, keywords array<string>")
    texts = df.withColumnRenamed("raw", "text")
    for out in (resolve.fuzzy(df, master), resolve.resolve(df, "raw", master), classify.by_keywords(texts, tax), classify.by_similarity(texts, tax), classify.classify(texts, "text", tax), choices.options(df, master)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords_equal_brute_force(spark):
    rnd = random.Random(4)
    letters = "abcd "
    entries = [(i, f"D{i % 3}", f"C{i % 5}", f"F{i}", ["".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 4, 6]))) for _ in range(rnd.randint(0, 5))]) for i in range(25)] + [(25, "D", "C", "twice", ["abc", "abc"]), (26, "D", "C", "none", None)]
    texts = sorted({"".join(rnd.choice(letters + "éx") for _ in range(rnd.randint(0, 30))) for _ in range(200)} | {"", "a", "ab", "x" * 5000 + "abc"})
    tax = spark.createDataFrame(entries, "ordinal int, dept string, class_name string, fine string, keywords array<string>")
    got = {r.text: (r.fine, round(r.confidence, 9)) for r in classify.by_keywords(spark.createDataFrame([(t,) for t in texts], "text string"), tax).collect()}
    want = {}
    for t in texts:
        hits, o = max((sum(w in t for w in e[4] or ()), -e[0]) for e in entries)
        if hits:
            want[t] = (entries[-o][3], round(min(0.95, 0.5 + 0.15 * hits), 9))
    assert got == want


MASTER = [("Acme Tools", "A1", 0), ("Acme  tools", "A2", 1), ("Bolt & Sons", None, 2), ("Café Works", "C", 3), ("Zeta", "Z", 4)]
RAWS = ["Acme Tools", " acme TOOLS ", "Acme Toolz", "Bolt and Sons", "cafe works", "nothing like it", None, "  ", "Zta", "ask me", "ask none", "ask wrong"]


def ladder(raw, master, reject, answers):
    raw = (raw or "").strip()
    if not raw:
        return (None, None, 0.0, "unresolved", True)
    named = {n: c for n, c, _ in master}
    if raw in named:
        return (raw, named[raw], 1.0, "exact", False)
    keyed = {}
    for n, c, _ in master:
        keyed.setdefault(key(n), (n, c))
    if key(raw) in keyed:
        return (*keyed[key(raw)], 0.97, "normalized", False)
    score, _, n, c = min((-SequenceMatcher(None, key(raw), key(n)).ratio(), o, n, c) for n, c, o in master)
    if -score >= reject:
        return (n, c, round(-score, 4), "fuzzy", -score < 0.82)
    answer = answers.get(raw, "")
    if key(re.sub(r"^[-•*]\s*", "", answer.strip())) in keyed and answer.strip().upper() != "NONE":
        return (*keyed[key(answer)], 0.80, "llm", False)
    return (None, None, 0.0, "unresolved", True)


@pytest.mark.parametrize("model", [False, True])
def test_resolution_ladder_equals_brute_force(spark, model):
    master = spark.createDataFrame(MASTER, "name string, code string, ordinal int")
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(RAWS * 2)], "id int, raw string, name string")
    answers = {"ask me": " - zeta", "nothing like it": "BOLT & SONS ", "ask none": "none", "ask wrong": "Someone Else"} if model else {}
    table = spark.createDataFrame([*answers.items(), ("ask me", None)], "id string, answer string")
    asked = []

    def choose(questions):
        asked.extend(questions.collect())
        return questions.select("id").join(table, "id")

    out = resolve.resolve(df, "raw", master, choose=choose if model else None)
    got = {r.id: tuple(r.raw_match) for r in out.collect()}
    assert got == {i: ladder(r, MASTER, 0.70, answers) for i, r in enumerate(RAWS * 2)}
    if model:
        assert len({q.id for q in asked}) == len(asked) and all(len(q.options) == len(MASTER) for q in asked)


def test_classification_ladder_asks_the_model_only_when_unsure(spark):
    tax = spark.createDataFrame([(0, "Plumbing", "Valves", "Ball Valves", ["ball valve"]), (1, "Tools", "Hand Tools", "Hammers", ["hammer"]), (2, "Tools", "Saws", "Saws", ["saw"])], "ordinal int, dept string, class_name string, fine string, keywords array<string>")
    df = spark.createDataFrame([(1, "brass ball valve"), (2, "hammers hand tools tools hammmer"), (3, "something odd"), (4, "other odd thing"), (5, "wrong answer"), (6, ""), (7, None), (8, "saws saws tools")], "id int, text string")
    answers = spark.createDataFrame([("something odd", "tools>saws>SAWS"), ("other odd thing", "Plumbing>Valves>Ball Valves"), ("wrong answer", "Food>Fruit>Apples")], "id string, answer string")
    plain = {r.id: (r.classification.fine, r.classification.method, r.classification.needs_review) for r in classify.classify(df, "text", tax).collect()}
    asked = {r.id: (r.classification.fine, r.classification.method, r.classification.needs_review) for r in classify.classify(df, "text", tax, lambda q: q.select("id").join(answers, "id")).collect()}
    assert plain[1] == asked[1] == ("Ball Valves", "keyword", False) and plain[8] == asked[8] == ("Saws", "keyword", False)
    assert asked[3] == ("Saws", "llm", False) and asked[4] == ("Ball Valves", "llm", False)
    assert asked[5] == plain[5] and asked[5][1] != "llm" and asked[5][2]
    assert plain[6] == plain[7] == asked[6] == asked[7] == (None, "unresolved", True)
    assert df.where(F.col("text") == "hammers hand tools tools hammmer").count() == 1 and plain[2][1] == "keyword"
