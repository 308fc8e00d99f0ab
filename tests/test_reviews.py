"""The review stream against the batch replay, and both against a plain loop."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessella.operators import review
from tessella.streaming import reviews

START = datetime(2024, 5, 1)


def rows(seed, n=160):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        decision = rnd.choice(["accept", "reject", "edit", "edit", "edit", "maybe", None])
        key = rnd.choice(["a", "b", "c", "d", "zzz", None, " "])
        at = None if rnd.random() < 0.05 else START + timedelta(hours=rnd.randint(0, 40))
        edit = decision == "edit"
        out.append((key, decision, at, seq, json.dumps([seq]) if edit and rnd.random() < 0.5 else None, json.dumps({"d": str(seq)}) if edit and rnd.random() < 0.5 else None))
    return out + out[:5]  # some come twice


PRODUCTS = [("a", "[0]", '{"d": "a"}', "P>A"), ("b", None, '{"d": "b"}', "P>B"), ("c", "[2]", None, "P>C"), ("quiet", "[3]", "{}", "P>Q"), ("d", "[1]", "{}", "P>D")]


def plain(events):
    state = {k: [a, d, c, None, None] for k, a, d, c in PRODUCTS}
    dead = []
    for key, decision, at, seq, attributes, descriptions in sorted(events, key=lambda e: (e[2] or START, e[3])):
        error = "no key" if not (key or "").strip() else "bad decision" if decision not in ("accept", "reject", "edit") else "no time" if at is None else "unknown key" if key not in state else None
        if error:
            dead.append((str(key), str(decision), seq, error))
            continue
        if decision == "edit":
            state[key][0] = attributes or state[key][0]
            state[key][1] = descriptions or state[key][1]
        state[key][3:] = [decision, at]
    return state, sorted(dead)


def frames(spark, events):
    return spark.createDataFrame(events, reviews.EVENT), spark.createDataFrame(PRODUCTS, "key string, attributes string, descriptions string, classpath string")


def test_replay_equals_a_plain_loop_in_any_order(spark):
    for seed in range(3):
        events = rows(seed)
        state, dead = plain(events)
        random.Random(seed).shuffle(events)
        e, p = frames(spark, events)
        assert {r.key: [r.attributes, r.descriptions, r.classpath, r.decision, r.at] for r in review.replay(p, e).collect()} == state
        assert sorted((str(r.key), str(r.decision), r.seq, r.error) for r in review.dead_letters(p, e).collect()) == dead


def test_stream_of_shuffled_late_events_equals_replay(spark, tmp_path):
    events = rows(9)
    state, dead = plain(events)
    random.Random(1).shuffle(events)
    e, p = frames(spark, events)
    for k in range(3):
        frames(spark, events[k::3])[0].coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(reviews.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    before = spark.conf.get(reviews.STORE[0])
    try:
        for _ in range(2):  # the second run has nothing new, and goes on from the stored state
            reviews.keep_reviews(stream, p, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
    finally:
        spark.conf.set(reviews.STORE[0], before)
    got = {r.key: [r.attributes, r.descriptions, r.decision, r.at] for r in reviews.current_reviews(spark, str(tmp_path / "out")).collect()}
    assert got == {k: [a, d, x, at] for k, (a, d, _, x, at) in state.items() if x}
    letters = [(json.loads(r.event), r.error) for r in spark.read.parquet(str(tmp_path / "dead")).collect()]
    assert sorted((str(x["key"]), str(x["decision"]), x["seq"], error) for x, error in letters) == dead


def test_edit_diff_marks_what_changed(spark):
    old = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(v).alias("value"), F.lit(u).alias("uom")) for n, v, u in (("Size", "1", "in"), ("Color", "red", None), ("Weight", "2", "lb"))))
    new = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(v).alias("value"), F.lit(u).alias("uom")) for n, v, u in (("Color", "blue", None), ("Size", "1", "in"), ("Unknown", "7", None))))
    merged, changed = review.edit_diff(old, new)
    row = spark.range(1).select(merged.alias("m"), changed.alias("n")).first()
    assert [(a.label, a.value, a.uom, a.edited) for a in row.m] == [("Size", "1", "in", False), ("Color", "blue", None, True), ("Weight", "2", "lb", False)] and row.n == 1
