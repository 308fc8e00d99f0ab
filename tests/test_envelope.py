"""Envelopes, positions and facts."""

import random

from pyspark.sql import functions as F

from tessella.operators import attributes, choices, positions
from tessella.plans import envelope


def _read(text):
    if text == "boom":
        raise ValueError("can't read this")
    return None if text is None else text.upper()


def stages():
    return [
        envelope.Stage("input", lambda df: df.withColumn("n", F.col("a").cast("int")), lambda df: F.when(F.expr("try_cast(a AS int) IS NULL"), "a is no number")),
        envelope.rowwise("reading", _read, ["b"], "read", "string"),
        envelope.Stage("dividing", lambda df: df.withColumn("share", 100 / F.col("n")), lambda df: F.when(F.col("n") == 0, "n is 0")),
        envelope.rowwise("texts", lambda n, read: [read] * n if n < 50 else 1 / 0, ["n", "read"], "texts", "array<string>"),
    ]


def test_each_stage_isolates_its_faults(spark):
    rows = [("1", "x"), ("z", "boom"), ("2", "boom"), ("0", "y"), ("60", "z"), (None, None), ("3", None)]
    df = spark.createDataFrame([(i, a, b, "kept") for i, (a, b) in enumerate(rows)], "row_index long, a string, b string, c string").repartition(3)
    done = envelope.through(df, stages())
    good = {r.row_index: (r.n, r.read, r.share, r.texts, r.c) for r in envelope.products(done).collect()}
    assert good == {0: (1, "X", 100.0, ["X"], "kept"), 6: (3, None, 100 / 3, [None] * 3, "kept")}
    bad = envelope.quarantine(done)
    assert bad.columns == ["row_index", "stage", "reason", "a", "b", "c"]
    assert {r.row_index: (r.stage, r.reason.split(":")[0], r.a, r.b, r.c) for r in bad.collect()} == {
        1: ("input", "a is no number", "z", "boom", "kept"),
        2: ("reading", "ValueError", "2", "boom", "kept"),
        3: ("dividing", "n is 0", "0", "y", "kept"),
        4: ("texts", "ZeroDivisionError", "60", "z", "kept"),
        5: ("input", "a is no number", None, None, "kept"),
    }
    assert envelope.through(df.where("false"), stages()).count() == 0


def test_positions_in_files_and_partitions(spark, tmp_path):
    rows = [(f"r{i}",) for i in range(1000)]
    spark.createDataFrame(rows, "v string").coalesce(1).write.csv(str(tmp_path / "c"))
    got = {r._c0: r.row_index for r in positions.row_index(spark.read.csv(str(tmp_path / "c"))).collect()}
    assert got == {f"r{i}": i for i in range(1000)}
    stored = spark.createDataFrame(rows, "v string")
    assert sorted(r.row_index for r in choices.row_index(stored).collect()) == list(range(1000))
    assert choices.row_index(stored.where("false")).count() == 0


def test_ordered_positions_and_tables_side_by_side(spark):
    rnd = random.Random(3)
    values = [rnd.randint(0, 10**6) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(6)
    left = positions.ordered_index(df, "v", "i")
    assert [r.i for r in left.orderBy("row_index").collect()] == [i for i, _ in sorted(enumerate(values), key=lambda x: (x[1], x[0]))]
    right = positions.ordered_index(df.select((-F.col("v")).alias("w"), "i").limit(1200), "w", "i")
    both = positions.side_by_side(left, right)
    assert both.count() == 1200 and "Window" not in both._jdf.queryExecution().executedPlan().toString()
    assert positions.side_by_side(left, right.where("false")).count() == 0


def test_facts_become_candidates(spark):
    """A starter's facts: its kind is no attribute, units stand apart, extras come last."""
    known = F.create_map(*(F.lit(x) for x in ("product_type", "Motor Starter", "series", "3RV2", "material", "Polyamide", "voltage", "400 V", "amperage", "2.8-4 A", "size", " ")))
    extras = F.create_map(*(F.lit(x) for x in ("terminal_type", "Screw terminals", "dimensions", "45 x 97 x 73 mm")))
    row = spark.range(1).select(attributes.from_description(known, extras).alias("c"), attributes.from_description(F.create_map().cast("map<string,string>")).alias("none")).first()
    assert [(c.label, c.candidate_value, c.candidate_uom) for c in row.c] == [("Material", "Polyamide", None), ("Voltage", "400", "V"), ("Amperage", "2.8-4", "A"), ("Series", "3RV2", None), ("Terminal Type", "Screw terminals", None), ("Dimensions", "45 x 97 x 73 mm", None)]
    assert all(c.source is None and c.source_page is None and c.confidence == 0.35 for c in row.c) and row.none == []
