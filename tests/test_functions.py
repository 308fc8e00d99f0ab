"""Golden values of the scalar expressions, all in a few jobs."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import refdata, text, udfs, units
from tessella.operators import attributes, catalogue
from tessella.sources import providers, tables


def values(spark, make, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.select(make(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_units_and_measurements(spark):
    assert values(spark, units.unit, ["", None, "xyz", "  volts  ", "AMPS", "dba", "kw", "min", '"']) == [None, None, None, "V", "A", "dBA", "kW", "min", "in"]
    assert values(spark, units.normal_measurement, ["24 inches", "120V", "  120   V  ", "120", "99 xyz", "volts"]) == ["24 in", "120 V", "120 V", None, None, None]


def test_fractions(spark):
    got = values(spark, units.to_fraction, [0.0, 0.125, 0.375, 0.5, 0.501, 0.999, 33.4375, 50.25, -1.0, None], "double")
    assert got == ["0", "1/8", "3/8", "1/2", "1/2", "1", "33-7/16", "50-1/4", None, None]
    assert values(spark, units.from_fraction, ["50-1/4", "3/8", "24", "", "50-1/0", "abc"]) == [50.25, 0.375, 24.0, None, None, None]
    every = [w + n / 64 for w in (0, 7) for n in range(64)]
    assert values(spark, lambda c: units.from_fraction(units.to_fraction(c)), every, "double") == every


def test_text(spark):
    assert values(spark, text.clean, [" \t-- UNBRANDED --\n", "N/A", "", " x ", None]) == [None, None, None, "x", None]
    assert values(spark, text.expand_abbreviations, ["3/8 CPLG BRS 150#", "1150#", "SCH 40 elb", "RED hat"]) == ["3/8 Coupling Brass 150 lb", "1150#", "Schedule 40 Elbow", "Reducer hat"]
    assert values(spark, text.singular, ["Dishwashers", "Valves", "Dress", "Bus", "Gas", "Switches"]) == ["Dishwasher", "valve", "Dress", "Bus", "Gas", "switch"]
    assert values(spark, text.clean_number, ["5.0", "4", "x", "2.5", None, "1e3"]) == ["5", "4", "x", "2.5", None, "1000"]
    assert values(spark, text.english_list, [[], ["a"], ["a", "b"], ["a", "b", "c"]], "array<string>") == ["", "a", "a, and b", "a, b, and c"]
    words = " ".join(map(str, range(460)))
    assert [[len(c.split()) for c in x] for x in values(spark, text.chunks, [words, "", " \n "])] == [[460, 10], [], []]


def test_udfs():
    assert udfs.ratio("tide", "diet") == 0.25 and udfs.ratio("diet", "tide") == 0.5 and udfs.ratio("a", "abcdefgh", 0.9) == 0
    assert udfs.page_text("<p>a<script>x()</script> b<nav>n</nav>&amp;</p>") == "a b &"


def test_attribute_normalisation(spark):
    rows = [("Test", "50.25", "inches", 0.9), ("Whole", "24.0", "in", 0.9), ("Voltage Rating", "120", "volts", 0.7), ("Material", "SS", None, 0.9), ("Model", None, None, 0.9), ("Color", "Gunmetal", None, 0.9), ("Weight", "55", "xyz", 0.9), ("Any", "1", None, 0.699), ("Any", "1", None, 0.0)]
    df = spark.createDataFrame([(i, (a, b, c, "http://s", 1, d)) for i, (a, b, c, d) in enumerate(rows)], f"i int, c {attributes.CANDIDATE}")
    got = [(r.a.value, r.a.uom, r.a.lov_matched, r.a.needs_review) for r in df.select("i", attributes.normalise(F.col("c")).alias("a")).orderBy("i").collect()]
    assert got == [("50-1/4", "in", True, False), ("24", "in", True, False), ("120", "V", True, False), ("Stainless Steel", None, True, False), (None, None, False, False), ("Gunmetal", None, False, True), ("55", "xyz", True, True), ("1", None, True, True), ("1", None, True, True)]


def test_headers():
    found = catalogue.map_headers(["Item No", "Product Name", "Brand", "Vendor", "Extra Notes"])
    assert found.mapped == {"Mfg_Part_Num": "Item No", "Part_Desc": "Product Name", "Unilog_Brand": "Brand", "Part_Manuf": "Vendor"} and found.ignored == ["Extra Notes"]
    assert catalogue.map_headers(["Manufacturer Part Number", "Manufacturer"]).mapped == {"Mfg_Part_Num": "Manufacturer Part Number", "Part_Manuf": "Manufacturer"}
    with pytest.raises(ValueError, match="Foo, Bar"):
        catalogue.map_headers(["Foo", "Bar"])
    assert len(refdata.delivery_columns()) == len(set(refdata.delivery_columns())) == 252
    with pytest.raises(ValueError):
        tables.checked_limit("3x")


def test_paced_calls():
    waits, calls = [], []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise providers.Refused(1.0 if len(calls) == 1 else None)
        return "ok"

    run = providers.paced(call, providers.Pacing(interval=0.0), waits.append, lambda: 0.0)
    assert run("p") == "ok" and [w for w in waits if w] == [1.3, 4.0]


def test_flat_exports(spark):
    """Ten columns, commas as semicolons, nothing null."""
    df = spark.sql("SELECT 'M,1' AS mpn, 'a, b' AS part_desc, 'Acme' AS manufacturer_name, CAST(NULL AS STRING) AS brand_name, 'A>B' AS classpath, named_struct('status', 'HIGH', 'overall', 0.9D) AS confidence, array(named_struct('label', 'Size', 'value', '1,5', 'uom', 'in'), named_struct('label', 'Color', 'value', 'red', 'uom', '')) AS attributes, map('SHORT_DESC', 'x') AS descriptions, CAST(NULL AS STRING) AS decision")
    row = tables.export_rows(df).first()
    assert tuple(row) == ("M;1", "a; b", "Acme", "", "A>B", "HIGH", 0.9, "Size:1;5 in | Color:red", '{"SHORT_DESC":"x"}', "")


def test_content_is_required(spark):
    df = spark.createDataFrame([(None, None), (None, "x")], "mpn string, part_desc string")
    assert catalogue.require_some_content(df) is df
    with pytest.raises(ValueError, match="every row lacks"):
        catalogue.require_some_content(df.where("part_desc IS NULL"))


def test_title_case(spark):
    assert values(spark, udfs.title_case, ["3rd x-ray o'neil", None, ""]) == ["3Rd X-Ray O'Neil", None, ""]
