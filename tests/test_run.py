"""Readers, sinks, safe runs, the command line and streams, on small rows."""

import json
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from tessella import __main__ as cli
from tessella.functions.units import controlled_value
from tessella.operators import attributes, choices, positions
from tessella.plans import run, standin
from tessella.plans.enrich import References, Services
from tessella.sources import excel, providers, snapshots, tables
from tessella.streaming import jobs

HEADER = "Mfg_Part_Num,Part_Desc,E1_Brand,Unilog_Brand,DIB_Brand,Part_Manuf\n"


def test_command_line_isolates_bad_rows(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text(HEADER + "0012,steel bolt M8,,ACME,,ACME Corp\n ,  ,,,,\nP2,vlv sst,,,,\nP3,late,,,,\n")
    standin.taxonomy(spark).write.parquet(str(tmp_path / "tax"))
    (tmp_path / "master.csv").write_text("Manufacturer Name,Manufacturer Code,Brand Name,Brand Code\nAcme Corporation,M1,Acme,B1\nOther,M2,,\nACME corp.,M3,Zed,B3\n")
    out = str(tmp_path / "out")
    cli.main([str(tmp_path / "in.csv"), str(tmp_path / "tax"), out, "--limit", "3", "--master", str(tmp_path / "master.csv"), "--delivery", str(tmp_path / "csv"), "--snapshot", str(tmp_path / "snap")])
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["products"] == 2 and report["errors"] == 1
    rows = {r.mpn: r for r in spark.read.json(out).collect()}
    assert set(rows) == {"0012", "P2"} and rows["0012"].classpath == "Hardware>Fasteners>Bolts" and rows["0012"].row_id == "0"
    assert (rows["0012"].manufacturer_name, rows["0012"].brand_name) == ("ACME corp.", "Acme")
    assert [(r.row_index, r.stage, r.reason) for r in spark.read.json(out + "-errors").collect()] == [(1, "input", "neither part number nor description")]
    delivered = spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=False)
    assert delivered.columns == tables.read_headers(spark, None)
    assert [(r.Mfg_Part_Num, r.Classpath, r.BRAND_NAME) for r in delivered.collect()] == [("0012", "Hardware>Fasteners>Bolts", "Acme"), (None, None, None), ("P2", "Plumbing>Valves>Valves", None)]
    version = snapshots.current(spark, str(tmp_path / "snap"))
    assert sorted(p.name for p in (tmp_path / "snap" / version).iterdir()) == ["delivery", "errors", "metrics", "products"]
    assert spark.read.parquet(snapshots.folder(spark, str(tmp_path / "snap"), "metrics")).first().products == 2


def workbook(path, rows):
    """A small workbook: shared, inline and rich strings, numbers, booleans, errors, gaps."""
    cells, shared = [], []
    for r, row in enumerate(rows, 1):
        out = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if isinstance(v, bool):
                out.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                out.append(f'<c r="{at}"><v>{v!r}</v></c>')
            elif isinstance(v, tuple):
                out.append(f'<c r="{at}" t="{v[0]}">{v[1]}</c>')
            elif v is not None:
                shared.append(v)
                out.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
        cells.append(f'<row r="{r}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Parts" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="t" Target="worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>{"".join(f"<si><t>{escape(s)}</t></si>" if s != "rich" else "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>" for s in shared)}</sst>')
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    rows = [["MPN", "Description", None, "Maker"], ["007", "a <bolt> & \u00e9 ", 12, True], [], [15, None, 2.5, False], [("inlineStr", "<is><t>in line</t></is>"), "rich", 3.0, ("e", "<v>#N/A</v>")], [None, None, None, ("str", "<v>formula</v>")]]
    workbook(path, rows + [[f"P{i}", f"text {i}"] for i in range(5000)])
    got = excel.read_xlsx(spark, path)
    assert got.columns == ["MPN", "Description", "Unnamed: 2", "Maker"] and got.count() == 5004
    assert [tuple(r) for r in got.take(4)] == [("007", "a <bolt> & \u00e9 ", "12", "True"), ("15", None, "2.5", "False"), ("in line", "rich", "3", None), (None, None, None, "formula")]
    catalogue, report = tables.read_catalogue(spark, path)
    assert catalogue.select("Mfg_Part_Num", "Part_Desc").first() == ("007", "a <bolt> & \u00e9 ") and report.mapped["Part_Manuf"] == "Maker"
    assert [r.Mfg_Part_Num for r in tables.first_rows(positions.row_index(catalogue), "row_index", 3).collect()] == ["007", "15", "in line"]
    with pytest.raises(ValueError, match="no rows"):
        tables.require_rows(catalogue.where("false"))


def test_a_model_fills_the_seams(spark):
    """Stubs for all services: understanding, names, classes; each question is asked once."""
    rows = spark.createDataFrame([("A1", "mystery cplg 150#", "Acmee Tols"), ("A2", "mystery cplg 150#", "Acmee Tols"), ("A3", "steel bolt", None), ("A1", "mystery cplg 150#", None)], "Mfg_Part_Num string, Part_Desc string, Part_Manuf string")
    rows = rows.select("*", *(F.lit(None).cast("string").alias(c) for c in ("E1_Brand", "Unilog_Brand", "DIB_Brand")))
    asked = []

    def understand(q):
        asked.append(sorted(r.id for r in q.collect()))
        return q.withColumn("answer", F.when(F.contains("id", F.lit("mystery Coupling 150 lb")), '{"product_type": "Widget", "voltage": "24 V", "odd_fact": 3}'))

    def names(q):
        return q.withColumn("answer", F.lit("- acme tools"))

    def classes(q):
        return q.withColumn("answer", F.lit("plumbing>valves>valves"))

    master = spark.createDataFrame([("Acme Tools", "A", 0), ("Zeta", "Z", 1)], "name string, code string, ordinal int")
    refs = References(standin.taxonomy(spark), master)
    done = {(r.mpn, r.best_manufacturer): r for r in run.enrich_safely(rows, refs, Services(understand, names, classes)).collect()}
    assert asked == [["Part Number: A1\nDescription: mystery Coupling 150 lb", "Part Number: A2\nDescription: mystery Coupling 150 lb", "Part Number: A3\nDescription: steel bolt"]]
    a1 = done["A1", "Acmee Tols"]
    assert a1.manufacturer_name == "Acme Tools" and a1.manufacturer_confidence >= 0.7
    assert [(x.label, x.value, x.uom) for x in a1.attributes] == [("Voltage", "24", "V"), ("Odd Fact", "3", None)] and a1._error is None
    assert done["A3", None].classpath == "Hardware>Fasteners>Bolts" and a1.classpath == "Plumbing>Valves>Valves"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("MPN,Description,Maker,Else\n007,a bolt,Acme,x\n")
    rows, report = tables.read_catalogue(spark, str(tmp_path / "a.csv"))
    assert rows.select("Mfg_Part_Num", "Part_Manuf").first() == ("007", "Acme") and report.ignored == ["Else"]
    with pytest.raises(ValueError, match="can't read .xls:"):
        tables.read_catalogue(spark, "book.xls")
    (tmp_path / "truth.csv").write_text("a,b\n1,\n,x\n")
    assert sorted(map(tuple, tables.read_truth(spark, str(tmp_path / "truth.csv")).collect())) == [("", "x"), ("1", "")]
    assert tables.checked_limit("") is None and tables.checked_limit("7") == 7
    with pytest.raises(ValueError, match="not a row limit"):
        tables.checked_limit("-1")
    assert tables.checked_upload("a.XLSX", 50 * 1024 * 1024) == "xlsx"
    for name, size in (("a.exe", 1), ("noext", 1), ("a.csv", 50 * 1024 * 1024 + 1)):
        with pytest.raises(ValueError):
            tables.checked_upload(name, size)


def test_sinks(spark, tmp_path):
    products = run.sample_products(spark)
    tables.write_products(products, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError, match="columns differ"):
        tables.write_delivery(products, str(tmp_path / "d"))


def test_last_decision_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("a", "accept", "2024-01-01 10:00:00"), ("a", "reject", "2024-01-03 10:00:00"), ("b", "edit", "2024-01-01 10:00:00"), ("a", "edit", "2024-01-02 10:00:00"), ("b", "bogus", "2024-02-01 10:00:00"), (None, "edit", "2024-01-01 10:00:00")]
    (tmp_path / "in" / "e.json").write_text("".join(json.dumps(dict(zip(("key", "decision", "at"), x))) + "\n" for x in lines))
    events = spark.readStream.schema("key string, decision string, at timestamp").json(str(tmp_path / "in"))
    query = jobs.last_decisions(events).writeStream.format("memory").queryName("last_seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.key, r.decision) for r in spark.table("last_seen").collect()) == [("a", "reject"), ("b", "edit")]
    assert jobs.progress(query)["status"] == "done"


def test_values_and_labels(spark):
    row = spark.range(1).select(controlled_value(F.lit("Material"), F.lit(" Iron "))["value"].alias("v"), attributes.fact_label(F.lit("max_temp-rating 3m")).alias("l")).first()
    assert tuple(row) == ("Cast Iron", "Max Temp-Rating 3M")


def test_options_are_the_most_similar_names(spark):
    values = spark.createDataFrame([("Acme Corp",)], "raw string")
    master = spark.createDataFrame([("Zeta", 0), ("Acme", 1), ("Acme Corp.", 2), ("Corp", 3)], "name string, ordinal int")
    (row,) = choices.options(values, master, 2).collect()
    assert row.options == ["Acme Corp.", "Acme"]
    assert choices.chosen(choices.options(values, master, 2), None).first().method == "unresolved"


def test_one_budget_is_dealt_over_all_tasks(spark, tmp_path):
    """Six different questions in two tasks at 0.2 s a call: no more than five calls a second in all, each question once."""
    log = str(tmp_path / "log")

    def connect():
        def ask(prompt):
            import time

            with open(log, "a") as f:
                f.write(f"{time.time()} {prompt}\n")
            if prompt == "bad":
                raise RuntimeError("no")
            return prompt.upper()

        return ask

    df = spark.createDataFrame([(q,) for q in ["a", "b", "c", "d", "e", "bad", "a", "b", None]], "q string")
    got = providers.replies(df, "q", connect, providers.Pacing(interval=0.2), tasks=2).collect()
    assert sorted((str(r.q), r.reply) for r in got) == [("None", None), ("a", "A"), ("a", "A"), ("b", "B"), ("b", "B"), ("bad", None), ("c", "C"), ("d", "D"), ("e", "E")]
    calls = [line.split() for line in open(log)]
    times = sorted(float(t) for t, _ in calls)
    assert sorted(q for _, q in calls) == ["a", "b", "bad", "c", "d", "e"] and all(b - a > 0.75 for a, b in zip(times, times[4:]))
    assert [r.reply for r in providers.replies(df, "q").collect()] == [None] * 9


def test_model_choice():
    choose = providers.choose_model
    assert choose(["b", "a"], ["x", "b"], "d") == "b" and choose(["whisper-1", "zeta", "beta"], ["x"], "d") == "beta"
    assert choose(["tts-1"], ["x"], "d") == "d" and choose([], [], "d") == "d" and choose(["a"], ["a"], "d", " own ") == "own"


def test_uploads_are_enriched_once_in_batches(spark, tmp_path):
    """Two files, then a third; bad rows stay in their batch with their reason; a second run finds nothing new."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    refs = References(standin.taxonomy(spark))

    def upload(name, *rows):
        (folder / name).write_text(HEADER + "".join(f"{r}\n" for r in rows))

    def go():
        query = jobs.enrich_uploads(spark, str(folder), str(tmp_path / "check"), out, lambda df: run.enrich_safely(df, refs).select("mpn", "classpath", "_error"))
        query.awaitTermination()
        assert jobs.progress(query)["status"] == "done"
        return sorted((str(r.mpn), r.classpath, r._error) for r in spark.read.parquet(out).collect())

    upload("a.csv", "007,steel bolt,,,,", " , ,,,,")
    upload("b.csv", "P2,vlv,,,,")
    first = [("007", "Hardware>Fasteners>Bolts", None), ("None", None, "neither part number nor description"), ("P2", "Plumbing>Valves>Valves", None)]
    assert go() == first
    upload("c.csv", "P3,anvil,,,,")
    assert go() == go() == sorted([*first, ("P3", "Hardware>Tools>Anvils", None)])
