import random

import pytest

from tessella.llm import licenses as lic


@pytest.mark.parametrize("t", lic.TEMPLATES, ids=lambda t: t.name)
def test_each_template_is_recognised(t):
    text = f"Some words before.\n{t.text}\nand some after."
    start = text.index(t.text)
    assert lic.scan(text) == [(t.name, start, start + len(t.text.rstrip(".")), 0)]


def test_wording_decides_between_relatives():
    for a, b in (("gpl-2.0", "gpl-3.0"), ("cc-by-nc-4.0", "cc-by-4.0"), ("bsd-2-clause", "bsd-3-clause"), ("cc-by-3.0", "cc-by-4.0")):
        for name in (a, b):
            texts = [t.text for t in lic.TEMPLATES if t.name == name]
            assert {lic.scan(t)[0][0] for t in texts} == {name}


def test_small_edits_and_line_breaks_are_tolerated_and_counted():
    mit = next(t.text for t in lic.TEMPLATES if t.name == "mit").split()
    mit[mit.index("persons")] = "people"
    lines = "\n".join(" ".join(mit[i : i + 12]) for i in range(0, len(mit), 12))
    assert lic.scan("\U0001f600 first\n" + lines)[0][0] == "mit" and lic.scan(lines)[0][3] == 1


def test_plain_mentions_are_left_alone():
    for text in ("He lost his driving licence on Monday.", "All copyright questions go to the office, with permission of the board.", "", "No warranty talk here, licensed or not."):
        assert lic.scan(text) == []


def test_table(spark, tmp_path):
    rows = [(1, None, 1), (2, "", 1), (3, "x\nReleased under the MIT License.\ny\nLicensed under CC BY-NC 4.0.", 1), (3, "Released under the MIT License.", 1), (None, "clean", 1), (4, "license " * 50_000, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, found int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_licenses, r.found) for r in lic.op2_license_scan(spark, str(tmp_path)).collect())
    assert got == [("1", 0, ""), ("2", 0, ""), ("3", 1, "mit:0:30:0"), ("3", 2, "mit:2:32:0,cc-by-nc-4.0:36:63:0"), ("4", 0, ""), ("None", 0, "")]
    assert lic.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _prose(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("around", [5, 10, 200, 5000])
def test_notices_inside_long_lines_are_found(around):
    for t in lic.TEMPLATES:
        text = f"{_prose(around, 1)} {t.text} {_prose(around, 2)}"
        start = text.index(t.text)
        assert lic.scan(text) == [(t.name, start, start + len(t.text.rstrip(".")), 0)]


@pytest.mark.parametrize("length", [10, 60, 120, 1000])
def test_wrapped_text_between_long_lines_is_found(length):
    for name in ("mit", "isc", "bsd-3-clause", "apache-2.0", "gpl-2.0"):
        words = next(t.text for t in lic.TEMPLATES if t.name == name).split()
        lines = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
        text = "\n".join([_prose(length, k) for k in range(6)] + [lines] + [_prose(length, k) for k in range(6, 12)])
        start = text.index(lines)
        assert lic.scan(text) == [(name, start, start + len(lines.rstrip(".")), 0)]


def test_every_licence_of_a_block_and_of_a_line_is_found():
    def wrapped(name):
        words = next(t.text for t in lic.TEMPLATES if t.name == name).split()
        return "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))

    names = ["mit", "isc", "bsd-3-clause", "mit", "gpl-2.0", "gpl-3.0", "unlicense", "mit"]
    text = "\n\nParts under other terms:\n\n".join(wrapped(n) for n in names)
    assert len(lic.blocks(text, 6)) < len(names)
    assert [(n, d) for n, _, _, d in lic.scan(text)] == [(n, 0) for n in names]
    edited = wrapped("mit").replace("persons", "people")
    assert [(n, d) for n, _, _, d in lic.scan(f"{edited}\n{wrapped('mit').replace('DEALINGS', 'USES')}\n{edited}")] == [("mit", 1)] * 3
    line = "Licensed under the MIT License. Or: Licensed under the Apache License, Version 2.0. Docs: Licensed under CC BY 4.0. Again: Licensed under the MIT License."
    assert [f[0] for f in lic.scan(line)] == ["mit", "apache-2.0", "cc-by-4.0", "mit"]
    assert [f[0] for f in lic.scan(f"{wrapped('isc')} {line}\n{wrapped('mit')}")] == ["isc", "mit", "apache-2.0", "cc-by-4.0", "mit", "mit"]


def test_size_reduction_chooses_between_confirmed_templates(monkeypatch):
    """An edited text of the longer licence holds the unedited shorter one: by differences alone the shorter would win."""
    words = next(t.text for t in lic.TEMPLATES if t.name == "bsd-3-clause").replace("copyright holder", "company").replace("specific prior", "prior").split()
    text = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    assert [f[0] for f in lic.scan(text)] == ["bsd-3-clause"] and lic.scan(text)[0][3] > 0
    monkeypatch.setattr(lic.Library, "saved", lambda self, text, k: 0)
    assert [f[0] for f in lic.scan(text)] == ["bsd-2-clause"]


@pytest.mark.parametrize("mark", ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "BSD-3-Clause", "CC0-1.0", "MIT-0"])
def test_spdx_lines(mark):
    for text in (f"# SPDX-License-Identifier: {mark}", f"/* code */\n// spdx-license-identifier: {mark}\nint x;", f"{_prose(30, 1)} SPDX-License-Identifier: {mark} {_prose(30, 2)}"):
        assert [f[0] for f in lic.scan(text)] == [mark.lower()]


def test_short_forms():
    for text, name in (("Released under GPL v2", "gpl-2.0"), ("This is under the GPLv3.", "gpl-3.0"), ("distributed under LGPL v2.1 or so", "lgpl-2.1"), ("under AGPL-3", "agpl-3.0")):
        assert [f[0] for f in lic.scan(text)] == [name], text


def test_further_templates(tmp_path):
    own = " ".join(f"clause{i} grants permission {i * 7}" for i in range(60))
    (tmp_path / "house-1.0.txt").write_text(own)
    settings = lic.Settings(more=lic.read_templates(str(tmp_path)))
    text = f"Intro\n{own.replace('clause9 ', 'section9 ')}\nLicensed under the MIT License."
    assert [(f[0], f[3]) for f in lic.scan(text, settings)] == [("house-1.0", 1), ("mit", 0)] and [f[0] for f in lic.scan(text)] == ["mit"]


def brute(text, s):
    """Every template at every window of a one-block text of long templates, the one that saves most first."""
    held = lic.library(lic.TEMPLATES, s.level)
    places, words, found = [m.span() for m in lic._WORD.finditer(text)], lic._words(text), []
    for k, want in enumerate(held.words):
        most = int(s.differences * len(want) + 0.5)
        own = set()
        if len(want) < s.long:
            continue
        for at in range(max(1, len(words) - len(want) + most + 1)):
            n, missing, a, b = lic.differences(words[at : at + len(want) + 2 * most], want)
            if b >= a and n <= most and not missing.intersection(held.templates[k].must):
                own.add((n, places[at + a][0], places[at + b][1]))
        for n, a, b in sorted(own):
            if all(b <= x or y <= a for j, _, x, y in found if j == k):
                found.append((k, n, a, b))
    out = []
    for k, n, a, b in sorted(found, key=lambda x: (-held.saved(text[x[2] : x[3]], x[0]), x[1])):
        if all(b <= y or z <= a for _, y, z, _ in out):
            out.append((held.templates[k].name, a, b, n))
    return sorted(out, key=lambda f: f[1])


def test_equals_brute_force():
    rnd = random.Random(7)
    long = [t for t in lic.TEMPLATES if len(lic._words(t.text)) >= lic.Settings().long]
    for seed in range(24):
        parts = [_prose(12, 100 + seed)]
        for t in rnd.sample(long, 2):
            words = t.text.split()
            for _ in range(rnd.choice([0, 2, len(words) // 14, len(words) // 5])):
                words[rnd.randrange(len(words))] = rnd.choice(["other", "words", ""])
            parts += [" ".join(words), _prose(rnd.randint(3, 40), seed)]
        text = " ".join(" ".join(parts).split())
        got = [f for f in lic.scan(text) if any(f[0] == t.name for t in long) and f[2] - f[1] > 200]
        want = [f for f in brute(text, lic.Settings())]
        assert [(f[0], f[3]) for f in got] == [(f[0], f[3]) for f in want]
